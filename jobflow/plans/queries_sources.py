"""Landed board results and API documents; the documents are built from the given tables."""

from pyspark.sql import functions as F

from jobflow import rules
from jobflow.fixtures import AS_OF, AS_OF_ISO, POSTINGS_DOCS_SQL, postings_docs, table
from jobflow.operators import metrics
from jobflow.plans import sql as S
from jobflow.plans.catalog import query
from jobflow.sources import landed

_BOARD_COLUMNS = "title, institution, location, url, description, source, date_posted, scraped_at, career_page, ats_platform"


def search_results(spark, sf):
    """Board results: keyword from the event type, site from the user."""
    e, u = F.col("event_id"), F.col("user_id")
    site = F.concat(F.lit("board"), u % 5)
    return table(spark, sf, "events").select(
        e.alias("seq"), F.col("event_type").alias("keyword"), site.alias("site"),
        F.concat(F.lit("Role "), e % 97).alias("title"), F.concat(F.lit("Org "), u).alias("company"),
        F.lit("Remote").alias("location"), F.col("props").alias("description"),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("https://"), site, F.lit(".example.com/"), e)).alias("job_url"),
        F.concat(F.lit("https://direct.example.com/"), e).alias("job_url_direct"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_posted"), F.col("value").cast("int").cast("string").alias("min_amount"),
        F.lit("").alias("max_amount"), F.lit("USD").alias("currency"), F.when(e % 2 == 0, "yearly").otherwise("").alias("interval"),
        F.lit("hourly").alias("salary_interval"), F.when(e % 3 == 0, "fulltime").otherwise("contract").alias("job_type"),
        F.when(u % 2 == 0, "True").otherwise("False").alias("is_remote"),
    )


_RESULTS_SQL = """SELECT event_id AS seq, event_type AS keyword, 'board' || (user_id % 5) AS site, 'Role ' || (event_id % 97) AS title,
  'Org ' || user_id AS institution, 'Remote' AS location, props AS description,
  CASE WHEN event_id % 4 = 0 THEN 'https://direct.example.com/' || event_id ELSE 'https://board' || (user_id % 5) || '.example.com/' || event_id END AS url,
  'jobspy/board' || (user_id % 5) AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_posted,
  CAST(CAST(trunc(value) AS INT) AS VARCHAR) AS min_amount, CASE WHEN event_id % 2 = 0 THEN 'yearly' ELSE 'hourly' END AS salary_interval,
  CASE WHEN event_id % 3 = 0 THEN 'fulltime' ELSE 'contract' END AS job_type,
  CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END AS is_remote, ts FROM events"""
_SHOWN = "seq, title, institution, location, url, description, source, date_posted, min_amount, salary_interval, job_type, is_remote"


@query("board_search", f"SELECT {_SHOWN} FROM ({_RESULTS_SQL})")
def board_search(spark, sf):
    return landed.board_search(search_results(spark, sf), AS_OF_ISO).select(*_SHOWN.split(", "))


_ASKED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY keyword, site ORDER BY seq) AS rn
  FROM ({_RESULTS_SQL}) WHERE date_trunc('second', ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND job_type = 'fulltime' AND is_remote = 'True'"""


def _asked(spark, sf, keep=None):
    asked = landed.search_request(search_results(spark, sf), AS_OF, 10, is_remote=True, job_type="fulltime", keep=keep)
    return landed.board_search(asked, AS_OF_ISO).select(*_SHOWN.split(", "))


@query("board_search_asked", f"SELECT {_SHOWN} FROM ({_ASKED_SQL})")
def board_search_asked(spark, sf):
    return _asked(spark, sf)


@query("board_search_top40", f"SELECT {_SHOWN} FROM ({_ASKED_SQL}) WHERE rn <= 40")
def board_search_top40(spark, sf):
    return _asked(spark, sf, keep=40)


# five postings per landed document, grouped by consecutive ids
_GROUP = "doc_id // 5"


def _grouped(spark, sf, job):
    return table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 5).alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", job.alias("job")))).alias("jobs")
    )


def _markup():
    return F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><script>x()</script>"))


def greenhouse_docs(spark, sf):
    d = F.col("doc_id")
    job = F.struct(
        F.concat(F.lit(" Engineer  "), d).alias("title"),
        F.when(d % 7 != 0, F.concat(F.lit("https://boards.greenhouse.io/x/jobs/"), d, F.lit("?gh=1"))).alias("absolute_url"),
        _markup().alias("content"), F.when(d % 3 == 0, "2024-01-05").otherwise("").alias("updated_at"),
        F.lit("2023-12-01").alias("created_at"), F.when(d % 4 != 0, F.struct(F.col("lang").alias("name"))).alias("location"),
    )
    return _grouped(spark, sf, job).select(
        F.concat(F.lit("Org "), "g").alias("company"), F.concat(F.lit("https://boards.greenhouse.io/org"), "g").alias("board_url"),
        F.to_json(F.struct(F.col("jobs.job").alias("jobs"))).alias("json"),
    )


@query("landed_greenhouse", f"""SELECT 'Engineer ' || doc_id AS title, 'Org ' || ({_GROUP}) AS institution, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE '' END AS location,
  CASE WHEN doc_id % 7 <> 0 THEN 'https://boards.greenhouse.io/x/jobs/' || doc_id ELSE 'https://boards.greenhouse.io/org' || ({_GROUP}) END AS url,
  {S.squash('text')} AS description, 'career/greenhouse' AS source, CASE WHEN doc_id % 3 = 0 THEN '2024-01-05' ELSE '2023-12-01' END AS date_posted,
  '{AS_OF_ISO}' AS scraped_at, 'https://boards.greenhouse.io/org' || ({_GROUP}) AS career_page, 'greenhouse' AS ats_platform FROM documents""")
def landed_greenhouse(spark, sf):
    return landed.greenhouse(greenhouse_docs(spark, sf), AS_OF_ISO)


def lever_docs(spark, sf):
    d = F.col("doc_id")
    job = F.struct(
        F.concat(F.lit("Analyst "), d).alias("text"), F.concat(F.lit("https://jobs.lever.co/y/"), d).alias("hostedUrl"),
        F.when(d % 5 != 0, d * 86400001).alias("createdAt"), F.col("text").alias("descriptionPlain"),
        F.when(d % 2 == 0, "More  text").alias("additionalPlain"),
        F.when(d % 3 == 0, F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<li>one</li><li>two</li>").alias("content")))).alias("lists"),
        F.struct(F.col("lang").alias("location")).alias("categories"),
    )
    return _grouped(spark, sf, job).select(
        F.concat(F.lit("Org "), "g").alias("company"), F.concat(F.lit("https://jobs.lever.co/org"), "g").alias("board_url"),
        F.to_json(F.col("jobs.job")).alias("json"),
    )


@query("landed_lever", f"""SELECT 'Analyst ' || doc_id AS title, 'Org ' || ({_GROUP}) AS institution, lang AS location, 'https://jobs.lever.co/y/' || doc_id AS url,
  {S.squash("text || CASE WHEN doc_id % 2 = 0 THEN ' More text' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' Needs one two' ELSE '' END")} AS description,
  'career/lever' AS source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE strftime(make_timestamp(doc_id * 86400001000), '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN doc_id % 1000 <> 0 THEN '.' || lpad(CAST((doc_id % 1000) * 1000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' END AS date_posted,
  '{AS_OF_ISO}' AS scraped_at, 'https://jobs.lever.co/org' || ({_GROUP}) AS career_page, 'lever' AS ats_platform FROM documents""")
def landed_lever(spark, sf):
    return landed.lever(lever_docs(spark, sf), AS_OF_ISO)


def smart_lists(spark, sf):
    d = F.col("doc_id")
    job = F.struct(
        d.cast("string").alias("id"), F.concat(F.lit("Role "), d).alias("name"),
        F.concat(F.lit("https://jobs.smartrecruiters.com/z/"), d).alias("ref"), F.lit("2024-01-02T00:00:00Z").alias("releasedDate"),
        F.struct(F.lit("Austin").alias("city"), F.when(d % 2 == 0, "TX").alias("region"), F.col("lang").alias("country")).alias("location"),
    )
    return _grouped(spark, sf, job).select(
        F.concat(F.lit("Org "), "g").alias("company"), F.concat(F.lit("https://jobs.smartrecruiters.com/org"), "g").alias("board_url"),
        F.to_json(F.struct(F.col("jobs.job").alias("content"))).alias("json"),
    )


def smart_details(spark, sf):
    d = F.col("doc_id")
    body = F.struct(F.struct(F.create_map(
        F.lit("a"), F.struct(_markup().alias("text")), F.lit("b"), F.struct(F.lit("<b>Apply</b> now").alias("text"))
    ).alias("sections")).alias("jobAd"))
    return table(spark, sf, "documents").where(d % 6 != 0).select(
        F.concat(F.lit("https://jobs.smartrecruiters.com/org"), F.floor(d / 5)).alias("board_url"),
        d.cast("string").alias("id"), F.to_json(body).alias("json"),
    )


@query("landed_smartrecruiters", f"""SELECT 'Role ' || doc_id AS title, 'Org ' || ({_GROUP}) AS institution,
  'Austin ' || CASE WHEN doc_id % 2 = 0 THEN 'TX ' ELSE '' END || lang AS location, 'https://jobs.smartrecruiters.com/z/' || doc_id AS url,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE {S.squash("text || ' Apply now'")} END AS description, 'career/smartrecruiters' AS source,
  '2024-01-02T00:00:00Z' AS date_posted, '{AS_OF_ISO}' AS scraped_at, 'https://jobs.smartrecruiters.com/org' || ({_GROUP}) AS career_page,
  'smartrecruiters' AS ats_platform FROM documents""")
def landed_smartrecruiters(spark, sf):
    return landed.smartrecruiters(smart_lists(spark, sf), smart_details(spark, sf), AS_OF_ISO)


def _workday_json():
    d = F.col("doc_id")
    return F.struct(
        F.concat(F.lit("Scientist "), d).alias("title"),
        F.when(d % 11 == 0, "").otherwise(F.concat(F.lit("/job/"), d % 300)).alias("externalPath"),
        F.when(d % 2 == 0, "Austin, TX").otherwise("").alias("locationsText"), F.lit("Remote").alias("primaryLocation"),
        F.col("text").alias("briefDesc"), F.when(d % 3 == 0, "Posted 3 Days Ago").alias("postedOn"), F.lit("2024-01-09").alias("startDate"),
    )


def workday_docs(spark, sf):
    """Portal answers: groups of five postings go to the portals in turn."""
    host = F.element_at(F.array(*[F.lit(h) for _, h, _ in rules.WORKDAY_PORTALS]), (F.col("g") % len(rules.WORKDAY_PORTALS) + 1).cast("int"))
    return _grouped(spark, sf, _workday_json()).select(
        host.alias("host"), F.col("g").alias("query_pos"), F.to_json(F.struct(F.col("jobs.job").alias("jobPostings"))).alias("json"),
    )


_PORTAL_NAMES = [n for n, _, _ in rules.WORKDAY_PORTALS]
_PORTAL_HOSTS = [h for _, h, _ in rules.WORKDAY_PORTALS]
_WD_ROW = """CASE WHEN doc_id % 2 = 0 THEN 'Austin, TX' ELSE 'Remote' END AS location, text AS description,
  CASE WHEN doc_id % 3 = 0 THEN 'Posted 3 Days Ago' ELSE '2024-01-09' END AS date_posted"""


@query("landed_workday_portals", f"""SELECT title, institution, location, url, description, source, date_posted FROM (
  SELECT *, row_number() OVER (PARTITION BY institution, url ORDER BY doc_id) AS rn FROM (
    SELECT doc_id, 'Scientist ' || doc_id AS title, p AS institution, {_WD_ROW}, 'workday/' || lower(p) AS source,
      CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'https://' || h || '/job/' || (doc_id % 300) END AS url
    FROM (SELECT *, {S.items(_PORTAL_NAMES)}[({_GROUP}) % 7 + 1] AS p, {S.items(_PORTAL_HOSTS)}[({_GROUP}) % 7 + 1] AS h FROM documents))) WHERE rn = 1""")
def landed_workday_portals(spark, sf):
    return landed.workday_portals(workday_docs(spark, sf), AS_OF_ISO).select(
        "title", "institution", "location", "url", "description", "source", "date_posted"
    )


def workday_board_docs(spark, sf):
    k = F.col("g") % 9
    return _grouped(spark, sf, _workday_json()).select(
        F.concat(F.lit("Org "), k).alias("company"), F.concat(F.lit("https://org"), k, F.lit(".wd1.myworkdayjobs.com/en-US/Careers")).alias("board_url"),
        F.concat(F.lit("https://org"), k, F.lit(".wd1.myworkdayjobs.com/wday/cxs/Careers/jobs")).alias("api_url"),
        F.col("g").alias("offset"), F.to_json(F.struct(F.col("jobs.job").alias("jobPostings"))).alias("json"),
    )


@query("landed_workday", f"""SELECT {_BOARD_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY institution, job_url ORDER BY doc_id) AS rn,
    {S.clean_url('job_url')} AS url FROM (
    SELECT doc_id, 'Scientist ' || doc_id AS title, 'Org ' || k AS institution, CASE WHEN doc_id % 2 = 0 THEN 'Austin, TX' ELSE 'Remote' END AS location,
      {S.squash('text')} AS description, CASE WHEN doc_id % 3 = 0 THEN 'Posted 3 Days Ago' ELSE '2024-01-09' END AS date_posted,
      'career/workday' AS source, '{AS_OF_ISO}' AS scraped_at, 'https://org' || k || '.wd1.myworkdayjobs.com/en-US/Careers' AS career_page, 'workday' AS ats_platform,
      'https://org' || k || '.wd1.myworkdayjobs.com' || CASE WHEN doc_id % 11 = 0 THEN '/en-US/Careers' ELSE '/job/' || (doc_id % 300) END AS job_url
    FROM (SELECT *, ({_GROUP}) % 9 AS k FROM documents))) WHERE rn = 1""")
def landed_workday(spark, sf):
    return landed.workday_boards(workday_board_docs(spark, sf), AS_OF_ISO)


@query("source_union", f"""SELECT source, count(*) AS count FROM (
  SELECT source FROM ({POSTINGS_DOCS_SQL}) UNION ALL SELECT source FROM ({_RESULTS_SQL})) GROUP BY source""")
def source_union(spark, sf):
    both = metrics.union_sources(
        postings_docs(spark, sf), landed.board_search(search_results(spark, sf), AS_OF_ISO)
    )
    return metrics.source_counts(both)
