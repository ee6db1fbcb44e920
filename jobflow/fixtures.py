"""Operator inputs derived from the given tables, in PySpark and (for the checks) in SQL.

Both forms define the same rows, so a query and its SQL read identical data.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.functions.text import literal_array, squash

AS_OF = "2024-01-31 00:00:00"
AS_OF_ISO = "2024-01-31T00:00:00+00:00"

ROLES = ["Engineer", "Data Scientist", "Sales Manager", "Careers", "Technician", "Research Analyst"]
LOCATIONS = [
    "Austin, TX", "San Francisco, CA", "Remote", "United States", "Berlin, DE", "Boston",
    "Fort Collins CO", "",
]
NAMES = [
    "Ansys", "GE Aerospace", "ORNL careers", "acme robotics", "Lam Research", "Westinghouse",
    "University of Somewhere", "Blue Ridge national laboratory", "Vulcan Elements (US)", "hpe",
]
#: the posting keywords the sample queries look for
KEYWORDS = ["data scientist", "research analyst", "thank", "worthless", "Über", "++"]
SIGNALS = ["engineer station", "reading", "notion", "thing", "station"]


#: session setting: number of partitions into which text tables are dealt; unset, they stay as read
INPUT_PARTITIONS = "jobflow.input.partitions"


def table(spark: SparkSession, sf: str, name: str, key: str | None = None) -> DataFrame:
    """A given table. One that takes costly text work names its ``key``, by which a session may have
    it dealt to a set number of partitions (a single small file is one task otherwise)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    n = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n), key) if key and n else df


def dealt(df: DataFrame) -> DataFrame:
    """A narrow table dealt evenly to all cores, for text work that costs far more than its bytes: a
    file of a few megabytes is one task otherwise. A scan in more parts keeps their number."""
    return df.repartition(max(df.rdd.getNumPartitions(), 3 * df.sparkSession.sparkContext.defaultParallelism))


def _pick(values, index):
    return F.element_at(literal_array(values), (index % len(values) + 1).cast("int"))


def postings_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Broad postings with colliding keys, blanks and every date wording."""
    d, n = F.col("doc_id"), F.col("n_chars")
    first_word = F.substring_index(F.substring_index("text", "\n", 1), " ", 1)
    url = F.concat(
        F.lit("https://org"), n % 5, F.lit(".example.com/jobs/"), n % 400,
        F.when(d % 3 == 0, "/v2").otherwise(""), F.when(d % 2 == 0, "?utm_source=x").otherwise(""),
    )
    posted = (
        F.when(d % 6 == 0, "today").when(d % 6 == 1, "yesterday")
        .when(d % 6 == 2, F.concat(d % 40, F.lit(" days ago"))).when(d % 6 == 3, "30+ days ago")
        .when(d % 6 == 4, F.concat(F.lit("2024-01-"), F.lpad((d % 31 + 1).cast("string"), 2, "0")))
        .otherwise("")
    )
    return table(spark, sf, "documents", "doc_id").select(
        d.alias("seq"),
        F.when(d % 13 == 0, "").otherwise(F.concat(_pick(ROLES, n), F.lit(" "), first_word)).alias("title"),
        F.concat(F.lit("Org "), n % 5).alias("institution"),
        F.when(d % 17 == 0, "").otherwise(_pick(LOCATIONS, F.floor(n / 7))).alias("location"),
        url.alias("url"),
        F.col("text").alias("description"),
        F.col("source"),
        posted.alias("date_posted"),
        F.lit(AS_OF_ISO).alias("scraped_at"),
        *[F.lit("").alias(c) for c in
          ("min_amount", "max_amount", "currency", "salary_interval", "job_type", "is_remote")],
    )


def _sql_pick(values, index):
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{items}], CAST({index} % {len(values)} + 1 AS INT))"


POSTINGS_DOCS_SQL = f"""
SELECT doc_id AS seq,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE {_sql_pick(ROLES, 'n_chars')} || ' '
       || split_part(split_part(text, chr(10), 1), ' ', 1) END AS title,
  'Org ' || (n_chars % 5) AS institution,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE {_sql_pick(LOCATIONS, '(n_chars // 7)')} END AS location,
  'https://org' || (n_chars % 5) || '.example.com/jobs/' || (n_chars % 400)
    || CASE WHEN doc_id % 3 = 0 THEN '/v2' ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN '?utm_source=x' ELSE '' END AS url,
  text AS description, source,
  CASE doc_id % 6 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN (doc_id % 40) || ' days ago'
    WHEN 3 THEN '30+ days ago' WHEN 4 THEN '2024-01-' || lpad(CAST(doc_id % 31 + 1 AS VARCHAR), 2, '0')
    ELSE '' END AS date_posted,
  '{AS_OF_ISO}' AS scraped_at,
  '' AS min_amount, '' AS max_amount, '' AS currency, '' AS salary_interval, '' AS job_type, '' AS is_remote
FROM documents
"""


def mail_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Mailbox rows: matched, vendor-sent and unmatched texts."""
    docs = table(spark, sf, "documents", "doc_id").select(
        (F.col("doc_id") * 2).alias("seq"), F.col("n_chars").alias("n"), "text"
    )
    talk = table(spark, sf, "conversations", "conv_id").select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("seq"),
        F.length("text").cast("long").alias("n"), "text",
    )
    name, n, body = _pick(NAMES, F.col("n")), F.col("n"), squash(F.col("text"))
    k = F.floor(F.col("seq") / 2) % 12

    def row(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], body)

    text = (
        F.when(k == 0, row("Thank you for applying to ", name, "! "))
        .when(k == 1, row("Your application at ", name, " "))
        .when(k == 2, row("jobs", n % 30, "@org", n % 7, ".example.com Status Update "))
        .when(k == 3, row(name, " Talent Acquisition - Careers Thank you for your interest "))
        .when(k == 4, row("hr.team+x@myworkday.com Welcome to the list "))
        .when(k == 5, row("no-reply@us.greenhouse-mail.io ", name, ": Regarding your submission "))
        .when(k == 6, body)
        .when(k == 7, row("application update on Data Engineer at ", name, " "))
        .when(k == 8, row("jane@ge.com Application received "))
        .when(k == 9, row("thank you for applying for Stress Analyst at ", name, " 2024-01-05 "))
        .when(k == 10, row(name, " HR Inbox "))
        .otherwise(row("careers.ornl@lab", n % 9, ".example.org Subject: see www.site", n % 11,
                       ".example.com/jobs and join.com "))
    )
    return docs.unionByName(talk).select("seq", text.alias("row"))


def _sql_body(text):
    return rf"trim(regexp_replace({text}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))"


MAIL_ROWS_SQL = f"""
SELECT seq, CASE (seq // 2) % 12
  WHEN 0 THEN 'Thank you for applying to ' || name || '! ' || body
  WHEN 1 THEN 'Your application at ' || name || ' ' || body
  WHEN 2 THEN 'jobs' || (n % 30) || '@org' || (n % 7) || '.example.com Status Update ' || body
  WHEN 3 THEN name || ' Talent Acquisition - Careers Thank you for your interest ' || body
  WHEN 4 THEN 'hr.team+x@myworkday.com Welcome to the list ' || body
  WHEN 5 THEN 'no-reply@us.greenhouse-mail.io ' || name || ': Regarding your submission ' || body
  WHEN 6 THEN body
  WHEN 7 THEN 'application update on Data Engineer at ' || name || ' ' || body
  WHEN 8 THEN 'jane@ge.com Application received ' || body
  WHEN 9 THEN 'thank you for applying for Stress Analyst at ' || name || ' 2024-01-05 ' || body
  WHEN 10 THEN name || ' HR Inbox ' || body
  ELSE 'careers.ornl@lab' || (n % 9) || '.example.org Subject: see www.site' || (n % 11)
    || '.example.com/jobs and join.com ' || body END AS row
FROM (SELECT seq, n, {_sql_pick(NAMES, 'n')} AS name, {_sql_body('text')} AS body
  FROM (SELECT doc_id * 2 AS seq, n_chars AS n, text FROM documents
    UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1, length(text), text FROM conversations))
"""


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return log_lines(table(spark, sf, "events"))


def log_lines(events: DataFrame) -> DataFrame:
    """Run-log lines of an events frame (batch or stream): one run per user, in event order."""
    e = F.col("event_id")
    note = _pick(
        ["linkedin search", "indeed page", "glassdoor", "zip_recruiter", "google", "dedup pass",
         "saving out.csv", "scoring", "step", "step", "step"], e
    )
    line = F.when(e % 29 == 0, "  ").otherwise(
        F.concat("event_type", F.lit(" total: "), F.get_json_object("props", "$.k"), F.lit(" "), note)
    )
    return events.select(
        F.col("user_id").alias("run_id"), e.alias("line_no"), "ts", line.alias("line")
    )


RUN_LOG_SQL = f"""
SELECT user_id AS run_id, event_id AS line_no, ts,
  CASE WHEN event_id % 29 = 0 THEN '  ' ELSE event_type || ' total: ' || json_extract_string(props, '$.k') || ' ' ||
  {_sql_pick(["linkedin search", "indeed page", "glassdoor", "zip_recruiter", "google", "dedup pass",
              "saving out.csv", "scoring", "step", "step", "step"], 'event_id')} END AS line
FROM events
"""
