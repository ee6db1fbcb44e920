"""Summaries, sorts, pages, sinks and file sources."""

from pyspark.sql import functions as F

from jobflow.fixtures import AS_OF, MAIL_ROWS_SQL, POSTINGS_DOCS_SQL, mail_rows, postings_docs, table
from jobflow.functions import dates
from jobflow.operators import evidence, filters, indexing, metrics
from jobflow.plans import name_sql as N
from jobflow.plans import sql as S
from jobflow.plans.catalog import query
from jobflow.plans.queries_filters import CUTOFF, broad_date, restricted_sql, title_ok
from jobflow.plans.queries_registry import registry_raw
from jobflow.plans import searches
from jobflow.schema import BROAD_FIELDS, COMPANY_FIELDS
from jobflow.session import scratch_path
from jobflow.sinks import writers
from jobflow.sources import files


@query("source_counts", f"SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS count FROM ({POSTINGS_DOCS_SQL}) GROUP BY 1")
def source_counts(spark, sf):
    return metrics.source_counts(postings_docs(spark, sf))


@query("result_metrics", f"""SELECT count(*) AS jobs, count(DISTINCT nullif(institution, '')) AS companies, count(DISTINCT nullif(source, '')) AS sources,
  count(*) FILTER (WHERE date_posted <> '') AS with_date FROM ({POSTINGS_DOCS_SQL})""")
def result_metrics(spark, sf):
    return metrics.result_metrics(postings_docs(spark, sf))


@query("result_metrics_lineitem", """SELECT count(*) AS jobs, count(DISTINCT l_suppkey) AS companies, count(DISTINCT l_returnflag) AS sources, count(l_shipdate) AS with_date FROM lineitem""")
def result_metrics_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("institution"), F.col("l_returnflag").alias("source"),
        F.col("l_shipdate").cast("string").alias("date_posted"),
    )
    return metrics.result_metrics(rows, blank_as_null=False)


_PREVIEW = f"SELECT seq, title, coalesce(location, '') AS location FROM (SELECT seq, title, nullif(location, '') AS location FROM ({POSTINGS_DOCS_SQL}) ORDER BY seq"


def _previewed(spark, sf, n=None):
    rows = postings_docs(spark, sf).select("seq", "title", F.nullif("location", F.lit("")).alias("location"))
    return metrics.preview(rows, ["seq"], n)


@query("preview", f"{_PREVIEW})")
def preview(spark, sf):
    return _previewed(spark, sf)


@query("preview_limited", f"{_PREVIEW} LIMIT 1000)")
def preview_limited(spark, sf):
    return _previewed(spark, sf, 1000)


_FUNNEL = ["license", "worthless", "copyright"]


@query("stage_funnel", f"""SELECT count(*) AS raw, count(*) FILTER (WHERE t) AS titled, count(*) FILTER (WHERE t AND d) AS recent, count(*) FILTER (WHERE t AND d AND NOT r) AS clean
FROM (SELECT {title_ok('title')} AS t, coalesce({broad_date()} >= {CUTOFF}, FALSE) AS d, {restricted_sql(_FUNNEL)} AS r FROM ({POSTINGS_DOCS_SQL}))""")
def stage_funnel(spark, sf):
    posted = dates.parse_posted_date(F.col("date_posted"), AS_OF, plus_adds_one=False)
    return metrics.stage_funnel(postings_docs(spark, sf), {
        "titled": filters.looks_like_job_title(F.col("title")),
        "recent": F.coalesce(posted >= dates.cutoff(AS_OF, 30), F.lit(False)),
        "clean": ~filters.is_restricted(F.col("title"), F.col("description"), _FUNNEL),
    })


@query("page_of_results", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 36")
def page_of_results(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return filters.result_page(rows, 3, [F.desc("o_totalprice"), "o_orderkey"], F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("column_titles", f"SELECT seq, 'Ai Score=1 | Title=' || title || ' | Date Posted=' || date_posted || ' | Source=' || source AS shown FROM ({POSTINGS_DOCS_SQL})")
def column_titles(spark, sf):
    """The displayed line of every posting: titles and values, scores first."""
    rows = postings_docs(spark, sf).select("seq", "title", "date_posted", "source").withColumn("ai_score", F.lit(1))
    shown = filters.order_result_columns(rows)
    titles = filters.column_titles(shown)
    parts = [F.concat(F.lit(f"{titles[c]}="), F.col(c).cast("string")) for c in shown.columns if c != "seq"]
    return shown.select("seq", F.concat_ws(" | ", *parts).alias("shown"))


@query("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return indexing.with_row_index(rows, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_index")


@query("csv_roundtrip", f"SELECT {', '.join(BROAD_FIELDS)} FROM ({POSTINGS_DOCS_SQL})")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "broad-csv")
    writers.write_broad_csv(postings_docs(spark, sf), path)
    # every field of a posting is text, so the values are compared as text
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').fillna("")


@query("csv_results", f"SELECT count(*) AS jobs, count(DISTINCT institution) AS companies, count(DISTINCT source) AS sources, count(*) FILTER (WHERE date_posted <> '') AS with_date FROM ({POSTINGS_DOCS_SQL})")
def csv_results(spark, sf):
    path = scratch_path(spark, "result-csv")
    writers.write_csv(postings_docs(spark, sf).select("title", "institution", "source", "date_posted"), path)
    read = files.read_results(spark, path)
    return metrics.result_metrics(read.select(*[F.col(c).cast("string") for c in read.columns]))


_RULE = "chr(10) || chr(10) || repeat('-', 80) || chr(10) || chr(10)"


@query("text_chunks", f"""SELECT 'jobs_' || lpad(CAST(chunk + 1 AS VARCHAR), CAST(greatest(4, length(CAST(chunk + 1 AS VARCHAR))) AS INT), '0') || '.txt' AS chunk_file, string_agg('Job ' || number || chr(10) || 'Title:       ' || title || chr(10)
  || 'Institution: ' || institution || chr(10) || 'Location:    ' || location || chr(10) || 'Source:      ' || source || chr(10) || 'Posted:      ' || date_posted || chr(10)
  || 'URL:         ' || url || chr(10) || 'Description:' || chr(10) || CASE WHEN description = '' THEN '(fetch from URL)' ELSE description END || {_RULE}, '' ORDER BY number) AS value
FROM (SELECT *, i // 5 AS chunk, i % 5 + 1 AS number FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM ({POSTINGS_DOCS_SQL}))) GROUP BY chunk""")
def text_chunks(spark, sf):
    return writers.text_chunks(postings_docs(spark, sf), ["seq"], rows=5)


_COMPANY_SQL = f"""SELECT seq, title, institution, location, url, source, date_posted, description, 'https://careers.example.com/' || seq AS career_page,
  CASE WHEN seq % 2 = 0 THEN 'lever' ELSE 'generic' END AS ats_platform, scraped_at FROM ({POSTINGS_DOCS_SQL})"""


def company_postings(spark, sf):
    seq = F.col("seq")
    return postings_docs(spark, sf).withColumn("career_page", F.concat(F.lit("https://careers.example.com/"), seq)).withColumn(
        "ats_platform", F.when(seq % 2 == 0, "lever").otherwise("generic"))


@query("company_csv", f"SELECT {', '.join(COMPANY_FIELDS)} FROM ({_COMPANY_SQL})")
def company_csv(spark, sf):
    path = scratch_path(spark, "company-csv")
    writers.write_company_csv(company_postings(spark, sf), path)
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').fillna("")


@query("company_chunks", f"""SELECT 'jobs_' || lpad(CAST(chunk + 1 AS VARCHAR), CAST(greatest(4, length(CAST(chunk + 1 AS VARCHAR))) AS INT), '0') || '.txt' AS chunk_file, string_agg('Job ' || number || chr(10) || 'Title:       ' || title || chr(10)
  || 'Institution: ' || institution || chr(10) || 'Location:    ' || location || chr(10) || 'Source:      ' || source || chr(10) || 'Posted:      ' || date_posted || chr(10)
  || 'Career Page: ' || career_page || chr(10) || 'ATS:         ' || ats_platform || chr(10) || 'URL:         ' || url || chr(10) || 'Description:' || chr(10) || CASE WHEN description = '' THEN '(no description)' ELSE description END || {_RULE}, '' ORDER BY number) AS value
FROM (SELECT *, i // 50 AS chunk, i % 50 + 1 AS number FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM ({_COMPANY_SQL}))) GROUP BY chunk""")
def company_chunks(spark, sf):
    """Chunk files as written and read back."""
    path = scratch_path(spark, "company-chunks")
    writers.write_text_chunks(company_postings(spark, sf), path, ["seq"], rows=50, company=True)
    return spark.read.text(path, wholetext=True).select("chunk_file", "value")


@query("download_csv", f"SELECT coalesce(title, '') AS title, coalesce(source, '') AS source FROM ({POSTINGS_DOCS_SQL})")
def download_csv(spark, sf):
    """The whole table as a user downloads it."""
    path = scratch_path(spark, "download")
    writers.write_csv(postings_docs(spark, sf).select("title", "source"), path)
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').fillna("")


@query("keyword_file_out", "SELECT DISTINCT p_name || ' ' || p_type AS keyword FROM part")
def keyword_file_out(spark, sf):
    path = scratch_path(spark, "keywords-out")
    words = table(spark, sf, "part").select(F.array(F.concat_ws(" ", "p_name", "p_type")).alias("keywords"))
    writers.write_keywords(words, path)
    return spark.read.text(path).select(F.col("value").alias("keyword")).distinct()


@query("report_file", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)}
SELECT 'totals' AS part, '' AS name, (SELECT count(*) FROM mail) AS a, (SELECT count(*) FROM ev_count) AS b, (SELECT count(*) FROM mail) - (SELECT count(DISTINCT seq) FROM cand) AS c
UNION ALL SELECT 'company', company, count, 0, 0 FROM ev_count
UNION ALL SELECT 'unmatched', '', seq, length(row), 0 FROM mail WHERE seq NOT IN (SELECT seq FROM cand)""")
def report_file(spark, sf):
    """The mailbox report as written: totals, companies, unmatched rows."""
    path = scratch_path(spark, "mailbox-run")
    searches.save_mailbox(searches.mailbox_registry(mail_rows(spark, sf)), path)
    zero = F.lit(0).cast("long")
    totals = spark.read.json(f"{path}/report/totals").select(
        F.lit("totals").alias("part"), F.lit("").alias("name"), F.col("rows_processed").alias("a"), F.col("unique_companies").alias("b"),
        F.col("unmatched_count").alias("c"))
    companies = spark.read.json(f"{path}/report/companies").select(
        F.lit("company").alias("part"), F.col("company").alias("name"), F.col("count").alias("a"), zero.alias("b"), zero.alias("c"))
    unmatched = spark.read.json(f"{path}/report/unmatched").select(
        F.lit("unmatched").alias("part"), F.lit("").alias("name"), F.col("seq").alias("a"), F.length("row").cast("long").alias("b"), zero.alias("c"))
    return totals.unionByName(companies).unionByName(unmatched)


@query("empty_split", f"SELECT seq, url, has FROM (SELECT seq, url, seq % 9 <> 0 AS has FROM ({POSTINGS_DOCS_SQL})) WHERE has OR url <> ''")
def empty_split(spark, sf):
    rows = postings_docs(spark, sf).withColumn("description", F.when(F.col("seq") % 9 == 0, " \n").otherwise(F.col("description")))
    full, empty = filters.split_empty_descriptions(rows.withColumn("url", F.concat_ws(" ", "seq", "url")))
    both = full.select("url", F.lit(True).alias("has")).unionByName(empty.withColumn("has", F.lit(False)))
    return both.select(F.substring_index("url", " ", 1).cast("long").alias("seq"), F.substring_index("url", " ", -1).alias("url"), "has")


@query("registry_csv", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)}
SELECT company, CAST(count AS VARCHAR) AS count, {N.joined('ev_vals', 'company', 'hint')} AS ats_hints, {N.joined('ev_vals', 'company', 'domain')} AS company_domains,
  {N.joined('ev_vals', 'company', 'sender')} AS sender_domains, {N.joined('ev_vals', 'company', 'email')} AS sender_emails FROM ev_count b""")
def registry_csv(spark, sf):
    path = scratch_path(spark, "registry")
    writers.write_registry(registry_raw(spark, sf)[0], path)
    return spark.read.csv(f"{path}/csv", header=True, escape='"').fillna("")


@query("registry_json", f"WITH {N.evidence_ctes(MAIL_ROWS_SQL)} SELECT company, count, {N.joined('ev_vals', 'company', 'hint')} AS ats_hints FROM ev_count b")
def registry_json(spark, sf):
    path = scratch_path(spark, "registry")
    writers.write_registry(registry_raw(spark, sf)[0], path)
    return files.read_registry(spark, f"{path}/json").select("company", "count", F.array_join("ats_hints", ";").alias("ats_hints"))


@query("unmatched_file", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)}
SELECT row FROM mail WHERE seq NOT IN (SELECT seq FROM cand)""")
def unmatched_file(spark, sf):
    path = scratch_path(spark, "unmatched")
    writers.write_unmatched(evidence.unmatched_rows(evidence.match_rows(mail_rows(spark, sf))), path)
    return spark.read.option("lineSep", "\n---\n").text(path).withColumnRenamed("value", "row")


@query("text_lines", f"SELECT {S.strip('line')} AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {S.strip('line')} <> ''")
def text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    writers.write_lines(table(spark, sf, "documents").select("text"), path)
    return files.read_lines(spark, path).select("line")


@query("mailbox_rows", f"SELECT row FROM ({MAIL_ROWS_SQL})")
def mailbox_rows(spark, sf):
    path = scratch_path(spark, "mailbox")
    element = F.expr("substring(to_json(array(row)), 2, length(to_json(array(row))) - 2)")
    # one array per line, with elements that are not strings in between
    writers.write_lines(mail_rows(spark, sf).select(F.concat(F.lit("[7, "), element, F.lit(', {"a": 1}],'))), path)
    return files.read_mailbox(spark, path, arrays=True).select("row")


@query("mailbox_array", f"SELECT row FROM ({MAIL_ROWS_SQL})")
def mailbox_array(spark, sf):
    """One pretty-printed array, with a nested list and an object of strings after each row."""
    path = scratch_path(spark, "mailbox")
    element = F.expr("substring(to_json(array(row)), 2, length(to_json(array(row))) - 2)")
    rows = mail_rows(spark, sf).select(
        F.concat(F.lit("  "), element, F.lit(',\n  ["b", "[c"],\n  {\n    "k": "x",\n    "l": ["y",\n "z"]\n  },\n  7,')).alias("line"), F.col("seq").alias("at"))
    ends = spark.createDataFrame([("[", -1), ("  null\n]", 1 << 60)], "line string, at long")
    writers.write_lines(rows.unionByName(ends).repartitionByRange("at").sortWithinPartitions("at").select("line"), path)
    return files.read_mailbox(spark, path).select("row")


@query("keyword_file", """SELECT DISTINCT lower(p_name) AS keyword FROM part""")
def keyword_file(spark, sf):
    path = scratch_path(spark, "keywords")
    names = table(spark, sf, "part").select("p_name", F.lit("k").alias("k")).distinct()
    writers.write_lines(names.select(F.concat(F.col("p_name"), F.lit(" # kept"))), path)
    return files.read_keywords(spark, path).select(F.lower("keyword").alias("keyword"))


@query("profile_files", "SELECT page_id, coalesce(html, '') AS text FROM pages")
def profile_files(spark, sf):
    """A profile file per page, its whole source as text: each upload is a file of its own."""
    path = scratch_path(spark, "profiles")
    writers.write_text_per(table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("value")), "page_id", path)
    read = files.read_profiles(spark, path)
    number = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
    # the writer ends a file with one line end of its own
    return read.select(number.alias("page_id"), F.substring("text", F.lit(1), F.length("text") - 1).alias("text"))
