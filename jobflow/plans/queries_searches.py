"""Whole runs: broad search, company search, mailbox registry, scoring."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from jobflow.fixtures import AS_OF, AS_OF_ISO, KEYWORDS, MAIL_ROWS_SQL, POSTINGS_DOCS_SQL, SIGNALS, mail_rows, postings_docs
from jobflow.functions import urls
from jobflow.operators import dedup, discovery, metrics, registry
from jobflow.plans import name_sql as N
from jobflow.plans import searches
from jobflow.plans.catalog import query
from jobflow.plans.queries_dedup import MERGED_SQL, merged_sql, two_pass_sql
from jobflow.plans.queries_filters import COMPOSITE_SQL, CUTOFF, broad_date, restricted_sql
from jobflow.plans.queries_registry import registry_resolved, site_pages
from jobflow.plans.queries_scoring import _SCORED, _texts
from jobflow.plans.queries_sources import search_results
from jobflow.session import cut_lineage, scratch_path
from jobflow.sources import files, landed

FLAGSHIP_SQL = f"SELECT institution, count(*) AS jobs FROM ({two_pass_sql(COMPOSITE_SQL)}) GROUP BY institution"


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Filtered and deduplicated company postings per institution."""
    kept = searches.company_results(postings_docs(spark, sf), AS_OF, KEYWORDS, (), SIGNALS)
    return kept.groupBy("institution").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), "institution")


@query("company_results", f"SELECT seq, title, institution, location, url, order_seq FROM ({two_pass_sql(COMPOSITE_SQL)})")
def company_results(spark, sf):
    kept = searches.company_results(postings_docs(spark, sf), AS_OF, KEYWORDS, (), SIGNALS)
    return dedup.in_result_order(kept).select("seq", "title", "institution", "location", "url", "order_seq")


@query("broad_results", f"""SELECT source, count(*) AS count FROM ({MERGED_SQL})
WHERE {broad_date()} >= {CUTOFF} AND NOT {restricted_sql(['license', 'worthless'])} GROUP BY source""")
def broad_results(spark, sf):
    result = searches.broad_search(postings_docs(spark, sf), AS_OF, phrases=["license", "worthless"])
    return metrics.source_counts(result.clean)


@query("sequenced_sources", f"""SELECT row_number() OVER (ORDER BY k, s) - 1 AS seq, source FROM (
  SELECT 0 AS k, event_id AS s, 'jobspy/board' || (user_id % 5) AS source FROM events UNION ALL SELECT 1, seq, source FROM ({POSTINGS_DOCS_SQL}))""")
def sequenced_sources(spark, sf):
    boards = landed.board_search(search_results(spark, sf), AS_OF_ISO)
    return searches.sequence_sources([boards, postings_docs(spark, sf)]).select("seq", "source")


_PARTS = " UNION ALL ".join(
    f"SELECT {k} AS k, seq, title, institution, location, url, description, source, date_posted, scraped_at FROM ({POSTINGS_DOCS_SQL}) WHERE seq % 3 = {k}"
    for k in range(3)
)
_RUN_SQL = f"SELECT row_number() OVER (ORDER BY k, seq) - 1 AS seq, title, institution, location, url, description, source, date_posted, scraped_at FROM ({_PARTS})"
_RUN_PHRASES = ["license", "worthless"]


@query("broad_run", f"""WITH raw AS MATERIALIZED ({_RUN_SQL}), merged AS MATERIALIZED ({merged_sql('raw')}),
recent AS (SELECT * FROM merged WHERE {broad_date()} >= {CUTOFF}), clean AS (SELECT * FROM recent WHERE NOT {restricted_sql(_RUN_PHRASES)})
SELECT 'source' AS part, source AS name, count(*) AS n FROM raw GROUP BY source
UNION ALL SELECT 'stage', 'raw', count(*) FROM raw UNION ALL SELECT 'stage', 'merged', count(*) FROM merged
UNION ALL SELECT 'stage', 'recent', count(*) FROM recent UNION ALL SELECT 'stage', 'clean', count(*) FROM clean
UNION ALL SELECT 'saved', 'csv', count(*) FROM clean WHERE trim(coalesce(description, '')) <> ''
UNION ALL SELECT 'saved', 'empty_urls', count(*) FROM clean WHERE trim(coalesce(description, '')) = ''""")
def broad_run(spark, sf):
    """All postings, landed as three sources, to saved files: postings per source, rows after each stage, rows read back."""
    docs = postings_docs(spark, sf)
    run = searches.broad_run([docs.where(f"seq % 3 = {k}") for k in range(3)], AS_OF, phrases=_RUN_PHRASES)
    path = scratch_path(spark, "broad-run")
    searches.save_broad(run.result.clean, path, skip_empty=True)
    saved = {"csv": files.read_results(spark, f"{path}/csv"), "empty_urls": spark.read.text(f"{path}/empty_urls")}
    parts = [
        run.sources.select(F.lit("source").alias("part"), F.col("source").alias("name"), F.col("count").alias("n")),
        run.funnel.select(F.lit("stage").alias("part"), F.col("stage").alias("name"), F.col("rows").alias("n")),
        *[df.agg(F.count("*").alias("n")).select(F.lit("saved").alias("part"), F.lit(name).alias("name"), "n") for name, df in saved.items()],
    ]
    return reduce(DataFrame.unionByName, parts)


@query("company_search")
def company_search(spark, sf):
    """Landed answers for every generated board, and a job page on every guessed domain."""
    raw, rows, resolved = registry_resolved(spark, sf)
    records = cut_lineage(registry.merge_registry(raw, resolved))
    boards = records.select("company", F.explode(discovery.board_url_candidates()).alias("board_url"))
    job = F.struct(
        F.concat(F.lit("Research Analyst at "), "company").alias("title"), F.lit("we say thank you").alias("content"),
        F.lit("2024-01-20").alias("updated_at"), F.concat("board_url", F.lit("/1")).alias("absolute_url"),
    )
    answers = boards.where(urls.board_type(F.col("board_url")) == "greenhouse").select(
        "board_url", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("json")
    ).distinct()
    job_pages = records.select(F.explode(discovery.domain_guesses()).alias("d")).distinct().select(
        F.concat(F.lit("https://"), "d", F.lit("/jobs/1")).alias("url"),
        F.lit("<h1>Data Scientist</h1><p>Posted on 2024-01-22</p>").alias("html"),
    )
    found = searches.company_search(
        raw, rows, {"greenhouse": answers}, site_pages(spark, sf, records).unionByName(job_pages), AS_OF_ISO, AS_OF,
        KEYWORDS, (), SIGNALS,
    )
    return found.deduped.select("institution", "title", "url", "date_posted", "ats_platform")


@query("mailbox_registry", f"""WITH {N.evidence_ctes(MAIL_ROWS_SQL)} SELECT company, count, {N.joined('ev_vals', 'company', 'email')} AS sender_emails FROM ev_count b""")
def mailbox_registry(spark, sf):
    found = searches.mailbox_registry(mail_rows(spark, sf))
    return found.ranked.select("company", "count", F.array_join("sender_emails", ";").alias("sender_emails"))


@query("scored_postings", f"SELECT seq, ai_score, ai_reason FROM ({_SCORED})")
def scored_postings(spark, sf):
    replies = _texts(spark, sf).select("batch_id", "text")
    return searches.score_postings(postings_docs(spark, sf), replies, None).select("seq", "ai_score", "ai_reason")
