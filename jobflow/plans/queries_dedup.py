"""Deduplication and entity merge over posting rows derived from the given tables."""

from pyspark.sql import functions as F

from jobflow.fixtures import POSTINGS_DOCS_SQL, postings_docs, table
from jobflow.functions import html, urls
from jobflow.operators import dedup
from jobflow.plans import sql as S
from jobflow.plans.catalog import query

_ID_SQL = " || '|' || ".join(S.norm_text(f) for f in ("title", "institution", "location"))


@query("identity_keys", f"""
SELECT seq, {_ID_SQL} AS identity, {S.normalize_url('url')} AS url_key,
  CASE WHEN trim(description) <> '' THEN 1 ELSE 0 END * 1000000 + CASE WHEN trim(date_posted) <> '' THEN 1 ELSE 0 END * 100000
  + length(trim(url)) AS quality FROM ({POSTINGS_DOCS_SQL})""")
def identity_keys(spark, sf):
    q = dedup.row_quality(F.col("description"), F.col("date_posted"), F.col("url"))
    return postings_docs(spark, sf).select(
        "seq", dedup.identity_key(F.col("title"), F.col("institution"), F.col("location")).alias("identity"),
        urls.normalize_url(F.col("url")).alias("url_key"),
        (q["has_description"] * 1000000 + q["has_date"] * 100000 + q["url_length"]).cast("long").alias("quality"),
    )


def two_pass_sql(source):
    key = f"{S.norm_key('title')} AS t, {S.norm_key('institution')} AS i, {S.norm_key('location')} AS l"
    score = "length(description) AS n, CASE WHEN date_posted <> '' THEN 1 ELSE 0 END AS d, CASE WHEN url <> '' THEN 1 ELSE 0 END AS k"
    return f"""
SELECT p.*, w.order_seq FROM ({source}) p JOIN (
  SELECT seq, order_seq FROM (SELECT seq, row_number() OVER (PARTITION BY t, i, l ORDER BY n DESC, d DESC, k DESC, gs) AS rn,
      min(gs) OVER (PARTITION BY t, i, l) AS order_seq
    FROM (SELECT *, row_number() OVER (PARTITION BY t, i, l, u ORDER BY n DESC, d DESC, k DESC, seq) AS rn1,
        min(seq) OVER (PARTITION BY t, i, l, u) AS gs
      FROM (SELECT seq, {key}, {S.clean_url('url')} AS u, {score} FROM ({source}))) WHERE rn1 = 1) WHERE rn = 1) w
ON p.seq = w.seq"""


@query("dedup_two_pass", f"""SELECT seq, title, institution, location, url, description, date_posted, order_seq
FROM ({two_pass_sql(POSTINGS_DOCS_SQL)})""")
def dedup_two_pass(spark, sf):
    return dedup.dedupe_two_pass(postings_docs(spark, sf)).select(
        "seq", "title", "institution", "location", "url", "description", "date_posted", "order_seq"
    )


@query("dedup_first_href", """
SELECT page_id, scope, href FROM (SELECT page_id, scope, href, row_number() OVER (PARTITION BY scope, href ORDER BY page_id, pos) AS rn
  FROM (SELECT page_id, regexp_extract(html, 'lang="([a-z]*)"', 1) AS scope,
    unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages))
WHERE rn = 1""")
def dedup_first_href(spark, sf):
    anchors = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("scope"),
        F.explode(html.parse_page(F.col("html"), "anchors")["anchors"]).alias("a"),
    ).select("page_id", "scope", "a.href")
    return dedup.first_per_key(anchors, ["scope", "href"], "page_id")


@query("distinct_boards", f"""
SELECT DISTINCT s_nationkey AS company, {S.clean_url("('https://jobs.lever.co/acme' || (s_suppkey % 7) || '/?x=' || s_suppkey)")} AS board_url
FROM supplier""")
def distinct_boards(spark, sf):
    url = F.concat(F.lit("https://jobs.lever.co/acme"), F.col("s_suppkey") % 7, F.lit("/?x="), "s_suppkey")
    return dedup.distinct_boards(
        table(spark, sf, "supplier").select(F.col("s_nationkey").alias("company"), url.alias("board_url"))
    )


# One row at a time, as the rule is stated: the state after row i holds the url index, the identity
# index and the entities so far. Blank-only fields of the sample postings stay out of the state.
_STATE = "seq BIGINT, title VARCHAR, institution VARCHAR, location VARCHAR, tk VARCHAR, ik VARCHAR, lk VARCHAR, date VARCHAR, url VARCHAR, uk VARCHAR, dseq BIGINT, source VARCHAR"
def merged_sql(source):
    return f"""
WITH RECURSIVE f AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY seq) AS i, seq, title, institution, location, {S.norm_text('title')} AS tk, {S.norm_text('institution')} AS ik,
    {S.norm_text('location')} AS lk, date_posted AS date, url, {S.normalize_url('url')} AS uk, source FROM ({source})),
st AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS urls, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS ids, CAST([] AS STRUCT({_STATE})[]) AS ents
  UNION ALL
  SELECT i, map_concat(urls, MAP {{ne.uk: k}}), map_concat(ids, MAP {{ne.tk || '|' || ne.ik || '|' || ne.lk: k}}),
    CASE WHEN e IS NULL THEN list_append(ents, ne) ELSE list_concat(list_concat(ents[:k - 1], [ne]), ents[k + 1:]) END
  FROM (SELECT *, CAST(CASE WHEN e IS NULL THEN row(seq, title, institution, location, tk, ik, lk, date, url, uk, seq, source)
      ELSE row(e.seq, CASE WHEN e.title = '' THEN title ELSE e.title END, e.institution, CASE WHEN e.location = '' THEN location ELSE e.location END,
        CASE WHEN e.title = '' THEN tk ELSE e.tk END, e.ik, CASE WHEN e.location = '' THEN lk ELSE e.lk END,
        CASE WHEN date <> '' AND (e.date = '' OR better) THEN date ELSE e.date END, CASE WHEN better THEN url ELSE e.url END,
        CASE WHEN better THEN uk ELSE e.uk END, CASE WHEN better THEN seq ELSE e.dseq END, CASE WHEN better THEN source ELSE e.source END) END AS STRUCT({_STATE})) AS ne
    FROM (SELECT *, (date <> '') > (e.date <> '') OR ((date <> '') = (e.date <> '') AND length(url) > length(e.url)) AS better
      FROM (SELECT *, CASE WHEN k <= len(ents) THEN ents[k] END AS e FROM (
        SELECT f.*, st.urls, st.ids, st.ents, coalesce(st.urls[f.uk], st.ids[f.tk || '|' || f.ik || '|' || f.lk], len(st.ents) + 1) AS k
        FROM st JOIN f ON f.i = st.i + 1)))))
SELECT e.seq, e.title, e.institution, e.location, e.url, d.description, e.source, e.date AS date_posted
FROM (SELECT unnest(ents) AS e FROM st WHERE i = (SELECT count(*) FROM f)) JOIN ({source}) d ON d.seq = e.dseq"""


MERGED_SQL = merged_sql(POSTINGS_DOCS_SQL)


@query("dedup_entities", MERGED_SQL)
def dedup_entities(spark, sf):
    return dedup.merge_entities(postings_docs(spark, sf)).select(
        "seq", "title", "institution", "location", "url", "description", "source", "date_posted"
    )


def _folded(fields, replaced):
    """Columns of one fold step: the entity ``e`` meets the row ``r``."""
    blank = "coalesce(trim({}), '') = ''"
    out = []
    for f in fields:
        take = f"{blank.format('e.' + f)} OR better" if f in replaced else blank.format("e." + f)
        out.append(f"CASE WHEN NOT {blank.format('r.' + f)} AND ({take}) THEN r.{f} ELSE e.{f} END AS {f}")
    return ", ".join(out)


_FIELDS = ["title", "institution", "location", "url", "description", "source", "date_posted"]
_RANK = "row(coalesce(trim({0}.description), '') <> '', coalesce(trim({0}.date_posted), '') <> '', length(coalesce(trim({0}.url), '')))"
# Components by following shared keys to every row reachable, then one row per step and component.
COMPONENT_SQL = f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT seq, {", ".join(_FIELDS)}, {_ID_SQL} AS ik, {S.normalize_url('url')} AS uk FROM ({POSTINGS_DOCS_SQL})),
k AS MATERIALIZED (SELECT seq, 'i' || ik AS key FROM f UNION ALL SELECT seq, 'u' || uk FROM f WHERE uk <> ''),
reach AS (SELECT seq, seq AS seen FROM f UNION
  SELECT r.seq, b.seq FROM reach r JOIN k a ON a.seq = r.seen JOIN k b ON b.key = a.key),
comp AS MATERIALIZED (SELECT f.*, c, row_number() OVER (PARTITION BY c ORDER BY f.seq) AS n
  FROM f JOIN (SELECT seq, min(seen) AS c FROM reach GROUP BY seq) USING (seq)),
st AS (SELECT c, n, {", ".join(_FIELDS)} FROM comp WHERE n = 1 UNION ALL
  SELECT c, n, {", ".join(_FIELDS)} FROM (SELECT e.c, r.n, {_RANK.format("r")} > {_RANK.format("e")} AS better,
    {_folded(_FIELDS, dedup.REPLACED_FIELDS)} FROM st e JOIN comp r ON r.c = e.c AND r.n = e.n + 1))
SELECT c AS seq, {", ".join(_FIELDS)} FROM st QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC) = 1"""


@query("component_entities", COMPONENT_SQL)
def component_entities(spark, sf):
    return dedup.merge_entities(postings_docs(spark, sf), mode="component").select("seq", *_FIELDS)
