"""Predicates, filters and keyword lists over the given tables."""

from pyspark.sql import functions as F

from jobflow import rules
from jobflow.fixtures import (
    AS_OF, AS_OF_ISO, KEYWORDS, POSTINGS_DOCS_SQL, SIGNALS, postings_docs, table,
)
from jobflow.functions import names, text, urls
from jobflow.operators import filters, keywords
from jobflow.plans import sql as S
from jobflow.plans.catalog import query

CUTOFF = f"(TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)"
_PHRASES = [*rules.RESTRICTION_PHRASES, "license", "worthless", "copyright"]


def restricted_sql(phrases):
    return S.contains_any("lower(title || ' ' || description)", phrases)


def broad_date(x="date_posted"):
    return S.posted_date(x, AS_OF, False)


def company_date(x="date_posted"):
    return S.posted_date(x, AS_OF, True)


def _key(term):
    return filters._key(term)


def match_sql(title, description, kws, strong=(), support=()):
    phrases = [k for k in map(_key, [*kws, *strong]) if k]
    words = [k for k in map(_key, support) if k]
    both = S.norm_key(f"({title} || ' ' || {description})")
    hit = S.contains_any(both, phrases) if phrases else "FALSE"
    if not words:
        return f"({hit})"

    def count(x):
        return "(" + " + ".join(f"CAST(contains({S.norm_key(x)}, {S.q(w)}) AS INT)" for w in words) + ")"

    return f"({hit} OR ({count(title)} >= 1 AND {count(description)} >= 2))"


def title_ok(x):
    t = f"lower({S.squash(x)})"
    starts, words = "|".join(rules.NON_JOB_TITLE_STARTS), "|".join(rules.NON_TARGET_TITLE_WORDS)
    bound = r"(?:[^\p{L}\p{N}_]|$)"
    before = r"(?:^|[^\p{L}\p{N}_])"
    return (
        f"({t} <> '' AND NOT regexp_matches({t}, {S.q(f'^(?:{starts}){bound}')}) AND NOT "
        f"regexp_matches({t}, {S.q(f'{before}(?:{words}){bound}')}) AND {S.contains_any(t, rules.ROLE_TOKENS)})"
    )


def location_ok(x):
    k = S.norm_key(x)
    tokens = f"string_split({k}, ' ')"
    last = f"{tokens}[-1]"
    return (
        f"CASE WHEN {k} = '' THEN TRUE WHEN contains({k}, 'remote') THEN TRUE "
        f"WHEN contains({k}, 'united states') OR {last} IN ('us', 'usa') THEN TRUE "
        f"WHEN {S.in_list(last, rules.NON_US_COUNTRY_TOKENS)} THEN FALSE "
        f"WHEN contains({x}, ',') AND {S.in_list(last, rules.US_STATE_TOKENS)} THEN TRUE "
        f"ELSE len({tokens}) >= 2 AND {S.in_list(last, rules.US_STATE_TOKENS)} AND NOT "
        f"{S.in_list(f'coalesce({tokens}[-2], {S.q(chr(32))})', rules.NON_US_COUNTRY_TOKENS)} END"
    )


@query("recent_strict", f"SELECT seq, date_posted FROM ({POSTINGS_DOCS_SQL}) WHERE {broad_date()} >= {CUTOFF}")
def recent_strict(spark, sf):
    return filters.filter_recent(postings_docs(spark, sf), AS_OF).select("seq", "date_posted")


@query("recent_lenient", f"""SELECT seq, date_posted FROM ({POSTINGS_DOCS_SQL})
WHERE coalesce({broad_date()} >= {CUTOFF}, TRUE)""")
def recent_lenient(spark, sf):
    return filters.filter_recent(postings_docs(spark, sf), AS_OF, strict=False).select("seq", "date_posted")


@query("recent_company", f"""SELECT o_orderkey FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-06-30' - INTERVAL 30 DAY""")
def recent_company(spark, sf):
    posted = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").where(
        filters.is_recent(posted, "2001-06-30 00:00:00")
    ).select("o_orderkey")


@query("posting_build", f"""
SELECT page_id AS seq, {S.squash("coalesce(nullif(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), ''), '')")} AS title,
  {S.host('url')} AS institution, 'Remote' AS location, {S.clean_url('url')} AS url,
  {S.squash('html')} AS description, 'career/generic' AS source, '' AS date_posted, '{AS_OF_ISO}' AS scraped_at,
  url AS career_page, coalesce({S.board_type('url')}, 'generic') AS ats_platform FROM pages""")
def posting_build(spark, sf):
    pages = table(spark, sf, "pages").withColumn("seq", F.col("page_id"))
    u = F.col("url")
    return filters.build_posting(
        pages, AS_OF_ISO, title=F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), institution=urls.host(u),
        location=F.lit(" Remote\n"), url=u, description=F.col("html"), source=F.lit("career/generic"),
        date_posted=F.lit(None).cast("string"), career_page=u,
        ats_platform=F.coalesce(urls.board_type(u), F.lit("generic")),
    )


@query("blocklist_filter", f"""
SELECT page_id, link FROM (SELECT page_id, 'https://' || CASE page_id % 4 WHEN 0 THEN 'www.LinkedIn.com' WHEN 1
  THEN 'indeed.com' ELSE 'jobs.example.com' END || '/x' || page_id AS link FROM pages)
WHERE NOT {S.contains_any('lower(link)', rules.SEARCH_RESULT_BLOCKLIST)}""")
def blocklist_filter(spark, sf):
    k = F.col("page_id")
    site = F.when(k % 4 == 0, "www.LinkedIn.com").when(k % 4 == 1, "indeed.com").otherwise("jobs.example.com")
    link = F.concat(F.lit("https://"), site, F.lit("/x"), k)
    return table(spark, sf, "pages").select("page_id", link.alias("link")).where(
        ~urls.is_blocked_result(F.col("link"))
    )


@query("restricted_filter", f"""SELECT seq, title FROM ({POSTINGS_DOCS_SQL})
WHERE NOT {restricted_sql(_PHRASES)}""")
def restricted_filter(spark, sf):
    return filters.filter_restricted(postings_docs(spark, sf), _PHRASES).select("seq", "title")


@query("keyword_relevance", f"""SELECT seq, {match_sql('title', 'description', KEYWORDS, (), SIGNALS)} AS relevant
FROM ({POSTINGS_DOCS_SQL})""")
def keyword_relevance(spark, sf):
    return postings_docs(spark, sf).select(
        "seq", filters.keyword_match(F.col("title"), F.col("description"), KEYWORDS, (), SIGNALS).alias("relevant")
    )


_FORM = "p_name || ', ' || p_type || chr(10) || 'The ' || p_type || ' of # ' || p_brand || chr(10) || ' ' || upper(p_name)"


def _form():
    nl = F.lit("\n")
    return F.concat(
        "p_name", F.lit(", "), "p_type", nl, F.lit("The "), "p_type", F.lit(" of # "), "p_brand", nl,
        F.lit(" "), F.upper("p_name"),
    )


def _distinct_ci(x):
    return (
        f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"
    )


def _parse_sql(x, pattern=r"[\n,]"):
    parts = f"regexp_split_to_array({x}, {S.q(pattern)})"
    trimmed = "trim(split_part(p, '#', 1))"
    return f"list_filter(list_transform({parts}, lambda p: {trimmed}), lambda p: p <> '')"


def _signal_sql(cut):
    return f"""
SELECT p_partkey, array_to_string(strong, '|') AS strong,
  array_to_string(list_filter(words, lambda w, i: list_position(words, w) = i){cut}, '|') AS support
FROM (SELECT p_partkey, lines{cut} AS strong, list_filter(flatten(list_transform(lines, lambda p: regexp_split_to_array(p, ' +'))),
    lambda w: length(w) > 2 AND NOT {S.in_list('w', rules.SIGNAL_STOPWORDS)}) AS words
  FROM (SELECT p_partkey, list_transform({_parse_sql(_FORM, chr(92) + 'n')}, lambda p: lower(p)) AS lines FROM part))"""


def _signals(spark, sf, limit=None):
    return table(spark, sf, "part").select(
        "p_partkey", keywords.signal_terms_of(_form(), limit).alias("s")
    ).select(
        "p_partkey", F.array_join("s.strong", "|").alias("strong"), F.array_join("s.support", "|").alias("support")
    )


@query("signal_terms", _signal_sql(""))
def signal_terms(spark, sf):
    return _signals(spark, sf)


@query("signal_terms_limited", _signal_sql("[1:3]"))
def signal_terms_limited(spark, sf):
    return _signals(spark, sf, 3)


@query("job_title_filter", f"SELECT seq, title FROM ({POSTINGS_DOCS_SQL}) WHERE {title_ok('title')}")
def job_title_filter(spark, sf):
    return postings_docs(spark, sf).where(filters.looks_like_job_title(F.col("title"))).select("seq", "title")


@query("location_filter", f"""SELECT seq, location, {location_ok('location')} AS allowed FROM ({POSTINGS_DOCS_SQL})""")
def location_filter(spark, sf):
    return postings_docs(spark, sf).select(
        "seq", "location", filters.location_allowed(F.col("location")).alias("allowed")
    )


_COMPANY_SQL = """(CASE s_suppkey % 8 WHEN 0 THEN s_name WHEN 1 THEN 'Our ' || s_name WHEN 2 THEN 'Engineer'
  WHEN 3 THEN 'Update 2024-01-05 ' || s_name WHEN 4 THEN 'Research Staff' WHEN 5 THEN 'The lab at ' || s_name
  WHEN 6 THEN 'a b c d e f g h ' || s_name ELSE 'Stand!' END)"""


def _supplier_names(spark, sf):
    k = F.col("s_suppkey") % 8
    name = (
        F.when(k == 0, F.col("s_name")).when(k == 1, F.concat(F.lit("Our "), "s_name")).when(k == 2, "Engineer")
        .when(k == 3, F.concat(F.lit("Update 2024-01-05 "), "s_name")).when(k == 4, "Research Staff")
        .when(k == 5, F.concat(F.lit("The lab at "), "s_name"))
        .when(k == 6, F.concat(F.lit("a b c d e f g h "), "s_name")).otherwise("Stand!")
    )
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("company"))


def valid_sql(x):
    low = f"lower({x})"
    return (
        f"({x} <> '' AND NOT regexp_matches({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT "
        f"regexp_matches({low}, {S.q('|'.join(rules.NOISE_NAME_PATTERNS))}) AND NOT {S.in_list(low, rules.BARE_ROLES)} "
        f"AND NOT (regexp_matches({low}, '^(our|the) ') AND NOT contains({low}, ' at ') AND NOT contains({low}, 'laboratory')) "
        f"AND len(regexp_split_to_array({x}, ' +')) <= 8)"
    )


@query("valid_company", f"SELECT s_suppkey, {valid_sql('company')} AS valid FROM (SELECT s_suppkey, {_COMPANY_SQL} AS company FROM supplier)")
def valid_company(spark, sf):
    return _supplier_names(spark, sf).select(
        "s_suppkey", names.is_valid_company_name(F.col("company")).alias("valid")
    )


def generic_role_sql(x):
    k = S.norm_key(x)
    return (
        f"({k} <> '' AND len(list_filter(string_split({k}, ' '), lambda t: NOT "
        f"{S.in_list('t', rules.GENERIC_ROLE_WORDS)})) = 0)"
    )


@query("generic_role", f"SELECT s_suppkey, {generic_role_sql('company')} AS generic FROM (SELECT s_suppkey, {_COMPANY_SQL} AS company FROM supplier)")
def generic_role(spark, sf):
    return _supplier_names(spark, sf).select(
        "s_suppkey", names.is_generic_role_name(F.col("company")).alias("generic")
    )


@query("blocked_anti", f"""SELECT s_suppkey, company FROM (SELECT s_suppkey, {_COMPANY_SQL} AS company FROM supplier)
WHERE NOT {S.in_list(S.norm_key('company'), rules.BLOCKED_COMPANIES)}""")
def blocked_anti(spark, sf):
    return filters.blocked_companies(_supplier_names(spark, sf))


COMPOSITE_SQL = f"""SELECT * FROM ({POSTINGS_DOCS_SQL}) WHERE {title_ok('title')} AND {location_ok('location')}
  AND {match_sql('title', 'description', KEYWORDS, (), SIGNALS)} AND {company_date()} >= {CUTOFF}"""


@query("composite_filter", f"SELECT seq, title, location, date_posted FROM ({COMPOSITE_SQL})")
def composite_filter(spark, sf):
    return filters.filter_postings(postings_docs(spark, sf), AS_OF, KEYWORDS, (), SIGNALS).select(
        "seq", "title", "location", "date_posted"
    )


_TOPIC_KW = "(p_name || CASE p_partkey % 3 WHEN 0 THEN ' scientific' WHEN 1 THEN ' staff scientist' ELSE ' sales' END)"


@query("source_keyword_select", f"""
SELECT p_partkey, keyword, {S.contains_any('keyword', rules.HIGHER_ED_TOPICS)} AS higher_ed
FROM (SELECT p_partkey, {_TOPIC_KW} AS keyword FROM part) WHERE {S.contains_any('keyword', rules.ACADEMIC_TOPICS)}""")
def source_keyword_select(spark, sf):
    k = F.col("p_partkey") % 3
    kw = F.concat("p_name", F.when(k == 0, " scientific").when(k == 1, " staff scientist").otherwise(" sales"))
    df = table(spark, sf, "part").select("p_partkey", kw.alias("keyword"))
    return filters.select_topic_keywords(df, rules.ACADEMIC_TOPICS).withColumn(
        "higher_ed", text.any_contains(F.col("keyword"), rules.HIGHER_ED_TOPICS)
    )


@query("keyword_parse", f"""SELECT p_partkey, array_to_string({_distinct_ci('k')}, '|') AS keywords
FROM (SELECT p_partkey, {_parse_sql(_FORM)} AS k FROM part)""")
def keyword_parse(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(keywords.parse_keywords(_form()), "|").alias("keywords")
    )


@query("keyword_union", f"""SELECT p_partkey, array_to_string({_distinct_ci('k')}, '|') AS keywords,
  array_to_string({_distinct_ci('k')}[1:2], '|') AS queries
FROM (SELECT p_partkey, list_concat({_parse_sql(_FORM)}, ['Brand', upper(p_type), 'Brand']) AS k FROM part)""")
def keyword_union(spark, sf):
    inline = keywords.parse_keywords(F.concat_ws(",", "p_brand", F.upper("p_type"), "p_brand"))
    merged = keywords.merge_keywords(keywords.parse_keywords(_form()), inline)
    return table(spark, sf, "part").select("p_partkey", merged.alias("k")).select(
        "p_partkey", F.array_join("k", "|").alias("keywords"),
        F.array_join(keywords.first_queries(F.col("k"), 2), "|").alias("queries"),
    )


_CROSS_SQL = f"""
SELECT p_partkey, {_distinct_ci('k')} AS keywords FROM (
  SELECT p_partkey, list_concat({_parse_sql(_FORM)}, flatten(list_transform(string_split(p_name, ' '), lambda t:
    list_transform(['fast', p_type, 'FAST', 'Brand'], lambda s: t || ' ' || s)))) AS k FROM part)"""


def _cross(spark, sf):
    titles = F.replace(F.col("p_name"), F.lit(" "), F.lit("\n"))
    skills = F.concat_ws(",", F.lit("fast"), F.col("p_type"), F.lit("FAST"), F.col("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey", keywords.combine_keywords(_form(), titles, skills).alias("keywords")
    )


@query("keyword_cross", f"SELECT p_partkey, array_to_string(keywords, '|') AS keywords FROM ({_CROSS_SQL})")
def keyword_cross(spark, sf):
    return _cross(spark, sf).select("p_partkey", F.array_join("keywords", "|").alias("keywords"))


@query("keyword_preview", f"""SELECT p_partkey, CAST(len(keywords) AS INT) AS total, array_to_string(keywords[1:4], '|') AS chips,
  CAST(greatest(len(keywords) - 4, 0) AS INT) AS more FROM ({_CROSS_SQL})""")
def keyword_preview(spark, sf):
    return keywords.keyword_preview(_cross(spark, sf), shown=4).select(
        "p_partkey", "total", F.array_join("chips", "|").alias("chips"), "more"
    )


# words 2 to 4 of every passage, single words of part types, and runs of one and two letters
_KEYWORD_TABLE_SQL = """SELECT array_to_string(str_split(text, ' ')[2:4], ' ') AS keyword FROM benchmark
  UNION SELECT split_part(p_type, ' ', 2) FROM part UNION SELECT upper(substr(text, 3, 2)) FROM benchmark
  UNION SELECT 'q' UNION SELECT '.' UNION SELECT NULL"""


@query("keyword_join", f"""
WITH k AS (SELECT keyword, {S.norm_key('keyword')} AS key FROM ({_KEYWORD_TABLE_SQL}) WHERE keyword IS NOT NULL),
t AS (SELECT doc_id, {S.norm_key('text')} AS body FROM documents)
SELECT DISTINCT doc_id, keyword FROM t JOIN k ON key <> '' AND contains(body, key)""")
def keyword_join(spark, sf):
    passages = table(spark, sf, "benchmark")
    words = F.split("text", " ", -1)
    table_of = passages.select(F.concat_ws(" ", F.slice(words, 2, 3)).alias("keyword")).union(
        table(spark, sf, "part").select(F.split_part("p_type", F.lit(" "), F.lit(2)))).union(
        passages.select(F.upper(F.substring("text", 3, 2)))).union(
        spark.createDataFrame([("q",), (".",), (None,)], "keyword string"))
    found = keywords.keyword_join(table(spark, sf, "documents", "doc_id"), table_of, "doc_id")
    return found.withColumnRenamed("row", "doc_id")
