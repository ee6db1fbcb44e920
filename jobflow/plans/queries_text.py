"""Scalar functions over the given tables."""

from pyspark.sql import functions as F

from jobflow import rules
from jobflow.fixtures import AS_OF, POSTINGS_DOCS_SQL, postings_docs, table
from jobflow.functions import dates, text, urls
from jobflow.operators import keywords
from jobflow.plans import sql as S
from jobflow.plans.catalog import query

_PAGE_SITES = [
    "https://jobs.lever.co", "https://boards.greenhouse.io", "https://acme.wd5.myworkdayjobs.com",
    "https://careers-acme.icims.com", "https://acme.example.com",
]
_PAGE_TAILS = [
    "/en-US/Careers/job/Austin/{}", "/careers/", "/positions/{}/details/9;v=2", "/file{}.PDF",
    "/de/Site{}/jobs?q=1&UTM_x=2&k", "//search//?ref=a&source=b#f", "",
]


def job_urls(spark, sf):
    """Board-like urls: one per page, site and tail chosen by the page's id and text length."""
    k, n = F.col("page_id"), F.length("html")
    site = F.element_at(text.literal_array(_PAGE_SITES), (k % 5 + 1).cast("int"))
    tail = F.element_at(text.literal_array(_PAGE_TAILS), (n % 7 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        k.alias("page_id"), F.concat(site, F.replace(tail, F.lit("{}"), k.cast("string"))).alias("url")
    )


JOB_URLS_SQL = f"""
SELECT page_id, {S.items(_PAGE_SITES)}[page_id % 5 + 1]
  || replace({S.items(_PAGE_TAILS)}[length(html) % 7 + 1], '{{}}', CAST(page_id AS VARCHAR)) AS url
FROM pages
"""
_ALL_URLS_SQL = f"SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, url FROM ({JOB_URLS_SQL})"


def _all_urls(spark, sf):
    jobs = job_urls(spark, sf)
    return table(spark, sf, "pages").select("page_id", "url").unionByName(
        jobs.withColumn("page_id", F.col("page_id") + 1000000000)
    )


@query("url_normalize", f"SELECT page_id, {S.normalize_url('url')} AS url_key FROM ({_ALL_URLS_SQL})")
def url_normalize(spark, sf):
    return _all_urls(spark, sf).select("page_id", urls.normalize_url(F.col("url")).alias("url_key"))


@query("url_clean", f"SELECT page_id, {S.clean_url('url')} AS url FROM ({_ALL_URLS_SQL})")
def url_clean(spark, sf):
    return _all_urls(spark, sf).select("page_id", urls.clean_url(F.col("url")).alias("url"))


@query("board_type_rules", f"SELECT page_id, {S.board_type('url')} AS board_type FROM ({_ALL_URLS_SQL})")
def board_type_rules(spark, sf):
    ladder = [(i, part, name) for i, (name, parts) in enumerate(rules.BOARD_HOSTS.items()) for part in parts]
    ladder = spark.createDataFrame(ladder, "priority int, fragment string, value string")
    hosts = _all_urls(spark, sf).select("page_id", urls.host(F.col("url")).alias("host"))
    found = keywords.first_rule(hosts, ladder, "page_id", "host")
    return found.select(F.col("row").alias("page_id"), F.col("value").alias("board_type"))


@query("url_classify", f"""
SELECT page_id, {S.board_type('url')} AS board_type, {S.is_asset('url')} AS is_asset,
  {S.is_useful('url')} AS is_useful, {S.is_job_detail('url')} AS is_detail,
  {S.contains_any('lower(url)', rules.SEARCH_RESULT_BLOCKLIST)} AS is_blocked
FROM ({_ALL_URLS_SQL})""")
def url_classify(spark, sf):
    u = F.col("url")
    return _all_urls(spark, sf).select(
        "page_id", urls.board_type(u).alias("board_type"), urls.is_asset_url(u).alias("is_asset"),
        urls.is_useful_url(u).alias("is_useful"), urls.is_job_detail_url(u).alias("is_detail"),
        urls.is_blocked_result(u).alias("is_blocked"),
    )


_LINKS = ["/a/b", "https://x.example.org/q?z=1", "//cdn.example.net/p", "#part", "?page=3", "", "mailto:a@b.co"]


@query("url_join", f"""
SELECT page_id, CASE WHEN link = '' THEN url
  WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
  WHEN starts_with(link, '//') THEN lower(split_part(url, ':', 1)) || ':' || link
  WHEN starts_with(link, '#') THEN split_part(url, '#', 1) || link
  WHEN starts_with(link, '?') THEN split_part(split_part(url, '#', 1), '?', 1) || link
  ELSE {S.origin('url')} || link END AS absolute
FROM (SELECT page_id, url, {S.items(_LINKS)}[length(html) % 7 + 1] AS link FROM pages)""")
def url_join(spark, sf):
    link = F.element_at(text.literal_array(_LINKS), (F.length("html") % 7 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", urls.join_url(F.col("url"), link).alias("absolute")
    )


@query("workday_api_urls", f"""
WITH p AS (SELECT page_id, {S.origin('url')} AS origin,
    list_filter(string_split({S.url_part('url', 3)}, '/'), lambda x: x <> '') AS seg FROM ({_ALL_URLS_SQL})),
c AS (SELECT page_id, origin, CASE WHEN list_contains(seg, 'job') THEN seg[1:list_position(seg, 'job') - 1]
    ELSE seg END AS seg FROM p),
v AS (SELECT page_id, origin, seg FROM c
    UNION SELECT page_id, origin, seg[2:] FROM c WHERE regexp_matches(seg[1], '^[a-z]{{2}}(-[A-Z]{{2}})?$'))
SELECT page_id, origin || '/wday/cxs/' || array_to_string(seg, '/') || '/jobs' AS api_url
FROM v WHERE len(seg) > 0""")
def workday_api_urls(spark, sf):
    return _all_urls(spark, sf).select(
        "page_id", F.explode(urls.workday_api_urls(F.col("url"))).alias("api_url")
    )


@query("domain_root", f"""
SELECT page_id, {S.root_domain(S.host('url'))} AS root, {S.root_domain("'shop.' || " + S.host('url') + " || '.co.uk'")} AS uk_root
FROM ({_ALL_URLS_SQL})""")
def domain_root(spark, sf):
    h = urls.host(F.col("url"))
    uk = F.concat(F.lit("shop."), h, F.lit(".co.uk"))
    return _all_urls(spark, sf).select(
        "page_id", text.registrable_domain(h).alias("root"), text.registrable_domain(uk).alias("uk_root")
    )


@query("text_keys", f"SELECT doc_id, {S.norm_text('text')} AS text_key, {S.norm_key('text')} AS plain_key FROM documents")
def text_keys(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.normalize_text(t).alias("text_key"), text.normalize_key(t).alias("plain_key")
    )


@query("text_slug", f"""
SELECT c_custkey, {S.slugify("c_name || ' & ' || c_mktsegment")} AS slug,
  {S.slug_words("c_name || ' & ' || c_mktsegment || '!'")} AS slug_words FROM customer""")
def text_slug(spark, sf):
    name = F.concat("c_name", F.lit(" & "), "c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", text.slugify(name).alias("slug"),
        text.slug_words(F.concat(name, F.lit("!"))).alias("slug_words"),
    )


@query("text_squash", f"SELECT doc_id, {S.squash('text')} AS squashed FROM documents")
def text_squash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.squash(F.col("text")).alias("squashed"))


@query("text_squash_limited", f"SELECT doc_id, substr({S.squash('text')}, 1, 300) AS summary FROM documents")
def text_squash_limited(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.prefix(text.squash(F.col("text")), 300).alias("summary"))


@query("title_case_words", f"SELECT p_partkey, {S.title_words(_NAME := chr(40) + 'p_name || ' + S.q(' of the ') + ' || p_type || ' + S.q(' gm') + chr(41))} AS name FROM part")
def title_case_words(spark, sf):
    name = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(" gm"))
    return table(spark, sf, "part").select("p_partkey", text.title_words(name).alias("name"))


_MAIL_SQL = f"regexp_extract(text, {S.q('(' + S.EMAIL + ')')}, 1)"


@query("email_extract", f"""
SELECT doc_id, nullif(lower({_MAIL_SQL}), '') AS email,
  nullif(split_part(lower({_MAIL_SQL}), '@', 2), '') AS domain FROM documents""")
def email_extract(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.sender_email(t).alias("email"), text.sender_domain(t).alias("domain")
    )


_DOMAIN_PATTERN = r"\b([a-z0-9.-]+\.[a-z]{2,})(?:/[^\s]*)?\b"
_DOMAINS_SQL = (
    f"list_filter(list_transform(regexp_extract_all(lower(row), {S.q(_DOMAIN_PATTERN)}, 1), lambda d: trim(d, '.')), "
    f"lambda d: NOT {S.contains_any('d', rules.VENDOR_DOMAINS)} AND NOT {S.ends_any('d', rules.IMAGE_SUFFIXES)})"
)


@query("domains_extract", f"""
SELECT DISTINCT page_id, domain FROM (SELECT page_id, unnest({_DOMAINS_SQL}) AS domain FROM
  (SELECT page_id, url || ' see LOGO.png, mail.adp.com and www.' || page_id || '.example.co.uk/jobs?x=1 now' AS row FROM pages))""")
def domains_extract(spark, sf):
    row = F.concat(
        "url", F.lit(" see LOGO.png, mail.adp.com and www."), "page_id", F.lit(".example.co.uk/jobs?x=1 now")
    )
    return table(spark, sf, "pages").select(
        "page_id", F.explode(text.company_domains(row)).alias("domain")
    )


def _ats_sql(x):
    names = {}
    for fragment, name in [*rules.ATS_DOMAIN_HINTS.items(), *rules.ATS_KEYWORD_HINTS.items()]:
        names.setdefault(name, []).append(fragment)
    arms = ", ".join(f"CASE WHEN {S.contains_any(x, parts)} THEN {S.q(n)} END" for n, parts in sorted(names.items()))
    return f"array_to_string(list_filter([{arms}], lambda h: h IS NOT NULL), ';')"


@query("ats_hints", f"""
SELECT page_id, {_ats_sql('lower(row)')} AS hints, {S.contains_any(S.host('url'), rules.VENDOR_DOMAINS)} AS vendor
FROM (SELECT p.page_id, u.url, u.url || ' ' || p.html AS row FROM pages p JOIN ({JOB_URLS_SQL}) u USING (page_id))""")
def ats_hints(spark, sf):
    k, n = F.col("page_id"), F.length("html")
    site = F.element_at(text.literal_array(_PAGE_SITES), (k % 5 + 1).cast("int"))
    tail = F.element_at(text.literal_array(_PAGE_TAILS), (n % 7 + 1).cast("int"))
    url = F.concat(site, F.replace(tail, F.lit("{}"), k.cast("string")))
    return table(spark, sf, "pages").select(
        "page_id",
        F.array_join(text.ats_hints(F.concat(url, F.lit(" "), F.col("html"))), ";").alias("hints"),
        text.is_vendor_domain(urls.host(url)).alias("vendor"),
    )


_MAILBOX = "'No.Reply+' || lang || '_x' || (doc_id % 10) || '.' || source || '@mail.' || lang || '.psu.edu'"


@query("sender_tokens", f"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(split_part(email, '@', 1)), '[._+-]+'),
  lambda t: t <> '' AND NOT {S.in_list('t', rules.SENDER_STOP_TOKENS)} AND NOT regexp_matches(t, '^[a-z]\\d+$')), ' ') AS tokens
FROM (SELECT doc_id, {_MAILBOX} AS email FROM documents)""")
def sender_tokens(spark, sf):
    d = F.col("doc_id")
    email = F.concat(
        F.lit("No.Reply+"), "lang", F.lit("_x"), d % 10, F.lit("."), "source", F.lit("@mail."), "lang", F.lit(".psu.edu")
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.sender_local_tokens(email), " ").alias("tokens")
    )


@query("personal_domain_filter", """
SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host FROM pages)
WHERE NOT ends_with('.' || host, '.example.net')""")
def personal_domain_filter(spark, sf):
    h = urls.host(F.col("url"))
    return table(spark, sf, "pages").where(
        ~text.is_personal_domain(h, ["example.net"])
    ).select("page_id", h.alias("host"))


_WORDINGS = [
    "3 hours ago", "Posted 2 weeks ago", "1 month ago", "12+ days ago", "Just Posted", "NaN", "01/5/2024",
    "Jan 5, 2024", "january 15, 2024", "2024-01-05T10:20:30", "2024-02-31", "soon", "999999999 days ago",
]


def _wordings(spark, sf):
    w = F.element_at(text.literal_array(_WORDINGS), (F.col("event_id") % len(_WORDINGS) + 1).cast("int"))
    dated = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(w)
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), dated.alias("date_posted")).unionByName(
        postings_docs(spark, sf).select((-1 - F.col("seq")).alias("seq"), "date_posted")
    )


_WORDINGS_SQL = f"""
SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  ELSE {S.items(_WORDINGS)}[event_id % {len(_WORDINGS)} + 1] END AS date_posted FROM events
UNION ALL SELECT -1 - seq, date_posted FROM ({POSTINGS_DOCS_SQL})
"""


def _dates_sql(plus):
    return (
        f"SELECT seq, CASE WHEN date_posted LIKE '999999999%' THEN NULL ELSE "
        f"{S.posted_date('date_posted', AS_OF, plus)} END AS posted_ts FROM ({_WORDINGS_SQL})"
    )


@query("posted_date_broad", _dates_sql(False))
def posted_date_broad(spark, sf):
    return _wordings(spark, sf).select(
        "seq", dates.parse_posted_date(F.col("date_posted"), AS_OF, plus_adds_one=False).alias("posted_ts")
    )


@query("posted_date_company", _dates_sql(True))
def posted_date_company(spark, sf):
    return _wordings(spark, sf).select(
        "seq", dates.parse_posted_date(F.col("date_posted"), AS_OF, plus_adds_one=True).alias("posted_ts")
    )


_VISIBLE = ["Posted on Posted 30+ Days Ago", "posted 3 weeks ago", "Date posted January 5, 2024",
            "Posted on 2024-01-05", "posted on Mar 15, 2024 ", "no date"]


@query("visible_date", f"""
SELECT doc_id, coalesce({', '.join(f"nullif(regexp_extract(t, {S.q(p)}, 1, 'i'), '')" for p in rules.VISIBLE_DATE_PATTERNS)}, '') AS posted
FROM (SELECT doc_id, {S.squash(f"text || ' ' || {S.items(_VISIBLE)}[doc_id % 6 + 1]")} AS t FROM documents)""")
def visible_date(spark, sf):
    note = F.element_at(text.literal_array(_VISIBLE), (F.col("doc_id") % 6 + 1).cast("int"))
    page = F.concat("text", F.lit(" "), note)
    return table(spark, sf, "documents").select("doc_id", dates.visible_posted_date(page).alias("posted"))


@query("epoch_iso", """
SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN ms % 1000 <> 0 THEN '.' || lpad(CAST((ms % 1000) * 1000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS ms FROM events)""")
def epoch_iso(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ms = F.when(F.col("event_id") % 3 == 0, F.floor(ms / 1000) * 1000).otherwise(ms)
    return table(spark, sf, "events").select("event_id", dates.epoch_millis_iso(ms).alias("iso"))
