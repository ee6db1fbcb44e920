"""Registry resolution, ranking and url discovery on the registry built from mailbox rows."""

from pyspark.sql import functions as F

from jobflow import rules
from jobflow.fixtures import MAIL_ROWS_SQL, mail_rows, table

from jobflow.operators import discovery, evidence, registry
from jobflow.plans import name_sql as N
from jobflow.plans import sql as S
from jobflow.plans.catalog import query
from jobflow.plans.queries_filters import match_sql
from jobflow.plans.queries_names import joined
from jobflow.session import cut_lineage

_PRIORITY_WORDS = ["stress analyst", "thank you"]


def registry_raw(spark, sf, limited=False):
    """(records, rows) of the raw registry; ``limited`` keeps the published three cut rows per company."""
    facts = evidence.evidence_facts(evidence.match_rows(mail_rows(spark, sf)))
    rows = evidence.company_rows(facts)
    rows = evidence.first_rows(rows, keep=3, chars=400) if limited else rows
    return cut_lineage(evidence.company_records(facts)), rows


def registry_resolved(spark, sf, limited=False):
    """(records, rows, resolved names) of the raw registry."""
    records, rows = registry_raw(spark, sf, limited)
    return records, rows, cut_lineage(registry.resolve_names(registry.registry_votes(records, rows)))


def registry_clean(spark, sf):
    """The merged registry as a stored table."""
    records, _, resolved = registry_resolved(spark, sf)
    return cut_lineage(registry.merge_registry(records, resolved))


_CTES = N.registry_ctes(MAIL_ROWS_SQL)
_CTES_LIMITED = N.registry_ctes(MAIL_ROWS_SQL, True)


@query("registry_votes", f"WITH {_CTES} SELECT company, candidate, votes FROM votes")
def registry_votes(spark, sf):
    return registry.registry_votes(*registry_raw(spark, sf))


@query("registry_votes_limited", f"WITH {_CTES_LIMITED} SELECT company, candidate, votes FROM votes")
def registry_votes_limited(spark, sf):
    return registry.registry_votes(*registry_raw(spark, sf, limited=True))


@query("registry_names", f"WITH {_CTES} SELECT company, resolved FROM resolved")
def registry_names(spark, sf):
    return registry_resolved(spark, sf)[2]


_MERGED = f"""SELECT resolved AS company, count, {N.joined('m_vals', 'resolved', 'alias')} AS aliases,
  {N.joined('m_vals', 'resolved', 'hint')} AS ats_hints, {N.joined('m_vals', 'resolved', 'domain')} AS company_domains,
  {N.joined('m_vals', 'resolved', 'sender')} AS sender_domains, {N.joined('m_vals', 'resolved', 'email')} AS sender_emails"""
_MERGED_LISTS = ["aliases", "ats_hints", "company_domains", "sender_domains", "sender_emails"]


@query("registry_merge", f"WITH {_CTES} {_MERGED} FROM m_count b")
def registry_merge(spark, sf):
    return registry_clean(spark, sf).select("company", "count", *joined(*_MERGED_LISTS))


@query("registry_merge_limited", f"""WITH {_CTES_LIMITED} {_MERGED},
  (SELECT string_agg(example, ';' ORDER BY rank) FROM m_example x WHERE x.resolved = b.resolved) AS examples FROM m_count b""")
def registry_merge_limited(spark, sf):
    records, rows, resolved = registry_resolved(spark, sf, limited=True)
    clean = registry.merge_registry(records, resolved)
    found = evidence.with_examples(clean, registry.merged_rows(rows, resolved, keep=5))
    return found.select("company", "count", *joined(*_MERGED_LISTS, "examples"))


@query("registry_rows", f"WITH {_CTES} SELECT resolved AS company, example AS row FROM m_example")
def registry_rows(spark, sf):
    _, rows, resolved = registry_resolved(spark, sf)
    return registry.merged_rows(rows, resolved).select("company", "row")


def _own_domain(r, kind):
    return (
        f"NOT {S.in_list(r, rules.PERSONAL_DOMAINS)} AND NOT {S.contains_any(r, rules.VENDOR_DOMAINS)}"
        f" AND ({kind} = 'email' OR NOT {S.ends_any(r, rules.DOMAIN_ASSET_SUFFIXES)})"
    )


@query("registry_domains", f"""WITH {_CTES} SELECT company, coalesce(string_agg(r, ';' ORDER BY r), '') AS domains
FROM ev_count LEFT JOIN (SELECT DISTINCT company, r FROM (SELECT company, kind,
    {S.root_domain("CASE kind WHEN 'email' THEN split_part(value, '@', 2) ELSE value END")} AS r
    FROM ev_vals WHERE kind IN ('domain', 'email')) WHERE {_own_domain('r', 'kind')}) USING (company) GROUP BY company""")
def registry_domains(spark, sf):
    return registry_raw(spark, sf)[0].select(
        "company", F.array_join(registry.cleaned_domains(), ";").alias("domains")
    )


_PRIORITY_SQL = f"""SELECT b.resolved AS company, count
  + CASE WHEN EXISTS (SELECT 1 FROM m_vals v WHERE v.resolved = b.resolved AND kind = 'hint') THEN 3 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM m_vals v WHERE v.resolved = b.resolved AND kind = 'domain') THEN 2 ELSE 0 END
  + 5 * (SELECT count(*) FROM m_example e WHERE e.resolved = b.resolved AND {match_sql('b.resolved', 'example', _PRIORITY_WORDS)})
  AS priority FROM m_count b"""


def _ranked(spark, sf, limited=False):
    records, rows, resolved = registry_resolved(spark, sf, limited)
    rows = registry.merged_rows(rows, resolved, 5 if limited else None)
    return registry.rank_companies(registry.merge_registry(records, resolved), rows, _PRIORITY_WORDS)


@query("registry_priority", f"WITH {_CTES} {_PRIORITY_SQL}")
def registry_priority(spark, sf):
    return _ranked(spark, sf).select("company", "priority")


@query("registry_priority_limited", f"WITH {_CTES_LIMITED} {_PRIORITY_SQL}")
def registry_priority_limited(spark, sf):
    return _ranked(spark, sf, limited=True).select("company", "priority")


@query("registry_topn", f"""WITH {_CTES} SELECT company, priority FROM ({_PRIORITY_SQL})
ORDER BY priority DESC, lower(company), company LIMIT 8""")
def registry_topn(spark, sf):
    return registry.top_companies(_ranked(spark, sf), 8).select("company", "priority")


def _guess_sql():
    over = " UNION ALL ".join(
        f"SELECT resolved, {S.q(d)} FROM m_count WHERE resolved = {S.q(c)}"
        for c, ds in rules.COMPANY_DOMAIN_OVERRIDES.items() for d in ds
    )
    local = "split_part(value, '@', 1)"
    known = N.lookup(rules.WORKDAY_SENDER_DOMAINS, local)
    return f"""
  guess AS MATERIALIZED (SELECT DISTINCT resolved, d FROM (
    SELECT resolved, value AS d FROM m_vals WHERE kind = 'domain' UNION ALL {over}
    UNION ALL SELECT resolved, coalesce({known}, CASE WHEN regexp_matches({local}, '^[a-z0-9-]{{3,}}$') THEN {local} || '.com' END)
      FROM m_vals WHERE kind = 'email' AND suffix(split_part(value, '@', 2), 'myworkday.com')
    UNION ALL SELECT resolved, {S.slug_words('resolved')} || '.com' FROM m_count WHERE {S.slug_words('resolved')} <> '')
    WHERE d IS NOT NULL)"""


@query("domain_guesses", f"WITH {_CTES}, {_guess_sql()} SELECT resolved AS company, d AS domain FROM guess")
def domain_guesses(spark, sf):
    return registry_clean(spark, sf).select("company", F.explode(discovery.domain_guesses()).alias("domain"))


def _boards_sql():
    careers = " UNION ALL ".join(
        f"SELECT resolved, {S.q(u)} FROM m_count WHERE resolved = {S.q(c)}"
        for c, us in rules.CAREER_URL_OVERRIDES.items() for u in us
    )
    templates = ", ".join(
        f"({S.q(h)}, {S.q(t)})" for h, ts in rules.BOARD_URL_TEMPLATES.items() for t in ts
    )
    return f"""
  slug AS MATERIALIZED (SELECT DISTINCT resolved, s FROM (
    SELECT resolved, unnest([{S.slug_words('resolved')}, {S.slugify('resolved')}]) AS s FROM m_count
    UNION ALL SELECT resolved, unnest([{S.slug_words('value')}, {S.slugify('value')}]) FROM m_vals WHERE kind = 'alias'
    UNION ALL SELECT resolved, lower(split_part(value, '@', 1)) FROM m_vals WHERE kind = 'email') WHERE s <> ''),
  board AS MATERIALIZED (SELECT DISTINCT resolved, url FROM ({careers}
    UNION ALL SELECT resolved, 'https://' || d || unnest({S.items(rules.CAREER_PATHS)}) FROM guess
    UNION ALL SELECT v.resolved, replace(t.tpl, '{{}}', s) FROM m_vals v JOIN (VALUES {templates}) t(hint, tpl) ON v.kind = 'hint' AND v.value = t.hint
      JOIN slug USING (resolved)) b(resolved, url))"""


@query("board_urls", f"WITH {_CTES}, {_guess_sql()}, {_boards_sql()} SELECT resolved AS company, url FROM board")
def board_urls(spark, sf):
    return registry_clean(spark, sf).select("company", F.explode(discovery.board_url_candidates()).alias("url"))


def _queries_sql(few=""):
    sites = ", ".join(f"({S.q(h)}, {S.q(t)})" for h, t in rules.SEARCH_SITE_TEMPLATES.items())
    return f"""
  asked AS MATERIALIZED (SELECT DISTINCT resolved, text FROM (
    SELECT resolved, '"' || resolved || '" careers jobs' AS text FROM m_count
    UNION ALL SELECT resolved, 'site:' || d || ' ' || resolved || ' careers' FROM (SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY d) AS rn FROM guess) {few}
    UNION ALL SELECT resolved, replace(t.tpl, '{{}}', resolved) FROM m_vals v JOIN (VALUES {sites}) t(hint, tpl) ON v.kind = 'hint' AND v.value = t.hint))"""


@query("search_queries", f"WITH {_CTES}, {_guess_sql()}, {_queries_sql()} SELECT resolved AS company, text AS query FROM asked")
def search_queries(spark, sf):
    return registry_clean(spark, sf).select("company", F.explode(discovery.search_queries()).alias("query"))


@query("search_queries_limited", f"WITH {_CTES}, {_guess_sql()}, {_queries_sql('WHERE rn <= 2')} SELECT resolved AS company, text AS query FROM asked")
def search_queries_limited(spark, sf):
    return registry_clean(spark, sf).select("company", F.explode(discovery.search_queries(2)).alias("query"))


# landed result pages: every page stands for the answer to one company's query
_RESULT_LINK = """CASE page_id % 4 WHEN 0 THEN '//search.example.com/l/?x=1&uddg=https%3A%2F%2Facme.example.com%2Fcareers%2F' || page_id || '%3Fq%3D1&r=2'
  WHEN 1 THEN 'https://jobs.lever.co/acme' || page_id WHEN 2 THEN 'https://www.indeed.com/jobs' ELSE '/relative/jobs' END"""
_RESULT_URL = """CASE page_id % 4 WHEN 0 THEN 'https://acme.example.com/careers/' || page_id WHEN 1 THEN 'https://jobs.lever.co/acme' || page_id END"""


def result_pages(spark, sf):
    k = F.col("page_id")
    link = (
        F.when(k % 4 == 0, F.concat(F.lit("//search.example.com/l/?x=1&amp;uddg=https%3A%2F%2Facme.example.com%2Fcareers%2F"), k, F.lit("%3Fq%3D1&amp;r=2")))
        .when(k % 4 == 1, F.concat(F.lit("https://jobs.lever.co/acme"), k))
        .when(k % 4 == 2, "https://www.indeed.com/jobs").otherwise("/relative/jobs")
    )
    return table(spark, sf, "pages").select(
        F.concat(F.lit("Company "), k % 7).alias("company"), k.alias("query_pos"),
        F.concat(F.lit('<a href="'), link, F.lit('">hit</a>'), "html").alias("html"),
    )


_FOUND_LINKS = f"""(SELECT 'Company ' || (page_id % 7) AS company, {_RESULT_URL} AS link,
  row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS rn FROM pages WHERE page_id % 4 < 2)"""


@query("search_links", f"SELECT company, link FROM {_FOUND_LINKS}")
def search_links(spark, sf):
    return discovery.search_links(result_pages(spark, sf))


@query("search_links_limited", f"SELECT company, link FROM {_FOUND_LINKS} WHERE rn <= 10")
def search_links_limited(spark, sf):
    return discovery.search_links(result_pages(spark, sf), 10)


# landed career pages of the companies' own sites: one page per guessed url, links by company
_SITE_LINKS = ["/jobs/1?x=2", "/about", "https://boards.greenhouse.io/zz#a", "/careers/us/", "/logo.png", "https://other.example.org/jobs/7"]


def site_pages(spark, sf, records):
    body = "".join(f'<a href="{h}">see it</a>' for h in _SITE_LINKS)
    return records.select(F.explode(discovery.board_url_candidates()).alias("url")).distinct().withColumn(
        "html", F.lit(f"<html><body>{body}</body></html>")
    )


def _discovery_sql(few=""):
    return f"""WITH {_CTES}, {_guess_sql()}, {_boards_sql()},
  seed AS (SELECT resolved, url FROM (SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY url) AS rn FROM board
    WHERE {S.board_type('url')} IS NULL) {few}),
  crawl AS (SELECT resolved, {S.clean_url('link')} AS url FROM (SELECT resolved,
      unnest([{S.origin('url')} || '/jobs/1?x=2', 'https://boards.greenhouse.io/zz#a', {S.origin('url')} || '/careers/us/', 'https://other.example.org/jobs/7']) AS link FROM seed)),
  found AS (SELECT resolved, url FROM board UNION SELECT resolved, url FROM crawl),
  root AS (SELECT DISTINCT resolved, {S.root_domain('d')} AS r FROM guess)
SELECT resolved AS company, url FROM found f WHERE {S.board_type('url')} IS NOT NULL OR ({S.is_useful('url')}
  AND EXISTS (SELECT 1 FROM root WHERE root.resolved = f.resolved AND root.r = {S.root_domain(S.url_part('f.url', 2))}))"""


@query("discovery_filter", _discovery_sql())
def discovery_filter(spark, sf):
    records = registry_clean(spark, sf)
    return discovery.discovery_urls(records, site_pages(spark, sf, records))


@query("discovery_filter_limited", _discovery_sql("WHERE rn <= 3"))
def discovery_filter_limited(spark, sf):
    records = registry_clean(spark, sf)
    return discovery.discovery_urls(records, site_pages(spark, sf, records), seeds=3)


@query("watchlist_registry", "SELECT s_name AS company, CAST(1 AS BIGINT) AS count, '' AS examples FROM supplier")
def watchlist_registry(spark, sf):
    frame = registry.watchlist_registry(table(spark, sf, "supplier"), "s_name")
    return frame.select("company", "count", F.array_join("examples", ";").alias("examples"))
