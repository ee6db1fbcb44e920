"""Where a company's postings may be found: url generation, link discovery, selection."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobflow import rules
from jobflow.functions import html, text, urls
from jobflow.functions.text import let
from jobflow.operators.registry import _none, _overrides
from jobflow.session import cut_lineage


def domain_guesses() -> Column:
    """Sorted domains a clean record's company may own."""

    def from_sender(e):
        local = F.substring_index(e, "@", 1)
        known = text.lookup(rules.WORKDAY_SENDER_DOMAINS, local)
        return F.when(
            F.regexp_extract(e, "@(.*)$", 1).endswith("myworkday.com"),
            F.coalesce(known, F.when(local.rlike("^[a-z0-9-]{3,}$"), F.concat(local, F.lit(".com")))),
        )

    company = F.col("company")
    words, joined = text.slug_words(company), text.slugify(company)
    guesses = F.array(
        F.when(words != "", F.concat(words, F.lit(".com"))),
        F.when((joined != "") & (joined != F.replace(words, F.lit("-"), F.lit(""))), F.concat(joined, F.lit(".com"))),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.col("company_domains"), _overrides(rules.COMPANY_DOMAIN_OVERRIDES, company),
        F.transform("sender_emails", from_sender), guesses,
    ))))


def board_url_candidates() -> Column:
    """Sorted urls where a clean record's postings may be listed."""
    company = F.col("company")
    pages = F.flatten(F.transform(
        domain_guesses(),
        lambda d: F.array(*[F.concat(F.lit("https://"), d, F.lit(p)) for p in rules.CAREER_PATHS]),
    ))
    slugs = F.array_distinct(F.filter(F.concat(
        F.array(text.slug_words(company), text.slugify(company)),
        F.flatten(F.transform("aliases", lambda a: F.array(text.slug_words(a), text.slugify(a)))),
        F.transform("sender_emails", lambda e: F.lower(F.substring_index(e, "@", 1))),
    ), lambda s: s != ""))
    patterns = {name: " ".join(values) for name, values in rules.BOARD_URL_TEMPLATES.items()}
    templates = F.flatten(F.transform(
        "ats_hints", lambda h: F.coalesce(F.split(text.lookup(patterns, h), " "), _none())
    ))
    boards = let(slugs, lambda s: F.flatten(F.transform(
        templates, lambda t: F.transform(s, lambda v: F.replace(t, F.lit("{}"), v))
    )))
    return F.array_sort(F.array_distinct(F.concat(
        _overrides(rules.CAREER_URL_OVERRIDES, company), pages, boards
    )))


def search_queries(domains: int | None = None) -> Column:
    """Search-engine queries for a clean record, in order, repeats dropped; ``domains`` limits its own sites."""
    company = F.col("company")
    sites = F.transform(
        text.first_items(domain_guesses(), domains),
        lambda d: F.concat(F.lit("site:"), d, F.lit(" "), company, F.lit(" careers")),
    )
    hints = F.array_compact(F.transform(
        "ats_hints", lambda h: urls.fill_template(rules.SEARCH_SITE_TEMPLATES, h, company)
    ))
    first = F.array(F.concat(F.lit('"'), company, F.lit('" careers jobs')))
    return F.array_distinct(F.concat(first, sites, hints))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link): useful or board links on landed pages, absolute, cleaned, distinct."""
    anchors = pages.select("url", F.explode(html.parse_page(F.col("html"), "anchors")["anchors"]).alias("a"))
    href = F.col("a.href")
    usable = (href != "") & ~href.rlike("^(?:mailto:|javascript:|#)")

    def wanted(link):
        good = (
            ~urls.is_blocked_result(link) & ~urls.is_asset_url(link)
            & (urls.board_type(link).isNotNull() | urls.is_useful_url(link))
        )
        return F.when(good, link)

    link = let(urls.clean_url(urls.join_url(F.col("url"), href)), wanted)
    links = text.computed(anchors.where(usable), "link", link).select("url", "link")
    return links.where("link IS NOT NULL").distinct()


def search_links(results: DataFrame, keep: int | None = None) -> DataFrame:
    """(company, link): distinct career links on landed search-result pages; with ``keep`` the first ones.

    ``results`` holds company, query_pos, html.
    """

    def wanted(target):
        good = (
            target.startswith("http") & ~urls.is_blocked_result(target)
            & (text.any_contains(F.lower(target), rules.SEARCH_RESULT_TOKENS) | urls.board_type(target).isNotNull())
        )
        return F.when(good, urls.clean_url(target))

    anchors = results.select(
        "company", "query_pos", F.posexplode(html.parse_page(F.col("html"), "anchors")["anchors"]).alias("pos", "a")
    )
    anchors = text.computed(anchors, "link", let(urls.unwrap_redirect(F.col("a.href")), wanted))
    first = anchors.where("link IS NOT NULL").groupBy("company", "link").agg(
        F.min(F.struct("query_pos", "pos")).alias("at")
    )
    if keep is None:
        return first.select("company", "link")
    w = Window.partitionBy("company").orderBy("at")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("company", "link")


def discovery_urls(
    records: DataFrame, pages: DataFrame, results: DataFrame | None = None, seeds: int | None = None,
    keep_links: int | None = None,
) -> DataFrame:
    """(company, url): board urls, and useful urls on the company's own domains.

    ``seeds`` limits the pages crawled per company, ``keep_links`` the links taken from its results.
    """
    # url generation is a long expression read four times below: written once
    known = cut_lineage(records.select(
        "company", F.size("ats_hints").alias("hints"), board_url_candidates().alias("urls"),
        F.array_distinct(F.transform(domain_guesses(), text.registrable_domain)).alias("roots"),
    ))
    listed = known.select("company", F.explode("urls").alias("url"))
    start = listed.where(urls.board_type(F.col("url")).isNull())
    if seeds is not None:
        rank = F.row_number().over(Window.partitionBy("company").orderBy("url"))
        start = start.withColumn("rank", rank).where(F.col("rank") <= seeds)
    crawled = start.join(page_links(pages.join(start.select("url").distinct(), "url", "left_semi")), "url").select(
        "company", F.col("link").alias("url")
    )
    found = listed.unionByName(crawled)
    if results is not None:
        on_boards = found.where(urls.board_type(F.col("url")).isNotNull()).select("company").distinct()
        asking = known.where("hints > 0").select("company").unionByName(
            known.select("company").join(on_boards, "company", "left_anti")
        ).distinct()
        searched = search_links(results, keep_links).join(asking, "company", "left_semi")
        found = found.unionByName(searched.withColumnRenamed("link", "url"))
    url = F.col("url")
    own = (F.size("roots") == 0) | F.array_contains("roots", text.registrable_domain(urls.authority(url)))
    return (
        found.distinct().join(known.select("company", "roots"), "company")
        .where(urls.board_type(url).isNotNull() | (urls.is_useful_url(url) & own))
        .select("company", "url")
    )
