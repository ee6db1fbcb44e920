"""URL functions. All start from one regex split, so malformed urls still get an answer."""

from functools import reduce

from pyspark.sql import Column, functions as F

from jobflow import rules
from jobflow.functions.text import any_contains, let, lookup, strip

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url, group):
    return F.regexp_extract(url, _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    return F.lower(authority(url))


def _any_suffix(text, suffixes):
    return reduce(lambda a, b: a | b, [text.endswith(s) for s in suffixes])


def _origin(url):
    s, a = scheme(url), authority(url)
    return F.concat(
        F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""),
        F.when(a != "", F.concat(F.lit("//"), a)).otherwise(""),
    )


def normalize_url(url: Column) -> Column:
    """Match key of a url: tracking parameters, fragment and closing slashes removed, lower case."""

    def build(u):
        def keep(pair):
            key = F.lower(F.regexp_extract(pair, "^([^=]*)", 1))
            return (
                (pair != "")
                & ~key.startswith(rules.TRACKING_PREFIX)
                & ~key.isin(rules.TRACKING_PARAMS)
            )

        pairs = F.filter(F.split(query(u), "&"), keep)
        pairs = F.transform(
            pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))
        )
        query_text = F.array_join(pairs, "&")
        return F.lower(
            F.concat(
                _origin(u),
                F.rtrim(path(u), F.lit("/")),
                F.when(query_text != "", F.concat(F.lit("?"), query_text)).otherwise(""),
            )
        )

    return let(strip(F.coalesce(url, F.lit(""))), build)


def clean_url(url: Column) -> Column:
    """Url without query, fragment and closing slashes."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", "")
    lead = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?", 1)
    return F.rtrim(F.concat(F.lower(lead), F.substr(u, F.length(lead) + 1)), F.lit("/"))


def board_type(url: Column, hosts=None) -> Column:
    """First board whose host fragment occurs in the url's host, in rule order; NULL if none."""

    def ladder(h):
        out = None
        for name, fragments in (hosts or rules.BOARD_HOSTS).items():
            hit = any_contains(h, fragments)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return let(host(url), ladder)


def is_asset_url(url: Column) -> Column:
    return _any_suffix(F.lower(url), rules.ASSET_SUFFIXES)


def is_blocked_result(url: Column) -> Column:
    return any_contains(F.lower(url), rules.SEARCH_RESULT_BLOCKLIST)


def _bare_path(url):
    # path parameters (";x" on the last segment) are not part of the path
    return F.lower(F.regexp_replace(path(url), r";[^/]*$", ""))


def is_useful_url(url: Column) -> Column:
    """Url that looks like a careers page, a job list or a job."""

    def decide(p):
        return any_contains(p, rules.USEFUL_PATH_PARTS) | F.rtrim(p, F.lit("/")).isin(
            rules.USEFUL_PATHS
        )

    return ~is_asset_url(url) & let(_bare_path(url), decide)


def is_job_detail_url(url: Column) -> Column:
    return let(_bare_path(url), lambda p: any_contains(p, rules.JOB_DETAIL_PARTS))


def workday_api_urls(board_url: Column) -> Column:
    """Listing endpoints of a workday board: path before ``job``, with and without a locale."""

    def build(segments):
        site = F.when(
            F.array_contains(segments, "job"),
            F.slice(segments, F.lit(1), (F.array_position(segments, "job") - 1).cast("int")),
        ).otherwise(segments)

        def variants(s):
            short = F.when(
                F.get(s, F.lit(0)).rlike(r"^[a-z]{2}(?:-[A-Z]{2})?$"),
                F.slice(s, F.lit(2), F.size(s)),
            )
            return F.filter(F.array(s, short), lambda v: v.isNotNull() & (F.size(v) > 0))

        origin = F.concat(scheme(board_url), F.lit("://"), authority(board_url))
        return F.transform(
            let(site, variants),
            lambda v: F.concat(origin, F.lit("/wday/cxs/"), F.array_join(v, "/"), F.lit("/jobs")),
        )

    segments = F.filter(F.split(path(board_url), "/"), lambda s: s != "")
    return F.array_sort(F.array_distinct(let(segments, build)))


def _resolve_dots(segments):
    """Apply ``.`` and ``..`` to a list of path segments."""
    closing = F.element_at(segments, -1).isin(".", "..")

    def step(acc, s):
        return (
            F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(closing, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _drop_inner_blanks(segments):
    n = F.size(segments)
    return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == n - 1))


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    tail = F.regexp_extract(href, r"(?s)([?#].*)$", 1)
    target = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    base_no_fragment = F.regexp_replace(base, r"(?s)#.*$", "")
    base_path = F.regexp_replace(base_no_fragment, r"(?s)\?.*$", "")
    folder = F.transform(
        F.split(path(base), "/"), lambda s, i: s
    )
    folder = F.when(
        F.element_at(folder, -1) != "", F.slice(folder, F.lit(1), F.size(folder) - 1)
    ).otherwise(folder)
    absolute = F.split(target, "/")
    # the closing blank of a folder only marks the slash; the link starts after it
    relative = F.concat(
        F.when(F.size(folder) == 0, F.array(F.lit(""))).otherwise(folder), absolute
    )
    segments = F.when(target.startswith("/"), absolute).otherwise(relative)
    resolved = let(
        segments, lambda s: let(_drop_inner_blanks(s), _resolve_dots)
    )
    resolved = F.when(resolved.startswith("/"), resolved).otherwise(F.concat(F.lit("/"), resolved))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(base_no_fragment, href))
        .when(href.startswith("?"), F.concat(base_path, href))
        .otherwise(F.concat(_origin(base), resolved, tail))
    )


def host_join(origin: str, href: Column) -> Column:
    """Link completion used by single-site scans: anything not starting with http is appended."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(origin), href))


def unwrap_redirect(href: Column) -> Column:
    """Target of a search-engine redirect link (``uddg`` parameter), else the link itself."""
    target = F.regexp_extract(href, r"^[^?#]*\?(?:[^#]*&)?uddg=([^&#]+)", 1)
    # the parameter is decoded twice, so a doubly escaped target comes out clean
    once = F.coalesce(F.try_url_decode(target), target)
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return F.when(href.contains("/l/?") & (target != ""), twice).otherwise(href)


def fill_template(template_map: dict, key: Column, value: Column) -> Column:
    """``{}`` in the template found under ``key`` replaced by ``value``; NULL when no template."""
    return F.replace(lookup(template_map, key), F.lit("{}"), value)
