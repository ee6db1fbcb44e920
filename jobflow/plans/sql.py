"""SQL text pieces used to write the checking queries (run by DuckDB, never by Spark)."""

from jobflow import rules

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def q(text):
    return "'" + text.replace("'", "''") + "'"


def items(values):
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(x, values):
    return f"({x} IN ({', '.join(q(v) for v in values)}))"


def contains_any(x, values):
    return "(" + " OR ".join(f"contains({x}, {q(v)})" for v in values) + ")"


def ends_any(x, values):
    return "(" + " OR ".join(f"suffix({x}, {q(v)})" for v in values) + ")"


def sub(x, pattern, to="", flags="g"):
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def squash(x):
    return f"trim({sub(x, WS + '+', ' ')})"


def strip(x):
    return sub(x, f"^{WS}+|{WS}+$")


def norm_text(x):
    inner = sub(strip(f"lower({x})"), r"[^a-z0-9\t-\r\x1c-\x20\x{85}\p{Z}]+", " ")
    return sub(inner, WS + "+", " ")


def norm_key(x):
    return f"trim({sub(f'lower({x})', '[^a-z0-9]+', ' ')})"


def slugify(x):
    return sub(f"lower({x})", "[^a-z0-9]+")


def slug_words(x):
    return f"trim({sub(f'lower({x})', '[^a-z0-9]+', '-')}, '-')"


def url_part(x, n):
    return f"regexp_extract({x}, {q(URL)}, {n}, 's')"


def host(x):
    return f"lower({url_part(x, 2)})"


def clean_url(x):
    return rf"rtrim(regexp_replace({x}, '[?#].*$', '', 's'), '/')"


def origin(x):
    return f"(lower({url_part(x, 1)}) || '://' || {url_part(x, 2)})"


def normalize_url(x):
    keep = (
        "list_filter(string_split(" + url_part(x, 4) + ", '&'), lambda p: p <> '' AND NOT "
        "starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT "
        + in_list("lower(split_part(p, '=', 1))", rules.TRACKING_PARAMS) + ")"
    )
    pairs = f"list_transform({keep}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    text = f"array_to_string({pairs}, '&')"
    return (
        f"CASE WHEN {x} = '' THEN '' ELSE lower({origin(x)} || rtrim({url_part(x, 3)}, '/') || "
        f"CASE WHEN {text} = '' THEN '' ELSE '?' || {text} END) END"
    )


def board_type(x):
    arms = " ".join(
        f"WHEN {contains_any(host(x), parts)} THEN {q(name)}" for name, parts in rules.BOARD_HOSTS.items()
    )
    return f"CASE {arms} END"


def bare_path(x):
    return f"lower({sub(url_part(x, 3), ';[^/]*$')})"


def is_asset(x):
    return ends_any(f"lower({x})", rules.ASSET_SUFFIXES)


def is_useful(x):
    p = bare_path(x)
    return (
        f"(NOT {is_asset(x)} AND ({contains_any(p, rules.USEFUL_PATH_PARTS)} OR "
        f"{in_list(f'rtrim({p}, {q(chr(47))})', rules.USEFUL_PATHS)}))"
    )


def is_job_detail(x):
    return contains_any(bare_path(x), rules.JOB_DETAIL_PARTS)


def root_domain(x):
    d = f"trim(lower({x}), '.')"
    parts = f"string_split({d}, '.')"
    return (
        f"CASE WHEN len({parts}) <= 2 THEN {d} WHEN "
        f"{in_list(f'array_to_string({parts}[-2:], {q(chr(46))})', rules.COMPOUND_SUFFIXES)} "
        f"THEN array_to_string({parts}[-3:], '.') ELSE array_to_string({parts}[-2:], '.') END"
    )


def blank_null(x):
    return f"nullif({x}, '')"


def title_word(w):
    return (
        f"CASE WHEN {in_list(f'lower({w})', rules.UPPER_WORDS)} THEN upper({w}) "
        f"WHEN {in_list(f'lower({w})', rules.LOWER_WORDS)} THEN lower({w}) "
        f"ELSE upper({w}[1:1]) || {w}[2:] END"
    )


def title_words(x):
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {title_word('w')}), ' ')"


def posted_date(x, as_of, plus_adds_one):
    """Timestamp of a date wording; covers the wordings the sample tables hold."""
    t = f"lower({strip(x)})"
    ago = r"(\d+)\s*(\+)?\s*(hour|day|week|month)s?\s+ago"
    amount = f"TRY_CAST(regexp_extract({t}, {q(ago)}, 1) AS BIGINT)"
    if plus_adds_one:
        amount = f"({amount} + CASE WHEN regexp_extract({t}, {q(ago)}, 2) = '+' THEN 1 ELSE 0 END)"
    hours = (
        f"CASE regexp_extract({t}, {q(ago)}, 3) WHEN 'hour' THEN 1 WHEN 'day' THEN 24 "
        "WHEN 'week' THEN 168 ELSE 720 END"
    )
    now = f"TIMESTAMP '{as_of}'"
    formats = ["%Y-%m-%d", "%m/%d/%Y", "%b %d, %Y", "%B %d, %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]
    parsed = ", ".join(f"try_strptime({strip(x)}, '{f}')" for f in formats)
    return (
        f"CASE WHEN {in_list(t, rules.BLANK_DATES)} THEN NULL WHEN {in_list(t, rules.TODAY_WORDS)} THEN {now} "
        f"WHEN {t} = 'yesterday' THEN {now} - INTERVAL 1 DAY "
        f"WHEN regexp_matches({t}, {q(ago)}) THEN {now} - to_hours({amount} * {hours}) "
        f"ELSE coalesce({parsed}) END"
    )
