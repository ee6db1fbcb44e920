"""String functions as Column -> Column expressions (built-in functions only)."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jobflow import rules

#: Unicode white space, spelled out because Java's ``\s`` is ASCII-only by default.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body`` without repeating its work."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections read without computing it again.

    The optimizer copies a projected expression into every filter above it; it does not move
    anything through a generator, so a one-element explode keeps the work to once per row.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values) -> Column:
    return F.expr(f"array({', '.join(map(_quoted, values))})") if values else F.array().cast("array<string>")


def lookup(table: dict, key: Column) -> Column:
    """Equi lookup in a small fixed table; NULL when the key is absent."""
    pairs = ", ".join(_quoted(x) for item in table.items() for x in item)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def any_contains(text: Column, fragments) -> Column:
    """True when any fixed fragment is a substring of the text."""
    return reduce(lambda a, b: a | b, [text.contains(f) for f in fragments])


def squash(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed; NULL counts as blank."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_WS)


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def normalize_text(text: Column) -> Column:
    """Identity-key form. A trailing separator is kept on purpose."""
    lowered = strip(F.lower(text))
    spaced = F.regexp_replace(lowered, r"[^a-z0-9\t-\r\x1c-\x20\x{85}\p{Z}]+", " ")
    return F.regexp_replace(spaced, WS + "+", " ")


def normalize_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def slug_words(text: Column) -> Column:
    return strip_chars(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "-")


def sender_email(row: Column) -> Column:
    """First e-mail address, lower case; NULL when there is none."""
    return F.lower(F.nullif(F.regexp_extract(row, f"({EMAIL})", 1), F.lit("")))


def email_domain(email: Column) -> Column:
    return F.regexp_extract(email, r"^[^@]*@(.*)$", 1)


def sender_domain(row: Column) -> Column:
    email = sender_email(row)
    return F.when(email.isNotNull(), email_domain(email))


def is_vendor_domain(domain: Column) -> Column:
    return any_contains(domain, rules.VENDOR_DOMAINS)


def company_domains(row: Column) -> Column:
    """Distinct host-like tokens of a text that are neither vendors nor images."""
    tokens = F.regexp_extract_all(
        F.lower(row), F.lit(r"(?U)\b([a-z0-9.-]+\.[a-z]{2,})(?:/\S*)?\b"), F.lit(1)
    )
    names = F.transform(tokens, lambda d: strip_chars(d, "."))

    def keep(d):
        image = reduce(lambda a, b: a | b, [d.endswith(s) for s in rules.IMAGE_SUFFIXES])
        return ~is_vendor_domain(d) & ~image

    return F.array_distinct(F.filter(names, keep))


def ats_hints(row: Column) -> Column:
    """Sorted tracking-system names hinted at anywhere in the text."""
    fragments = {}
    for fragment, name in [*rules.ATS_DOMAIN_HINTS.items(), *rules.ATS_KEYWORD_HINTS.items()]:
        fragments.setdefault(name, []).append(fragment)

    def hits(text):
        return F.array(*[F.when(any_contains(text, parts), F.lit(n)) for n, parts in sorted(fragments.items())])

    return F.array_compact(let(F.lower(row), hits))


def title_word(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when(low.isin(rules.UPPER_WORDS), F.upper(word))
        .when(low.isin(rules.LOWER_WORDS), low)
        .otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2))))
    )


def title_words(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), title_word), " ")


def registrable_domain(domain: Column) -> Column:
    def roots(d):
        parts = F.split(d, r"\.")
        keep = F.when(
            F.array_join(F.slice(parts, -2, 2), ".").isin(rules.COMPOUND_SUFFIXES), F.lit(3)
        ).otherwise(F.lit(2))
        return F.when(F.size(parts) <= 2, d).otherwise(
            F.array_join(F.slice(parts, -keep, keep), ".")
        )

    return let(strip_chars(F.lower(domain), "."), roots)


def is_personal_domain(domain: Column, personal=None) -> Column:
    return registrable_domain(domain).isin(rules.PERSONAL_DOMAINS if personal is None else personal)


def sender_local_tokens(email: Column) -> Column:
    local = F.lower(F.regexp_extract(email, r"^([^@]*)", 1))
    return F.filter(
        F.transform(F.split(local, r"[._+-]+"), strip),
        lambda t: (t != "") & ~t.isin(rules.SENDER_STOP_TOKENS) & ~t.rlike(r"^[a-z]\d+$"),
    )


def prefix(text: Column, n: int | None = None) -> Column:
    """First n characters of a field where a caller asks for a cut, else all of it."""
    return text if n is None else F.substring(text, 1, n)


def quoted(value: str) -> str:
    """Caller text as a pattern that matches itself."""
    return re.sub(r"([^\w\s])", r"\\\1", value)


def first_items(items: Column, n: int | None = None) -> Column:
    """First n elements of an array where a caller asks for a cut, else all."""
    return items if n is None else F.slice(items, 1, n)
