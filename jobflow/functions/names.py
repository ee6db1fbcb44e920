"""Company names out of free text: ordered rule ladders as Column expressions."""

import re

from pyspark.sql import Column, functions as F

from jobflow import rules
from jobflow.functions.text import (
    quoted, EMAIL, WS, let, lookup, normalize_key, squash, strip_chars,
    title_words,
)

_EDGE = " -:|,.;"
_EDGE_BRACKETS = " -:|,.;()[]{}"
#: the letters besides A-Z that a case-insensitive Unicode pattern takes for a-z, and what for
_FOLDED = ("ſıİ\u212a", "siik")


def _null():
    return F.lit(None).cast("string")


def _alternation(words):
    return "|".join(map(quoted, words))


def canonical_name(name: Column, owner_name: str | None = None) -> Column:
    """Display name of a company, or NULL when the text does not name one."""

    def noisy(low):
        words = [*rules.NAME_NOISE_WORDS, *([owner_name.lower()] if owner_name else [])]
        return low.rlike(rf"(?U)\b({_alternation(words)})\b")

    def one_word(word):
        token = F.regexp_replace(word, "[^A-Za-z0-9&+-]", "")

        def decide(t):
            low = F.lower(t)
            as_is = (F.upper(t).eqNullSafe(t) & t.rlike("[A-Za-z]")) | t.rlike("[0-9]")
            return (
                F.when((t == "") | low.isin(rules.GENERIC_PREFIXES), _null())
                .when(lookup(rules.COMPANY_ALIASES, low).isNotNull(), lookup(rules.COMPANY_ALIASES, low))
                .when(as_is, t)
                .otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))
            )

        return let(token, decide)

    def many_words(text):
        return let(
            title_words(text),
            lambda t: F.when(F.lower(t).isin(rules.GENERIC_COMPANIES), _null()).otherwise(t),
        )

    def cleaned(value):
        def decide(low):
            alias = lookup(rules.COMPANY_ALIASES, low)
            return (
                F.when(value == "", _null())
                .when(alias.isNotNull(), alias)
                .when(low.isin(rules.GENERIC_COMPANIES) | low.isin(rules.STUB_NAMES) | noisy(low), _null())
                .when(low.endswith(" university") | low.contains("national laboratory"), title_words(value))
                .when(~value.contains(" "), one_word(value))
                .otherwise(many_words(value))
            )

        return let(F.lower(value), decide)

    def strip_tails(value):
        value = F.regexp_replace(value, r"\s+\|\s+.*$", "")
        value = F.regexp_replace(value, rf"(?i)\s+({_alternation(rules.TEAM_SUFFIXES)})$", "")
        value = F.regexp_replace(value, rf"(?i)\s+({_alternation(rules.DEPARTMENT_SUFFIXES)})$", "")
        value = F.regexp_replace(value, r"\s+\(.*?\)$", "")
        return strip_chars(squash(value), _EDGE)

    def start(value):
        alias = lookup(rules.COMPANY_ALIASES, F.lower(value))
        return (
            F.when((value == "") | value.contains("@"), _null())
            .when(alias.isNotNull(), alias)
            .otherwise(let(strip_tails(value), cleaned))
        )

    value = strip_chars(squash(name), _EDGE_BRACKETS)
    if owner_name:
        value = strip_chars(
            F.regexp_replace(value, rf"(?iU)\b(?:dear|hello|hi)\s+{quoted(owner_name)}\b.*$", ""), _EDGE_BRACKETS
        )
    return let(value, start)


def sender_company(row: Column, owner_name: str | None = None) -> Column:
    """Company named by the sender part of a mailbox row, or NULL."""

    def from_address(line):
        address = F.regexp_extract(line, f"({EMAIL})", 1)

        def decide(a):
            local = F.lower(F.regexp_extract(a, "^([^@]*)", 1))
            domain = F.lower(F.regexp_extract(a, "@(.*)$", 1))
            pieces = F.transform(
                F.split(local, r"[._+-]+"), lambda p: lookup(rules.COMPANY_ALIASES, p)
            )
            return F.when(
                a != "",
                F.coalesce(
                    lookup(rules.EMAIL_DOMAIN_COMPANIES, domain),
                    lookup(rules.COMPANY_ALIASES, local),
                    F.get(F.array_compact(pieces), F.lit(0)),
                ),
            )

        return let(address, decide)

    def subject_prefix(line):
        cut = F.regexp_replace(line, rf"(?is)\s+(?:{_alternation(rules.SUBJECT_STARTS)}).*$", "")
        for mark in rules.SENDER_CUTS:
            cut = F.substring_index(cut, mark, 1)
        return strip_chars(squash(cut), _EDGE)

    def from_prefix(p):
        dashed = F.when(p.contains(" - "), canonical_name(F.substring_index(p, " - ", -1), owner_name))
        before_colon = F.when(p.contains(":"), canonical_name(F.substring_index(p, ":", 1), owner_name))
        short = squash(F.regexp_replace(p, rf"(?i)\s+({_alternation(rules.SENDER_SUFFIXES)})$", ""))
        whole = let(
            short,
            lambda s: F.when((s != "") & (F.size(F.split(s, " ")) <= 6), canonical_name(s, owner_name)),
        )
        address_only = p.contains("@") & ~p.contains(" ")
        return F.when((p == "") | address_only, _null()).otherwise(
            F.coalesce(dashed, before_colon, whole)
        )

    return let(
        squash(row),
        lambda line: F.coalesce(from_address(line), let(subject_prefix(line), from_prefix)),
    )


def row_patterns(owner_name: str | None = None, name: str = rules.NAME_CAPTURE) -> list[str]:
    """The capture patterns with the owner's name filled in."""
    out = []
    for pattern in rules.ROW_PATTERNS:
        if "{owner}" in pattern and not owner_name:
            continue
        owner = quoted(owner_name) if owner_name else ""
        owner_stop = rf",?\s+{owner}|" if owner_name else ""
        out.append(
            pattern.replace("{owner_stop}", owner_stop).replace("{owner}", owner)
            .replace("{stop}", rules.DATE_STOP).replace("{name}", name)
        )
    return out


def _linear(pattern: str) -> str:
    """Same matches without trying every start: a pattern that opens with the name itself is
    only tried where a run of name characters begins, or where the last match ended."""
    if not pattern.startswith(rules.NAME_CAPTURE):
        return pattern
    return rf"(?:\G|(?<!{rules.NAME_CHARS}))[&.,'’()/ -]*+" + pattern


def _opening(pattern: str) -> str:
    """Lower-case text that every match of a pattern begins with; blank when it begins with the name."""
    plain = re.match(r"[A-Za-z ]*", pattern).group()
    return (plain[:-1] if pattern[len(plain):][:1] in ("?", "*", "{") else plain).lower()


def _folded(text: Column) -> Column:
    """Lower case in which the opening of a case-insensitive Unicode pattern is found as it stands."""
    rare = text.rlike(f"[{_FOLDED[0]}]")
    return F.lower(F.when(rare, F.translate(text, *_FOLDED)).otherwise(text))


def row_candidates(row: Column, owner_name: str | None = None) -> Column:
    """Every company a mailbox row names, in rule order, repeats kept."""

    def captured(text, folded):
        none = F.array().cast("array<string>")
        captures = []
        for p in row_patterns(owner_name):
            found = F.regexp_extract_all(text, F.lit("(?iU)" + _linear(p)), F.lit(1))
            # a pattern costs a look at every character: asked only where its opening words are
            if p.startswith(rules.NAME_CAPTURE):
                closing = "@ icims"
                found = F.when(folded.contains(closing) & F.lower(text).contains(closing), found).otherwise(none)
            else:
                found = F.when(folded.contains(_opening(p)), found).otherwise(none)
            captures.append(found)
        return F.concat(*captures)

    def collect(text):
        captures = let(_folded(text), lambda folded: captured(text, folded))
        names = F.transform(captures, lambda c: canonical_name(c, owner_name))
        return F.array_compact(F.concat(F.array(sender_company(text, owner_name)), names))

    return let(squash(row), collect)


def is_generic_role_name(name: Column) -> Column:
    def check(tokens):
        return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(rules.GENERIC_ROLE_WORDS))

    tokens = F.filter(F.split(normalize_key(name), " "), lambda t: t != "")
    return let(tokens, check)


def is_valid_company_name(name: Column, owner_name: str | None = None) -> Column:
    low = F.lower(name)
    noise = "|".join([*rules.NOISE_NAME_PATTERNS, *([rf"\b{quoted(owner_name.lower())}\b"] if owner_name else [])])
    words = F.filter(F.split(name, WS + "+"), lambda w: w != "")
    article = low.rlike("^(our|the) ") & ~low.contains(" at ") & ~low.contains("laboratory")
    return (
        (name != "")
        & ~name.rlike(r"(?U)\d{4}-\d{2}-\d{2}")
        & ~low.rlike("(?U)" + noise)
        & ~low.isin(rules.BARE_ROLES)
        & ~article
        & (F.size(words) <= 8)
    )


def _own_name(value: Column, owner_name) -> Column:
    """Name of one candidate text, its own wording only."""

    def fixed_or(value, otherwise):
        fix = lookup(rules.NAME_FIXES, F.lower(value))
        return F.when(fix.isNotNull(), F.nullif(fix, F.lit(""))).otherwise(otherwise)

    def trimmed(v):
        for pattern in [*rules.LEADING_STRIPS, *rules.TRAILING_CUTS]:
            v = F.regexp_replace(v, "(?i)" + pattern, "")
        return strip_chars(squash(v), _EDGE)

    def accept(v):
        ok = is_valid_company_name(v, owner_name) & ~is_generic_role_name(v)
        return F.when(ok, v)

    def named(v):
        return F.when(
            v != "",
            fixed_or(v, let(F.coalesce(canonical_name(v, owner_name), v), accept)),
        )

    return F.when(value != "", fixed_or(value, let(trimmed(value), named)))


def candidate_name(value: Column, owner_name: str | None = None) -> Column:
    """Company behind a raw name such as "Data Analyst - Simulation role at Acme".

    The texts a name can hide in are listed from the most to the least specific: the part
    before " - " when a role follows, what stands after each closing "at", the whole text.
    The first that yields a valid name wins.
    """

    def after_at(text):
        """Tails behind each "at" that run to the end in name characters, longest first."""
        words = F.split(text, " ")

        def tails(w):
            found = F.transform(
                w,
                lambda t, i: F.when(
                    F.lower(t).endswith("at") & t.rlike(r"(?iU)(^|\W)at$"),
                    F.array_join(F.slice(w, i + 2, F.size(w)), " "),
                ),
            )
            return F.filter(
                found, lambda t: t.isNotNull() & t.rlike(r"^[A-Za-z0-9&.,'’()/ -]+$")
            )

        return F.transform(let(words, tails), lambda t: strip_chars(squash(t), _EDGE))

    def most_specific_first(text):
        return F.reverse(F.concat(F.array(text), after_at(text)))

    def before_role(text):
        right = F.regexp_extract(text, r"^.*? - (.*)$", 1)
        role = right.rlike(rf"(?iU)\b({_alternation(rules.SPLIT_ROLE_WORDS)})\b")
        left = strip_chars(squash(F.substring_index(text, " - ", 1)), _EDGE)
        return F.when(text.contains(" - ") & role, most_specific_first(left)).otherwise(
            F.array().cast("array<string>")
        )

    def listed(texts):
        return F.concat(F.flatten(F.transform(texts, before_role)), F.reverse(texts))

    def resolve(text):
        ordered = let(F.concat(F.array(text), after_at(text)), listed)
        # the ladder is costly: a text is asked only when none before it gave a name
        return F.aggregate(ordered, _null(), lambda name, t: F.coalesce(name, _own_name(t, owner_name)))

    return let(strip_chars(squash(value), _EDGE), resolve)
