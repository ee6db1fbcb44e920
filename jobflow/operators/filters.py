"""Predicates and filters over postings. All are narrow: they add no shuffle."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jobflow import rules
from jobflow.functions.dates import cutoff, parse_posted_date
from jobflow.functions.text import (
    quoted, any_contains, is_blank, let, normalize_key, squash,
)
from jobflow.functions.urls import clean_url


def build_posting(df: DataFrame, scraped_at: str, **fields) -> DataFrame:
    """Company posting rows from raw columns; ``fields`` maps field -> Column."""

    def text_of(name):
        return F.coalesce(fields[name], F.lit(""))

    return df.select(
        *([F.col("seq")] if "seq" in df.columns else []),
        squash(text_of("title")).alias("title"),
        text_of("institution").alias("institution"),
        squash(text_of("location")).alias("location"),
        clean_url(text_of("url")).alias("url"),
        squash(text_of("description")).alias("description"),
        text_of("source").alias("source"),
        text_of("date_posted").alias("date_posted"),
        F.lit(scraped_at).alias("scraped_at"),
        text_of("career_page").alias("career_page"),
        text_of("ats_platform").alias("ats_platform"),
    )


def is_recent_broad(date_posted: Column, as_of, days_old: int = 30, strict: bool = True) -> Column:
    """At most ``days_old`` days old (broad rules); an unknown date counts only when not strict."""
    posted = parse_posted_date(date_posted, as_of, plus_adds_one=False)
    return let(posted, lambda d: F.coalesce(d >= cutoff(as_of, days_old), F.lit(not strict)))


def filter_recent(df: DataFrame, as_of, days_old: int = 30, strict: bool = True) -> DataFrame:
    """Postings at most ``days_old`` days old; unknown dates stay only when not strict."""
    return df.where(is_recent_broad(F.col("date_posted"), as_of, days_old, strict))


def is_recent(date_posted: Column, as_of, days_old: int = 30) -> Column:
    """Known and recent (company rules: "30+ days" counts as 31)."""
    posted = parse_posted_date(date_posted, as_of, plus_adds_one=True)
    return F.coalesce(posted >= cutoff(as_of, days_old), F.lit(False))


def is_restricted(title: Column, description: Column, phrases=None, word_boundary: bool = False) -> Column:
    """Title or description holds a citizenship, clearance or export phrase."""
    phrases = rules.RESTRICTION_PHRASES if phrases is None else phrases
    text = F.lower(F.concat_ws(" ", title, description))
    if not word_boundary:
        return let(text, lambda t: any_contains(t, phrases))
    return text.rlike(r"\b(?:" + "|".join(map(quoted, phrases)) + r")\b")


def filter_restricted(df: DataFrame, phrases=None, word_boundary: bool = False) -> DataFrame:
    return df.where(~is_restricted(F.col("title"), F.col("description"), phrases, word_boundary))


def _key(term: str) -> str:
    """Fixed-list form of ``normalize_key`` for terms the caller passes in."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in term.lower())
    return " ".join(kept.split())


def signal_terms(keyword_lines, limit: int | None = None):
    """Phrases and words that signal relevance, from the user's keyword lines.

    The list is what one user typed, so it is handled as a parameter, not as data.
    """
    lines = [line.split("#")[0].strip().lower() for line in keyword_lines]
    lines = [line for line in lines if line]
    words = [
        w for line in lines for w in line.split() if len(w) > 2 and w not in rules.SIGNAL_STOPWORDS
    ]
    return lines[:limit], list(dict.fromkeys(words))[:limit]


def keyword_match(title: Column, description: Column, keywords, strong=(), support=()) -> Column:
    """Relevance of a posting: a phrase anywhere, or a title word plus two description words."""
    phrases = [k for k in (_key(t) for t in [*keywords, *strong]) if k]
    words = [k for k in (_key(t) for t in support) if k]

    def hits(text):
        return reduce(
            lambda a, b: a + b, [text.contains(w).cast("int") for w in words], F.lit(0)
        )

    def decide(keys):
        haystack, t, d = keys["both"], keys["title"], keys["description"]
        phrase = any_contains(haystack, phrases) if phrases else F.lit(False)
        return phrase | ((hits(t) >= 1) & (hits(d) >= 2))

    return let(
        F.struct(
            normalize_key(F.concat_ws(" ", title, description)).alias("both"),
            normalize_key(title).alias("title"),
            normalize_key(description).alias("description"),
        ),
        decide,
    )


def looks_like_job_title(title: Column) -> Column:
    """A role title: no page heading, no role outside the target, and a role word in it."""
    starts = "|".join(rules.NON_JOB_TITLE_STARTS)
    words = "|".join(rules.NON_TARGET_TITLE_WORDS)
    return let(
        F.lower(squash(title)),
        lambda t: (t != "")
        & ~t.rlike(rf"(?U)^(?:{starts})\b")
        & ~t.rlike(rf"(?U)\b(?:{words})\b")
        & any_contains(t, rules.ROLE_TOKENS),
    )


def location_allowed(location: Column, states_first: bool = False) -> Column:
    """Blank, remote or US locations."""

    def decide(key):
        tokens = F.split(key, " ")
        last = F.element_at(tokens, -1)
        before = F.try_element_at(tokens, F.lit(-2))
        state_after_comma = location.contains(",") & last.isin(rules.US_STATE_TOKENS)
        out = F.when(key == "", True).when(key.contains("remote"), True)
        out = out.when(key.contains("united states") | last.isin("us", "usa"), True)
        if states_first:
            out = out.when(state_after_comma, True)
        return (
            out.when(last.isin(rules.NON_US_COUNTRY_TOKENS), False)
            .when(state_after_comma, True)
            .otherwise(
                (F.size(tokens) >= 2)
                & last.isin(rules.US_STATE_TOKENS)
                & ~F.coalesce(before, F.lit("")).isin(rules.NON_US_COUNTRY_TOKENS)
            )
        )

    return let(normalize_key(location), decide)


def filter_postings(df: DataFrame, as_of, keywords, strong=(), support=(), days_old: int = 30) -> DataFrame:
    """Company filter: job title, location, relevance, recency. Cheap predicates come first."""
    return (
        df.where(looks_like_job_title(F.col("title")))
        .where(location_allowed(F.col("location")))
        .where(is_recent(F.col("date_posted"), as_of, days_old))
        .where(keyword_match(F.col("title"), F.col("description"), keywords, strong, support))
    )


def blocked_companies(df: DataFrame, blocked=None, column: str = "company") -> DataFrame:
    """Drop companies whose normalised name is on the block list (a fixed list: no join)."""
    names = rules.BLOCKED_COMPANIES if blocked is None else blocked
    return df.where(~normalize_key(F.col(column)).isin(names))


def select_topic_keywords(df: DataFrame, topics, column: str = "keyword") -> DataFrame:
    """Keywords a topical source should be asked for."""
    return df.where(any_contains(F.col(column), topics))


def split_empty_descriptions(df: DataFrame):
    """(postings with a description, urls of the others where the url is not blank)."""
    empty = is_blank(F.col("description"))
    return df.where(~empty), df.where(empty & (F.coalesce(F.col("url"), F.lit("")) != "")).select("url")


def order_result_columns(df: DataFrame) -> DataFrame:
    """Score columns first, the rest in place."""
    first = [c for c in ("ai_score", "ai_reason") if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def column_titles(df: DataFrame) -> dict:
    """Display title of each column id."""
    return {c: c.replace("_", " ").title() for c in df.columns}


def result_page(df: DataFrame, page: int, order_by, where: Column | None = None, page_size: int = 12) -> DataFrame:
    """One page of the results table under a filter and a sort."""
    rows = df if where is None else df.where(where)
    return rows.orderBy(*order_by).offset(page_size * page).limit(page_size)
