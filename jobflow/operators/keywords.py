"""Keyword lists. Each input row is one user's form, so lists build per row without a shuffle."""

from pyspark.sql import Column, DataFrame, functions as F

from jobflow import rules
from jobflow.functions.text import first_items, let, normalize_key, strip

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]|,"


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value wins, order kept."""

    # sorted by lower-case form and place, repeats stand next to each other
    def by_form(v):
        return F.sort_array(F.transform(v, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("as_is"))))

    def first_only(s):
        kept = F.filter(s, lambda e, i: (i == 0) | (e["low"] != F.get(s, i - 1)["low"]))
        return F.transform(
            F.sort_array(F.transform(kept, lambda e: F.struct(e["at"], e["as_is"]))), lambda e: e["as_is"]
        )

    return let(by_form(values), first_only)


def _pieces(text: Column, separators: str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    cut = F.transform(parts, lambda p: strip(F.substring_index(p, "#", 1)))
    return F.filter(cut, lambda p: p != "")


def parse_keywords(text: Column) -> Column:
    """Keywords of a text split at line feeds and commas; comments cut; repeats dropped."""
    return distinct_ignoring_case(_pieces(text, r"[\n,]"))


def parse_lines(text: Column) -> Column:
    """As ``parse_keywords``, splitting at every line terminator."""
    return distinct_ignoring_case(_pieces(text, _LINES))


def merge_keywords(*lists: Column) -> Column:
    """File keywords, then inline keywords; repeats dropped across both."""
    return distinct_ignoring_case(F.concat(*lists))


def combine_keywords(exact: Column, titles: Column, skills: Column) -> Column:
    """Exact phrases, then every title with every skill of the same form."""

    def pairs(forms):
        combos = F.flatten(
            F.transform(
                forms["titles"],
                lambda t: F.transform(forms["skills"], lambda s: F.concat(t, F.lit(" "), s)),
            )
        )
        return distinct_ignoring_case(F.concat(forms["exact"], combos))

    return let(
        F.struct(
            parse_lines(exact).alias("exact"),
            parse_lines(titles).alias("titles"),
            parse_lines(skills).alias("skills"),
        ),
        pairs,
    )


def first_queries(keywords: Column, n: int | None = None) -> Column:
    """Keywords sent to the secondary sources: all, or the first n."""
    return first_items(keywords, n)


def keyword_preview(df: DataFrame, keywords: str = "keywords", shown: int = 12) -> DataFrame:
    """Total, the first chips and how many more there are."""
    k = F.col(keywords)
    return df.withColumn("total", F.size(k)).withColumn("chips", F.slice(k, 1, shown)).withColumn(
        "more", F.greatest(F.size(k) - shown, F.lit(0))
    )


def signal_terms_of(text: Column, limit: int | None = None) -> Column:
    """Struct(strong, support) of a keyword text, split by line only."""
    lines = F.filter(
        F.transform(
            F.split(F.coalesce(text, F.lit("")), _LINES[: -len("|,")]),
            lambda p: F.lower(strip(F.substring_index(p, "#", 1))),
        ),
        lambda p: p != "",
    )

    def build(ls):
        words = F.flatten(F.transform(ls, lambda p: F.split(p, r"[\t-\r\x1c-\x20\x{85}\p{Z}]+")))
        kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(rules.SIGNAL_STOPWORDS))
        return F.struct(
            first_items(ls, limit).alias("strong"),
            first_items(F.array_distinct(kept), limit).alias("support"),
        )

    return let(lines, build)


def _grams(key: Column) -> Column:
    """Distinct runs of one, two and three characters of a normalised text, in one pass over it."""

    def runs(chars):
        def of(n):
            return F.transform(chars, lambda _, i: F.concat(*(F.get(chars, i + j) for j in range(n))))

        return F.array_compact(F.array_distinct(F.concat(of(1), of(2), of(3))))

    # "" would split into one empty text
    return let(F.filter(F.split(key, ""), lambda c: c != ""), runs)


def held_by(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (key, more columns; distinct, key not empty) with the ``row`` of every text
    (row, body) that holds the key as a substring.

    An index of character runs keeps this an equi-join: every key is posted under the one of its
    three-character runs (the whole key, if shorter) that the fewest texts hold, texts look up their
    own runs, and the substring test decides. No part grows with texts x keys, only with candidates.
    """
    runs = texts.select("row", F.explode(_grams(F.col("body"))).alias("gram"))
    own = F.explode(F.filter(_grams(F.col("key")), lambda g: F.length(g) == F.least(F.length("key"), F.lit(3))))
    parts = keys.withColumn("gram", own)
    held = runs.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"]
    posted = parts.join(held, "gram", "left").groupBy(keys.columns).agg(rarest.alias("gram"))
    found = runs.join(posted, "gram").select("row", *keys.columns).join(texts, "row")
    return found.where(F.col("body").contains(F.col("key"))).select("row", *keys.columns)


def keyword_join(texts: DataFrame, keywords: DataFrame, row: str = "row", text: str = "text",
                 keyword: str = "keyword") -> DataFrame:
    """(row, keyword): every keyword of a table with every text that holds it, by normalised substring.

    Keywords that are null or normalise to nothing match nothing; equal keywords are one; texts with a
    null row id take no part; null texts hold nothing; texts that repeat an id answer as one row. Other
    columns are not read, so their names may clash.
    """
    has = texts.where(F.col(row).isNotNull()).select(F.col(row).alias("row"), normalize_key(F.col(text)).alias("body"))
    keys = keywords.select(F.col(keyword).alias("keyword"), normalize_key(F.col(keyword)).alias("key")).where(
        F.col("keyword").isNotNull() & (F.col("key") != "")).distinct()
    return held_by(has, keys).select("row", "keyword").distinct()


def first_rule(texts: DataFrame, rules_table: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """(row, value): for every row id the value of the first rule (priority, fragment, value) whose
    fragment is a substring of the text; null where none is.

    The form of a rule ladder for rule tables of any size: rules meet texts through the index of
    :func:`held_by`, and the first match is one aggregate, combined before its shuffle. The lowest
    priority wins, ties go to the smaller fragment, then value. Texts and fragments are compared as
    they are. Rules with a null or empty part match nothing; null texts match no rule; null row ids take
    no part; texts that repeat an id answer as one row. Other columns are not read.
    """
    has = texts.where(F.col(row).isNotNull()).select(F.col(row).alias("row"), F.coalesce(text, F.lit("")).alias("body"))
    keys = rules_table.select("priority", F.col("fragment").alias("key"), "value").dropna().where(F.col("key") != "").distinct()
    # both sides of the last join come from one table
    best = held_by(has, keys).groupBy(F.col("row").alias("matched")).agg(F.min(F.struct("priority", "key", "value"))["value"].alias("value"))
    return has.select("row").distinct().join(best, F.col("row") == F.col("matched"), "left").select("row", "value")
