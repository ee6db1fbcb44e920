"""Posting dates. ``as_of`` is always an explicit UTC timestamp, never the clock."""

from functools import reduce

from pyspark.sql import Column, functions as F

from jobflow import rules
from jobflow.functions.text import let, squash, strip

_AGO = r"(\d+)\s*(\+)?\s*(hour|day|week|month)s?\s+ago"
_ISO = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
)
_MAX_DAYS = 700000  # older than this is before year 1
_HOURS = {"hour": 1, "day": 24, "week": 24 * 7, "month": 24 * 30}


def timestamp(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def parse_posted_date(text: Column, as_of, plus_adds_one: bool, lenient_words: bool = False) -> Column:
    """Timestamp of a posting-date text, NULL when it is unknown.

    ``plus_adds_one`` makes "30+ days ago" 31 days; ``lenient_words`` also accepts
    "Posted Today" and "Posted Yesterday".
    """
    now = timestamp(as_of)

    def parse(raw):
        low = F.lower(raw)
        word = F.regexp_replace(low, r"^posted\s+", "") if lenient_words else low
        amount = F.regexp_extract(low, _AGO, 1).try_cast("long")
        if plus_adds_one:
            amount = amount + F.when(F.regexp_extract(low, _AGO, 2) == "+", 1).otherwise(0)
        unit = F.regexp_extract(low, _AGO, 3)
        per_unit = reduce(
            lambda acc, item: acc.when(unit == item[0], item[1]), _HOURS.items(), F.when(F.lit(False), 0)
        )
        hours = F.when(amount <= _MAX_DAYS * 24, amount * per_unit)
        hours = F.when(hours <= _MAX_DAYS * 24, hours)
        ago = now - F.make_dt_interval(F.lit(0), hours.cast("int"))

        iso = F.regexp_replace(F.upper(raw), r"([+-]\d{2})(\d{2})$", "$1:$2")
        iso_ts = F.when(iso.rlike(_ISO), F.try_to_timestamp(iso))
        # a weekday before a year-less date carries no year: it counts as 1900
        yearless = F.regexp_extract(raw, r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)\s+(\d{1,2}-\d{1,2})$", 1)
        weekday_iso = F.regexp_extract(
            raw, r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)\s+(\d{4}-\d{1,2}-\d{1,2})$", 1
        )
        named = F.regexp_replace(raw, r"\s+", " ")
        formats = F.coalesce(
            iso_ts,
            F.when(raw.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(raw, F.lit("M/d/yyyy"))),
            F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(raw, F.lit("yyyy-M-d"))),
            F.when(
                named.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
                F.try_to_timestamp(named, F.lit("MMM d, yyyy")),
            ),
            F.when(
                named.rlike(r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
                F.try_to_timestamp(named, F.lit("MMMM d, yyyy")),
            ),
            F.when(
                yearless != "",
                F.try_to_timestamp(F.concat(F.lit("1900-"), yearless), F.lit("yyyy-M-d")),
            ),
            F.when(weekday_iso != "", F.try_to_timestamp(weekday_iso, F.lit("yyyy-M-d"))),
        )
        return (
            F.when(low.isin(rules.BLANK_DATES), F.lit(None).cast("timestamp"))
            .when(word.isin(rules.TODAY_WORDS), now)
            .when(word == "yesterday", now - F.expr("INTERVAL 1 DAY"))
            .when(low.rlike(_AGO), ago)
            .otherwise(formats)
        )

    return let(strip(F.coalesce(text, F.lit(""))), parse)


def cutoff(as_of, days_old: int) -> Column:
    return timestamp(as_of) - F.make_dt_interval(F.lit(days_old))


def visible_posted_date(text: Column) -> Column:
    """Date wording found in page text: first pattern that hits, else blank."""

    def first_hit(t):
        hits = [
            F.nullif(F.regexp_extract(t, "(?i)" + p, 1), F.lit("")) for p in rules.VISIBLE_DATE_PATTERNS
        ]
        return F.coalesce(*hits, F.lit(""))

    return let(squash(text), first_hit)


def epoch_millis_iso(millis: Column) -> Column:
    """ISO-8601 UTC text of an epoch-milliseconds value; no fraction when it is zero."""
    ts = F.timestamp_millis(millis)
    fraction = F.when(millis % 1000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
