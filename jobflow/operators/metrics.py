"""Counts and summaries of a result."""

from pyspark.sql import DataFrame, functions as F


def source_counts(df: DataFrame, blank_as_null: bool = True, column: str = "source") -> DataFrame:
    """Postings per source, most first; ties by name."""
    source = F.nullif(F.col(column), F.lit("")) if blank_as_null else F.col(column)
    return (
        df.groupBy(F.coalesce(source, F.lit("unknown")).alias("source"))
        .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source")
    )


def result_metrics(df: DataFrame, blank_as_null: bool = True) -> DataFrame:
    """One row: jobs, distinct companies, distinct sources, postings with a date.

    A column that the result does not have counts as empty.
    """
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("institution", "source", "date_posted") if c not in df.columns})

    def value(c):
        return F.nullif(F.col(c), F.lit("")) if blank_as_null else F.col(c)

    return df.agg(
        F.count("*").alias("jobs"),
        F.count_distinct(value("institution")).alias("companies"),
        F.count_distinct(value("source")).alias("sources"),
        F.count_if(F.length("date_posted") > 0).alias("with_date"),
    )


def preview(df: DataFrame, order, n: int | None = None) -> DataFrame:
    """Rows in a declared order (the first n where asked), NULL shown as blank."""
    ordered = df.orderBy(*order)
    return (ordered if n is None else ordered.limit(n)).fillna("")


def stage_funnel(df: DataFrame, stages: dict) -> DataFrame:
    """Rows left after each stage, in one pass; ``stages`` maps name -> Column, in order."""
    kept, out = F.lit(True), [F.count("*").alias("raw")]
    for name, passes in stages.items():
        kept = kept & passes
        out.append(F.count_if(kept).alias(name))
    return df.agg(*out)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources in one frame; a column a source lacks is blank."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.fillna("")
