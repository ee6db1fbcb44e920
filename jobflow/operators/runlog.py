"""Run-log lines to progress."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobflow import rules
from jobflow.functions.text import any_contains, is_blank

TAIL_LINES = 80


def line_progress(line: Column, n: Column) -> Column:
    """Struct(progress, message) of a line that is the n-th non-blank line of its run."""
    low, out = F.lower(line), None
    for any_of, all_of, lo, hi, message in rules.PROGRESS_RULES:
        hit = reduce(lambda a, b: a & b, [low.contains(w) for w in all_of], any_contains(low, any_of))
        state = F.struct(
            F.greatest(F.lit(lo), F.least(F.lit(hi), n.cast("int"))).alias("progress"), F.lit(message).alias("message")
        )
        out = F.when(hit, state) if out is None else out.when(hit, state)
    return out.otherwise(F.struct(
        F.least(F.lit(72), 8 + F.floor(n / 3)).cast("int").alias("progress"),
        F.concat(F.lit("Searching… ("), n.cast("string"), F.lit(" steps)")).alias("message"),
    ))


def reported_total(line: Column) -> Column:
    return F.regexp_extract(F.lower(line), r"total:\s*(\d+)", 1).try_cast("long")


def log_progress(log: DataFrame, chunk_rows: int = 1_000_000, before: DataFrame | None = None) -> DataFrame:
    """Non-blank lines with n, progress, message and jobs_found (running maximum of totals).

    Numbers run per (run, chunk of line numbers) and are completed by chunk summaries, so a run
    that holds most of the lines spreads over many tasks. ``before`` (run_id, n, jobs_found), one row
    per run, is where earlier lines left off; runs that it lacks start at nothing.
    """
    lines = (
        log.where(~is_blank(F.col("line")))
        .withColumn("chunk", F.floor(F.col("line_no") / chunk_rows))
        .withColumn("total", reported_total(F.col("line")))
    )
    chunks_before = Window.partitionBy("run_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lines.groupBy("run_id", "chunk").agg(
        F.count("*").alias("rows"), F.max("total").alias("top")
    ).select(
        "run_id", "chunk", F.coalesce(F.sum("rows").over(chunks_before), F.lit(0)).alias("n_before"),
        F.max("top").over(chunks_before).alias("top_before"),
    )
    w = Window.partitionBy("run_id", "chunk").orderBy("line_no")
    inside = lines.withColumn("at", F.row_number().over(w)).withColumn(
        "top", F.max("total").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    numbered = inside.join(earlier, ["run_id", "chunk"])
    if before is None:
        before_n = before_top = F.lit(0)
    else:
        numbered = numbered.join(
            before.select("run_id", F.col("n").alias("seen_n"), F.col("jobs_found").alias("seen_top")), "run_id", "left"
        )
        before_n, before_top = F.coalesce("seen_n", F.lit(0)), F.coalesce("seen_top", F.lit(0))
    return (
        numbered.withColumn("n", before_n + F.col("n_before") + F.col("at"))
        .withColumn("state", line_progress(F.col("line"), F.col("n")))
        .select(
            "run_id", "line_no", "line", "n", "state.progress", "state.message",
            F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("top_before", F.lit(0)), before_top).alias("jobs_found"),
        )
    )


def log_tail(log: DataFrame, keep: int) -> DataFrame:
    """Last ``keep`` lines of every run as one text."""
    w = Window.partitionBy("run_id").orderBy(F.desc("line_no"))
    last = log.where(~is_blank(F.col("line"))).withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)
    return last.groupBy("run_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda e: e["line"]), "\n"
        ).alias("tail")
    )


def latest_state(progress: DataFrame) -> DataFrame:
    """Last known state of every run."""
    return progress.groupBy("run_id").agg(
        F.max(F.struct("line_no", "progress", "message")).alias("last"), F.max("jobs_found").alias("jobs_found")
    ).select("run_id", "last.progress", "last.message", "jobs_found")


def remaining_time(states: DataFrame, started: DataFrame, as_of) -> DataFrame:
    """States plus the seconds left and their wording, once a run is past 8 percent."""
    elapsed = F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6 - F.unix_micros("started_at") / 1e6
    left = F.greatest(F.lit(0.0), elapsed / (F.col("progress") / 100) - elapsed)
    known = states.join(started, "run_id").withColumn("left", F.when(F.col("progress") > 8, left))
    minutes = F.floor(F.col("left") / 60).cast("string")
    text = F.when(
        F.col("left") > 60, F.concat(F.lit("~"), minutes, F.lit("m "), F.floor(F.col("left") % 60).cast("string"), F.lit("s remaining"))
    ).otherwise(F.concat(F.lit("~"), F.floor("left").cast("string"), F.lit("s remaining")))
    return known.withColumn("remaining", F.coalesce(text, F.lit(""))).drop("started_at")
