"""Run logs followed line by line: numbers, progress and the tail of every run, batch after batch.

Every batch of a stream is one batch job: its lines are numbered by ``operators.runlog.log_progress``,
in chunks, from where the batch before left off, so a run that holds most of the lines spreads over
many tasks, which one state per run could not. What is carried between batches is a table of one
row per run (lines seen, jobs found, last progress and message, the last lines).

Below ``folder`` a batch writes ``lines/epoch=n`` and ``state/epoch=n`` and reads nothing but its own
lines and ``state/epoch=n-1``. A batch that is run again after a failure replaces what it wrote, and
the two newest states are kept, whatever the number of batches.

Lines of a later batch come after those of earlier ones; inside a batch ``line_no`` decides. Blank and null
lines, and lines without a run, count for nothing.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobflow.functions.text import is_blank
from jobflow.operators.runlog import TAIL_LINES, log_progress
from jobflow.session import cut_lineage, discard, scratch_path

STATE = "run_id {run_type}, n long, jobs_found long, progress int, message string, tail array<string>"


def _last(lines: Column, keep: int) -> Column:
    return F.slice(lines, F.greatest(F.size(lines) - keep + 1, F.lit(1)), keep)


def next_state(before: DataFrame, lines: DataFrame, keep: int, aside: list) -> DataFrame:
    """The state after ``lines``, numbered lines of one batch: one row per run ever seen.

    At most ``keep`` lines of a run are brought together.
    """
    newest = lines.groupBy("run_id").agg(
        F.max("n").alias("new_n"), F.max("jobs_found").alias("new_found"),
        F.max_by(F.struct("progress", "message"), "n").alias("new"),
    )
    # written, so that the join with the lines has an exchange that a hot run's lines can be split at
    newest = cut_lineage(newest, aside)
    tails = lines.join(newest.select("run_id", "new_n"), "run_id").where(F.col("n") > F.col("new_n") - keep).groupBy(
        "run_id"
    ).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("fresh"))
    fresh = newest.join(tails, "run_id").withColumn("fresh", F.col("fresh.line"))
    none = F.array().cast("array<string>")
    return before.join(fresh, "run_id", "full").select(
        "run_id",
        F.coalesce("new_n", "n").alias("n"),
        F.coalesce("new_found", "jobs_found").alias("jobs_found"),
        F.coalesce("new.progress", "progress").alias("progress"),
        F.coalesce("new.message", "message").alias("message"),
        _last(F.concat(F.coalesce("tail", none), F.coalesce("fresh", none)), keep).alias("tail"),
    )


def fold_batch(batch: DataFrame, epoch: int, folder: str, keep: int = TAIL_LINES, chunk_rows: int = 1_000_000) -> None:
    """Number the lines of batch ``epoch`` and write them and the state after them."""
    spark = batch.sparkSession
    state = STATE.format(run_type=batch.schema["run_id"].dataType.simpleString())
    before = spark.createDataFrame([], state) if epoch == 0 else spark.read.schema(state).parquet(
        f"{folder}/state/epoch={epoch - 1}"
    )
    batch = batch.select("run_id", "line_no", "line").where(F.col("run_id").isNotNull() & ~is_blank(F.col("line")))
    at = f"{folder}/lines/epoch={epoch}"
    numbered = log_progress(batch, chunk_rows, before)
    numbered.write.mode("overwrite").parquet(at)
    aside: list = []
    after = next_state(before, spark.read.schema(numbered.schema).parquet(at), keep, aside)
    after.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")
    discard(spark, aside)
    if epoch > 1:
        discard(spark, [f"{folder}/state/epoch={epoch - 2}"])


def follow_lines(log: DataFrame, folder: str, checkpoint: str, keep: int = TAIL_LINES, chunk_rows: int = 1_000_000):
    """Start a query over the lines (run_id, line_no, line) available now; start it again to go on.

    ``folder`` and ``checkpoint`` belong together: a new checkpoint wants a new folder.
    """
    return (
        log.writeStream
        .foreachBatch(lambda batch, epoch: fold_batch(batch, epoch, folder, keep, chunk_rows))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line so far with n, progress, message and jobs_found."""
    return spark.read.parquet(f"{folder}/lines").drop("epoch")


def newest_lines_state(spark: SparkSession, folder: str) -> DataFrame:
    """State after the last batch: run_id, n, jobs_found, progress, message, tail (the last lines as one text)."""
    states = spark.read.parquet(f"{folder}/state")
    last = states.agg(F.max("epoch")).first()[0]
    return states.where(F.col("epoch") == last).drop("epoch").withColumn("tail", F.array_join("tail", "\n"))


def follow_to_end(log: DataFrame, **options) -> str:
    """Follow everything available and return the folder."""
    spark = log.sparkSession
    folder = scratch_path(spark, "run-lines")
    follow_lines(log, folder, scratch_path(spark, "run-lines-checkpoint"), **options).awaitTermination()
    return folder
