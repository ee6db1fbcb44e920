"""Run-log progress as a Structured Streaming query."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.functions.text import is_blank
from jobflow.operators.runlog import line_progress, reported_total
from jobflow.session import scratch_path


def running_state(log: DataFrame) -> DataFrame:
    """Streaming (or batch) state per run: lines seen, jobs found, last line's progress.

    The state kept per run is one number of lines, one maximum and the latest line.
    """
    lines = log.where(~is_blank(F.col("line")))
    state = lines.groupBy("run_id").agg(
        F.count("*").alias("n"), F.coalesce(F.max(reported_total(F.col("line"))), F.lit(0)).alias("jobs_found"),
        F.max_by("line", "line_no").alias("line"),
    )
    return state.withColumn("state", line_progress(F.col("line"), F.col("n"))).select(
        "run_id", "n", "jobs_found", "state.progress", "state.message"
    )


def write_running_state(log: DataFrame, path: str, checkpoint: str):
    """Start a query that adds, per batch, the runs whose state changed; available data only.

    A batch has a folder of its own, so one that is run again replaces itself and nothing else.
    """

    def save(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        running_state(log).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """The last written state of every run."""
    rows = spark.read.parquet(path)
    state = F.struct("n", "jobs_found", "progress", "message")
    return rows.groupBy("run_id").agg(F.max_by(state, "epoch").alias("s")).select("run_id", "s.*")


def run_to_end(log: DataFrame) -> DataFrame:
    """Drive the stream over everything available and return the stored state."""
    spark = log.sparkSession
    path = scratch_path(spark, "run-state")
    write_running_state(log, path, scratch_path(spark, "run-checkpoint")).awaitTermination()
    return newest_state(spark, path)
