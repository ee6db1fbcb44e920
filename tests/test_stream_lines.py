"""Run logs followed line by line over several batches and a restart, against the batch operators."""

import random

import pytest

from jobflow.operators import runlog
from jobflow.streaming import runlines

SCHEMA = "run_id long, line_no long, line string"
WORDS = ["linkedin search", "Indeed page", "google", "dedup", "saving", "total: 7", "TOTAL:  120", "step", "", "  ", None]


def some_lines(n, seed):
    """Two thirds of the lines are of run 1; run 9 begins late; a line without a run."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3] + ([9] if i > n // 2 else [])), i, rng.choice(WORDS)) for i in range(n)]
    return [*rows, (None, n, "indeed")]


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_batches_and_restart_equal_the_batch_operators(spark, tmp_path):
    rows = some_lines(900, 1)
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = [rows[:200], rows[200:210], rows[210:600], rows[600:]]
    for i, part in enumerate(parts[:3]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{source}/{i}")
    runlines.follow_lines(stream(spark, source), folder, checkpoint, keep=80, chunk_rows=50).awaitTermination()
    spark.createDataFrame(parts[3], SCHEMA).coalesce(1).write.parquet(f"{source}/3")
    runlines.follow_lines(stream(spark, source), folder, checkpoint, keep=80, chunk_rows=50).awaitTermination()

    whole = spark.createDataFrame(rows, SCHEMA).where("run_id is not null")
    want = runlog.log_progress(whole)
    lines = runlines.written_lines(spark, folder)
    assert rows_of(lines) == rows_of(want)
    state = runlines.newest_lines_state(spark, folder)
    assert rows_of(state.select("run_id", "tail")) == rows_of(runlog.log_tail(whole, 80))
    assert rows_of(state.select("run_id", "progress", "message", "jobs_found")) == rows_of(runlog.latest_state(want))
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir()) == ["epoch=2", "epoch=3"]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows, folder = some_lines(120, 2), str(tmp_path / "out")
    for epoch, part in [(0, rows[:60]), (1, rows[60:]), (1, rows[60:])]:
        runlines.fold_batch(spark.createDataFrame(part, SCHEMA), epoch, folder, keep=5)
    whole = spark.createDataFrame(rows, SCHEMA).where("run_id is not null")
    assert rows_of(runlines.written_lines(spark, folder)) == rows_of(runlog.log_progress(whole))
    tails = runlines.newest_lines_state(spark, folder).select("run_id", "tail")
    assert rows_of(tails) == rows_of(runlog.log_tail(whole, 5))


@pytest.mark.parametrize("rows", [[], [(1, 0, " "), (None, 1, "indeed"), (2, 2, None)]])
def test_batches_without_lines(spark, tmp_path, rows):
    folder = str(tmp_path / "out")
    runlines.fold_batch(spark.createDataFrame(rows, SCHEMA), 0, folder)
    assert runlines.written_lines(spark, folder).count() == 0
    runlines.fold_batch(spark.createDataFrame([(1, 3, "total: 4")], SCHEMA), 1, folder)
    state = runlines.newest_lines_state(spark, folder).collect()
    assert [(r["run_id"], r["n"], r["jobs_found"], r["tail"]) for r in state] == [(1, 1, 4, "total: 4")]
