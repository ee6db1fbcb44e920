"""Uploaded profile files, one folder each."""

import os

import pytest
from pyspark.sql import functions as F

from jobflow.sinks import writers
from jobflow.sources import files


def test_folders_are_listed_by_some_tasks_per_core(spark, tmp_path):
    n = 10 * spark.sparkContext.defaultParallelism
    path = str(tmp_path / "profiles")
    spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("value")).coalesce(1).write.partitionBy("id").text(path)
    setting = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    sc = spark.sparkContext
    sc.setJobGroup("profiles", "profiles")
    try:
        read = files.read_profiles(spark, path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("profiles") for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == setting
    assert {r.text for r in read.collect()} == {f"text {i}\n" for i in range(n)}


def test_small_files_are_read_by_some_tasks_per_core(spark, tmp_path):
    some = 4 * spark.sparkContext.defaultParallelism
    (tmp_path / "folder=1").mkdir()
    for k in range(some * 50):  # Spark's own number is a task per 32 of them
        (tmp_path / "folder=1" / f"{k}.md").write_text(f"text {k}")
    read = files.read_profiles(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= some
    assert {r.text for r in read.collect()} == {f"text {k}" for k in range(some * 50)}


@pytest.mark.parametrize("mounted", [True, False])
def test_a_file_per_key_in_some_folders(spark, tmp_path, monkeypatch, mounted):
    rows = [(k, f"text {k}\né" if k % 3 else "") for k in range(700)] + [(7, "again"), (None, "no key"), (8, None)]
    if not mounted:
        monkeypatch.setattr(writers, "make_folder", lambda spark, path: None)
    path = str(tmp_path / "files")
    writers.write_text_per(spark.createDataFrame(rows, "k long, value string").repartition(5), "k", path)
    want = {}
    for k, value in rows:
        want.setdefault("__HIVE_DEFAULT_PARTITION__" if k is None else str(k), []).append(value or "")
    found = files.read_profiles(spark, path).select(F.regexp_extract("path", r"k=(\w+)", 1).alias("k"), "text").collect()
    assert len(found) == len(want) == len({r.k for r in found})
    for r in found:
        if len(want[r.k]) == 1:
            assert r.text == want[r.k][0] + "\n"
        else:
            assert sorted(r.text) == sorted("".join(v + "\n" for v in want[r.k]))
    if mounted:
        folders = os.listdir(path)
        assert len(folders) <= writers.FOLDERS
        assert all(name.startswith("k=") and name.endswith(".txt") for f in folders for name in os.listdir(f"{path}/{f}"))


def test_no_rows_make_an_empty_folder(spark, tmp_path):
    path = str(tmp_path / "none")
    writers.write_text_per(spark.createDataFrame([], "k long, value string"), "k", path)
    assert files.read_profiles(spark, path).count() == 0
