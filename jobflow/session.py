"""Session helpers: the shared folder for checkpoints and written tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="jobflow-")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, written: list | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later steps neither recompute it nor lose it with an executor, and the planner knows its
    size. The path is added to ``written`` so that a loop can discard tables it is done with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """(path, file system) of the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, paths) -> None:
    """Delete written tables that no later step reads."""
    for path in paths:
        target, store = _store(spark, path)
        store.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> str | None:
    """Make a folder; where the system mounts it for every process (a ``file`` path), its name there."""
    target, store = _store(spark, path)
    store.mkdirs(target)
    there = store.makeQualified(target).toUri()
    return there.getPath() if there.getScheme() == "file" else None
