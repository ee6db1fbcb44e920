"""Physical plans: what must be pushed down, pruned and kept out of single tasks."""

import pytest
from pyspark.sql import functions as F

from jobflow.fixtures import postings_docs, table
from jobflow.operators import dedup, filters, metrics

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    text = plan(metrics.source_counts(postings_docs(spark, SF)))
    assert "ReadSchema: struct<source:string>" in text


def test_joins_on_hot_entities_can_be_split(spark):
    """80 % of the rows in one entity: both sides of the join are exchanges, and AQE splits the hot one."""
    rows = spark.range(60_000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id")).alias("entity"),
        F.lit(3).alias("filled"), F.lit(1).alias("url_len"), F.sha2(F.col("id").cast("string"), 512).alias("url_key"),
    ).repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = dedup._with_entity_times(rows, [])
        assert df.count() == 60_000
        df.collect()
        assert "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_filters_add_no_shuffle(spark):
    df = table(spark, SF, "documents").select(F.col("text").alias("title"), F.lit("").alias("description"))
    assert "Exchange" not in plan(filters.filter_restricted(df))


def test_two_pass_has_no_window_and_no_cartesian_product(spark):
    text = plan(dedup.dedupe_two_pass(postings_docs(spark, SF)))
    assert "Window" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("rows", [1, 7, 100])
def test_row_index_is_dense(spark, rows):
    from jobflow.operators.indexing import with_row_index

    df = spark.range(rows).select((F.col("id") * 7 % 101).alias("k"))
    got = with_row_index(df, ["k"], partitions=5).orderBy("k").collect()
    assert [r.row_index for r in got] == list(range(rows))


def test_stages_of_a_run_are_counted_in_one_scan_each_of_two_tables(spark, monkeypatch):
    from jobflow.plans import searches

    monkeypatch.setattr(dedup, "merge_entities", lambda postings: postings)
    run = searches.broad_run([postings_docs(spark, SF)], "2024-01-31 00:00:00", phrases=["license"])
    assert plan(run.funnel).count("Scan parquet") == 2
    rows = {r["stage"]: r["rows"] for r in run.funnel.collect()}
    result = run.result
    assert rows == {
        "raw": run.postings.count(), "merged": result.merged.count(),
        "recent": result.recent.count(), "clean": result.clean.count(),
    }
    assert rows["clean"] <= rows["recent"] <= rows["merged"]
