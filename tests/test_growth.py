"""What must not grow with the tables: single tasks, patterns asked of every text, pages held at once."""

import pandas as pd
from pyspark.sql import functions as F

from jobflow.fixtures import dealt, postings_docs
from jobflow.functions import html, names
from jobflow.operators import dedup
from jobflow.operators.indexing import with_row_index
from jobflow.plans import catalog, searches
from jobflow.schema import BROAD_FIELDS


def test_a_small_file_of_names_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path)
    rows = [(k, f"Acme{k} - Simulation Engineer opening", "x", "y") for k in range(64)] + [(None, None, None, None), (3, "Acme3", "x", "y")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(f"{path}/part.parquet")
    read = spark.read.parquet(f"{path}/part.parquet")
    assert read.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert dealt(read).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    found = catalog.load_all()[0]["candidate_names"](spark, path)
    assert found.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert found.count() == 66


def test_row_patterns_are_asked_behind_their_openings_only(spark):
    rows = ["THANK YOU FOR APPLYING TO Acme!", "tHanKſ for applying to Zoox!", "your applıcatİon at Ansys now", "nothing to see", "Moog @ icims"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, row string")
    asked = df.select("i", names.row_candidates(F.col("row")).alias("found"))
    assert asked._jdf.queryExecution().analyzed().toString().lower().count("contains(") >= len(names.row_patterns())
    got = [set(r.found) for r in asked.orderBy("i").collect()]
    assert [name in g for name, g in zip(["Acme", "Zoox", "Ansys", "", "Moog"], got)] == [True, True, True, False, True]


def test_pages_are_parsed_in_small_pieces():
    pieces = list(html.slices([pd.Series(range(300)), pd.Series([], dtype=object), pd.Series(range(5))], 128))
    assert [len(p) for p in pieces] == [128, 128, 44, 5]
    assert [x for p in pieces for x in p] == [*range(300), *range(5)]


def test_sources_of_any_places_are_sorted_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(searches, "with_row_index", lambda *a: calls.append(a[1]) or with_row_index(*a))
    fields = ", ".join(f"{f} string" for f in BROAD_FIELDS)

    def source(kind, name, places):
        rows = [(p, *[f"{t}" if f == "title" else None for f in BROAD_FIELDS]) for p, t in places]
        return spark.createDataFrame(rows, f"{name} {kind}, {fields}")

    frames = [
        source("long", "seq", [(9, "b"), (-3, "a"), (10, "c")]), source("string", "at", [("9", "f"), ("10", "e"), (None, "d")]),
        source("long", "at", [(2, "h"), (1, "g")]), source("struct<x: int, y: string>", "at", [((2, "a"), "j"), ((1, "z"), "i")]),
    ]
    got = searches.sequence_sources(frames)
    assert len(calls) == 1 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(10)) and "".join(r.title for r in rows) == "abcdefghij"
    assert {r.url for r in rows} == {""}


def test_rounds_of_the_entity_merge_carry_no_texts(spark):
    facts = dedup.entity_facts(postings_docs(spark, "/root/testdata/sf0.001"))
    assigned, _ = dedup.assign_entities(facts)
    assert assigned.count() == facts.count()
    assert {kind for _, kind in assigned.dtypes} <= {"bigint", "int"}
