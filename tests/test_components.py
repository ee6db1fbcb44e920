"""Connected components and the entity merge by components against plain models."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from jobflow.operators import dedup
from jobflow.operators.graph import connected_components
from jobflow.schema import BROAD_FIELDS, BROAD_POSTING
from test_entity_merge import random_tables


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    return {x: find(x) for x in list(parent)}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r["node"]: r["component"] for r in connected_components(df).collect()}


@pytest.mark.parametrize("seed,links", [(1, 300), (2, 700), (3, 1500)])
def test_random_graphs(spark, seed, links):
    rng = random.Random(seed)
    pairs = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(links)]
    pairs = [p for p in pairs if p[0] != p[1]]
    assert run(spark, pairs) == union_find(pairs)


def test_long_path_takes_few_rounds(spark, caplog):
    ids = list(range(4000))
    random.Random(4).shuffle(ids)
    with caplog.at_level(logging.INFO, logger="jobflow.operators.graph"):
        got = run(spark, list(zip(ids, ids[1:])))
    assert set(got.values()) == {0} and len(got) == 4000
    assert len(caplog.records) <= 14


def test_sorted_path_and_hub(spark):
    path = [(i, i + 1) for i in range(1, 500)]
    hub = [(1000, 1000 + i) for i in range(1, 20_000)]
    assert run(spark, path + hub) == union_find(path + hub)


def test_repeats_self_links_nulls_and_nothing(spark):
    pairs = [(2, 1), (1, 2), (2, 1), (7, 7), (None, 4), (5, None), (9, 2)]
    assert run(spark, pairs) == {1: 1, 2: 1, 9: 1}
    assert run(spark, []) == {}


def component_model(rows):
    """Union-find over keys, then each component's rows in order."""
    def key(row):
        return "|".join(row[f].lower() for f in ("title", "institution", "location"))

    def rank(row):
        return (bool(row["description"].strip()), bool(row["date_posted"].strip()), len(row["url"].strip()))

    links = []
    for row in rows:
        links.append((("row", row["seq"]), ("identity", key(row))))
        if row["url"]:
            links.append((("row", row["seq"]), ("url", row["url"])))
    parts = union_find([(repr(a), repr(b)) for a, b in links])
    out = {}
    for row in rows:
        part = parts[repr(("row", row["seq"]))]
        if part not in out:
            out[part] = dict(row)
            continue
        entity = out[part]
        better = rank(row) > rank(entity)
        for f in BROAD_FIELDS:
            if row[f].strip() and (not entity[f].strip() or (better and f in dedup.REPLACED_FIELDS)):
                entity[f] = row[f]
    return {e["seq"]: {f: e[f] for f in BROAD_FIELDS} for e in out.values()}


def merged(spark, rows, **extra):
    df = spark.createDataFrame([(r["seq"], *[r[f] for f in BROAD_FIELDS]) for r in rows], BROAD_POSTING)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return {
        r["seq"]: {f: r[f] for f in BROAD_FIELDS}
        for r in dedup.merge_entities(df, mode="component").collect()
    }


def test_random_tables_match_model(spark):
    rows = []
    for t, table in enumerate(random_tables(400, 11)):
        for r in table:
            # texts of a table of their own, so that tables stay apart; the identity without texts joins tables
            r = dict(r, title=f"{r['title']} {t}", url=f"https://h{t}.example.com/{r['url']}" if r["url"] else "")
            rows.append(r)
    assert merged(spark, rows) == component_model(rows)


def test_hot_identity_of_blank_rows(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(600):
        row = dict.fromkeys(BROAD_FIELDS, "")
        row.update(seq=seq, title="" if seq % 3 else f"t{seq}", url=f"https://x.example.com/{rng.randrange(300)}")
        row["description"] = "d%d" % seq if seq % 5 == 0 else ""
        rows.append(row)
    assert merged(spark, rows) == component_model(rows)


def test_component_mode_joins_what_replay_keeps_apart(spark):
    rows = []
    for i, (t, url) in enumerate([("a", "u1"), ("b", "u2"), ("b", "u1"), ("b", "u9"), ("c", "")]):
        rows.append(dict(dict.fromkeys(BROAD_FIELDS, ""), seq=i, title=t, url=url))
    assert set(merged(spark, rows)) == {0, 4}


def test_empty_table_clashing_columns_and_unknown_mode(spark):
    assert merged(spark, []) == {}
    rows = [dict(dict.fromkeys(BROAD_FIELDS, ""), seq=i, title="t", url="u") for i in range(2)]
    clash = {n: F.lit("x") for n in ("entity", "identity", "node", "component", "hub", "url_key")}
    assert set(merged(spark, rows, **clash)) == {0}
    with pytest.raises(ValueError):
        dedup.merge_entities(spark.createDataFrame([], BROAD_POSTING), mode="other")
