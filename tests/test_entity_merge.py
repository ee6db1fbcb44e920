"""Entity merge against an independent one-row-at-a-time model on many random tables."""

import random

import pytest
from pyspark.sql import functions as F

from jobflow.operators import dedup
from jobflow.schema import BROAD_FIELDS, BROAD_POSTING

REPLACED = dedup.REPLACED_FIELDS


def model(rows):
    """Sequential reference: list of entities as dicts, in creation order."""
    known_url, known_id, out = {}, {}, []

    def key(row):
        return row["scope"] + "|".join(row[f].lower() for f in ("title", "institution", "location"))

    def rank(row):
        return (bool(row["description"].strip()), bool(row["date_posted"].strip()), len(row["url"].strip()))

    for row in rows:
        at = known_url.get((row["scope"], row["url"])) if row["url"] else None
        if at is None:
            at = known_id.get(key(row))
        if at is None:
            at = len(out)
            out.append(dict(row))
        else:
            entity, better = out[at], rank(row) > rank(out[at])
            for f in BROAD_FIELDS:
                if row[f].strip() and (not entity[f].strip() or (better and f in REPLACED)):
                    entity[f] = row[f]
        if out[at]["url"]:
            known_url[(out[at]["scope"], out[at]["url"])] = at
        known_id[key(out[at])] = at
    return out


def random_tables(n, seed, rows=(4, 14)):
    rng = random.Random(seed)
    tables, seq = [], 0
    for t in range(n):
        table = []
        for _ in range(rng.randint(*rows)):
            row = dict.fromkeys(BROAD_FIELDS, "")
            row.update(
                seq=seq, scope=f"t{t}:",
                title=rng.choice(["", "", "a", "b"]), institution=rng.choice(["", "x", "y"]),
                location=rng.choice(["", "", "k"]), url=rng.choice(["", "1", "2", "33", "44", "555"]),
                description=rng.choice(["", "d%d" % seq]), date_posted=rng.choice(["", "p%d" % seq]),
                source=rng.choice(["", "s%d" % seq]), currency=rng.choice(["", "c%d" % seq]),
            )
            table.append(row)
            seq += 1
        tables.append(table)
    return tables


def run_scoped(spark, tables, chunk_rows):
    """Merge all tables in one run; keys carry the table's scope so that tables stay apart."""
    rows = [r for t in tables for r in t]
    df = spark.createDataFrame([(r["seq"], *[r[f] for f in BROAD_FIELDS]) for r in rows], BROAD_POSTING)
    scope = spark.createDataFrame([(r["seq"], r["scope"]) for r in rows], "seq long, scope string")
    facts = dedup.entity_facts(df).join(scope, "seq")
    facts = facts.withColumn("title_key", F.concat("scope", "title_key")).withColumn(
        "url_key", F.when(F.col("url_key") != "", F.concat("scope", "url_key")).otherwise("")
    ).drop("scope")
    assigned, paths = dedup.assign_entities(facts, chunk_rows)
    donors = dedup.entity_donors(assigned, paths)
    by_seq = {r["seq"]: r for r in rows}
    got = {}
    for d in donors.collect():
        got[d["entity"]] = {f: by_seq[d[f]][f] for f in BROAD_FIELDS}
    return got


@pytest.mark.parametrize("seed,chunk", [(1, 3), (2, 1_000_000)])
def test_random_tables_match_sequential_model(spark, seed, chunk):
    tables = random_tables(1500, seed)
    got = run_scoped(spark, tables, chunk)
    want = {}
    for t in tables:
        for e in model(t):
            want[e["seq"]] = {f: e[f] for f in BROAD_FIELDS}
    assert set(got) == set(want)
    bad = [k for k in want if got[k] != want[k]]
    assert not bad, (len(bad), [(k, got[k], want[k]) for k in bad[:3]])


def test_one_hot_identity_and_one_long_table(spark):
    """All rows of one table share few keys: the hot-group case."""
    tables = random_tables(1, 5, rows=(400, 400))
    got = run_scoped(spark, tables, 50)
    want = {e["seq"]: {f: e[f] for f in BROAD_FIELDS} for e in model(tables[0])}
    assert got == want


GOLDEN = [
    ("", "", "k", "1", ""), ("a", "", "z", "1", ""), ("", "", "k", "22", "text"),
    ("b", "x", "z", "22", ""), ("a", "x", "k", "5", ""),
]


def test_golden_hybrid_rows_give_one_entity(spark):
    rows = []
    for i, (t, inst, loc, url, desc) in enumerate(GOLDEN):
        r = dict.fromkeys(BROAD_FIELDS, "")
        r.update(title=t, institution=inst, location=loc, url=url, description=desc)
        rows.append((i, *[r[f] for f in BROAD_FIELDS]))
    df = spark.createDataFrame(rows, BROAD_POSTING)
    merged = dedup.merge_entities(df).collect()
    assert len(merged) == 1
    assert (merged[0]["title"], merged[0]["institution"], merged[0]["location"]) == ("a", "x", "k")


def test_url_match_beats_identity_match_and_entities_stay_apart(spark):
    rows = []
    for i, (t, url) in enumerate([("a", "u1"), ("b", "u2"), ("b", "u1"), ("b", "u9")]):
        r = dict.fromkeys(BROAD_FIELDS, "")
        r.update(title=t, url=url, description="d")
        rows.append((i, *[r[f] for f in BROAD_FIELDS]))
    df = spark.createDataFrame(rows, BROAD_POSTING)
    merged = {r["seq"]: r["title"] for r in dedup.merge_entities(df).collect()}
    assert merged == {0: "a", 1: "b"}
