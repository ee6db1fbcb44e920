"""Keyword tables joined by substring: brute force on random texts, odd rows, and the plan."""

import random

from pyspark.sql import functions as F

from jobflow.operators import keywords


def norm(s):
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (s or "").lower()).split())


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abc ,D") for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    texts += [(200, None), (201, ""), (None, "abcabc"), (202, "abc"), (202, "dab"), (203, "ab" * 20000 + "zzz")]
    words = ["".join(rng.choice("abcd -") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    words += [None, "", "--", "a", "A", "bc", "abc", "abc", "zzz", "bzz"]
    t = spark.createDataFrame(texts, "row long, text string").withColumn("keyword", F.lit("clash")).withColumn("gram", F.lit(1))
    k = spark.createDataFrame([(w,) for w in words], "keyword string").withColumn("row", F.lit(7)).withColumn("key", F.lit(""))
    got = sorted(tuple(r) for r in keywords.keyword_join(t, k).collect())
    want = sorted({(i, w) for i, s in texts if i is not None for w in words if w is not None and norm(w) and norm(w) in norm(s)})
    assert got == want


def test_empty_tables(spark):
    t, k = spark.createDataFrame([], "row long, text string"), spark.createDataFrame([], "keyword string")
    full = spark.createDataFrame([(1, "abc")], "row long, text string")
    assert keywords.keyword_join(t, k).count() == 0 and keywords.keyword_join(full, k).count() == 0
    assert keywords.keyword_join(t, spark.createDataFrame([("a",)], "keyword string")).count() == 0


def test_hundred_thousand_keywords_without_a_nested_loop(spark):
    texts = spark.range(2000).select(F.col("id").alias("row"), F.concat_ws(" ", F.lit("role"), F.hex("id"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    many = spark.range(100000).select(F.substring(F.sha2((F.col("id") * 3).cast("string"), 256), 5, 9).alias("keyword"))
    found = keywords.keyword_join(texts, many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    rows = {r.row for r in found.collect()}
    assert rows >= {i for i in range(0, 2000, 3)}


def test_first_rule_same_as_ladder(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("ab.C") for _ in range(rng.randrange(0, 12)))) for i in range(200)]
    texts += [(300, None), (None, "ab"), (301, ""), (302, "ba"), (302, "..")]
    ladder = [(rng.randrange(6), "".join(rng.choice("ab.C") for _ in range(rng.randrange(1, 5))), f"v{i}") for i in range(25)]
    ladder += [(0, "", "empty"), (None, "a", "none"), (0, None, "none"), (0, "b", None), (1, "zz", "unseen")]
    t = spark.createDataFrame(texts, "row long, text string").withColumn("value", F.lit("clash")).withColumn("key", F.lit(1))
    r = spark.createDataFrame(ladder, "priority int, fragment string, value string").withColumn("row", F.lit(5))
    got = {x.row: x.value for x in keywords.first_rule(t, r).collect()}
    live = sorted(x for x in ladder if None not in x and x[1])
    want = {}
    for i in {i for i, _ in texts if i is not None}:
        hits = [x for x in live for j, s in texts if j == i and x[1] in (s or "")]
        want[i] = min(hits)[2] if hits else None
    assert got == want
    none = keywords.first_rule(t, r.limit(0)).collect()
    assert len(none) == len(want) and all(x.value is None for x in none)
