"""Skew-safe aggregates against plain Python models on random rows."""

import random

from pyspark.sql import functions as F

from jobflow.operators import evidence, registry, runlog


def test_running_log_numbers_with_small_chunks(spark):
    rng = random.Random(3)
    lines = [(rng.choice([1, 1, 1, 2]), i, rng.choice(["", "x", f"total: {rng.randint(1, 99)}"])) for i in range(300)]
    df = spark.createDataFrame(lines, "run_id long, line_no long, line string").repartition(7)
    got = {(r.run_id, r.line_no): (r.n, r.jobs_found) for r in runlog.log_progress(df, chunk_rows=11).collect()}
    want, seen = {}, {}
    for run, no, line in lines:
        if line:
            n, top = seen.get(run, (0, 0))
            top = max(top, int(line.split()[1]) if line.startswith("total") else 0)
            seen[run] = (n + 1, top)
            want[run, no] = seen[run]
    assert got == want


def test_registry_merge_model(spark):
    """Sums, unions and first examples of records that resolve to one company."""
    records = [
        ("acme", 2, ["lever"], ["acme.com"], ["mail.acme.com"], ["jobs@acme.com"], ["e1", "e2"]),
        ("acme inc", 3, ["adp"], ["acme.com", "x.psu.edu"], [], ["no-reply@acme.com"], ["e2", "e3"]),
        ("zoox careers", 1, [], [], [], [], []),
    ]
    schema = ("company string, count long, ats_hints array<string>, company_domains array<string>,"
              " sender_domains array<string>, sender_emails array<string>, examples array<string>")
    raw = spark.createDataFrame(records, schema)
    rows = registry.file_rows(raw)
    resolved = registry.resolve_names(registry.registry_votes(raw, rows))
    merged = evidence.with_examples(registry.merge_registry(raw, resolved), registry.merged_rows(rows, resolved))
    got = {r.company: r for r in merged.collect()}
    assert set(got) == {"Acme", "Zoox"}
    acme = got["Acme"]
    assert (acme["count"], acme.aliases, acme.ats_hints) == (5, ["acme", "acme inc"], ["adp", "lever"])
    assert (acme.company_domains, acme.sender_domains) == (["acme.com"], ["acme.com"])
    assert acme.examples == ["e1", "e2", "e3"]
    assert got["Zoox"].company_domains == ["zoox.com"]


def test_union_sets_of_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.array((F.col("id") % 3).cast("string")).alias("v"))
    got = evidence.union_sets(df, "key", {"v": F.col("v"), "none": F.array().cast("array<string>")}).collect()
    assert [(r.key, r.v, r.none) for r in got] == [("k", ["0", "1", "2"], [])]
