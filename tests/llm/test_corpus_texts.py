"""Fill-in-middle, decontamination and tokenizer alignment against one-row-at-a-time versions."""

import collections
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import models
from jobflow.llm import alignment, decontamination, infilling
from jobflow.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, "", "\n", "\n\n\n", "no line end", "a\nb\n", "a\r\nb", "x" * 70000, "<P>", "has <S> inside\nline\n", "<P", "a<\n<P\n>b\nM>",
       "é Ü\nß 日本\n😀", "a\x00b \x0b c\n", "<|endoftext|> is text\n", "▁ mark\n", " lead  two   blanks ", "one\ntwo\nthree\n" * 3000]


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, "q") for i, t in rows], f"doc_id long, text string, {extra or 'extra'} string")


def expected_fim(i, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 100), (100, 0)])
def test_fill_middle_matches_brute_force(spark, rate, spm):
    rnd = random.Random(rate + spm)
    texts = ODD + ["".join(rnd.choice(["a", "<", ">", "P", "S", "é", "\n", "\n", " 😀"]) for _ in range(rnd.randint(0, 60)))
                   for _ in range(400)]
    rows = [(None if k % 50 == 0 else k, t) for k, t in enumerate(texts)] + [(7, "again\nand\nagain"), (7, "again\nand\nagain")]
    got = infilling.restore(infilling.transform(frame(spark, rows, "output").repartition(3), rate=rate, spm=spm)).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, *expected_fim(i, t, rate, spm), t or "") for i, t in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want


def test_fill_middle_keeps_columns_and_empty_tables(spark):
    out = infilling.transform(frame(spark, [(1, "a\n")], "form"))
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert infilling.restore(infilling.transform(frame(spark, []))).count() == 0


def test_damaged_outputs_restore_to_null(spark):
    rows = [("<P>a<S>b", "psm"), ("<S>b<P>a<M>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "other"), (None, "psm"),
            ("<P>a<S>b<M>c", None), ("<P>a<S>b<M>c", "psm"), ("plain", "plain")]
    got = infilling.restore(spark.createDataFrame(rows, "output string, form string")).collect()
    assert [r.restored for r in got] == [None] * 6 + ["acb", "plain"]


# --- decontamination -------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, bench, span):
    split = lambda t: WORD.findall((t or "").translate(models.LOWER))
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = split(text)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i:i + m])].add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, items = split(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    items |= windows[tuple(w[k:k + m])]
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return collections.Counter(out)


@pytest.mark.parametrize("span,gram", [(10, 5), (10, 3), (4, 5)])
def test_contamination_matches_brute_force(spark, span, gram):
    rnd = random.Random(span * gram)
    for letters in ("ab", "abcdefghijklmnop"):
        word = lambda: rnd.choice(letters) * rnd.randint(1, 2)
        some = lambda n: " ".join(word() for _ in range(n))
        bench = [(k, some(rnd.randint(0, 25))) for k in range(30)] + [(None, some(12)), (3, some(14)), (99, None), (98, "..."), (97, "A, b; É9")]
        docs = [(k, some(rnd.randint(0, 200))) for k in range(60)]
        docs += [(200 + k, some(9) + ". " + (bench[k][1] or "").upper().replace(" ", "-") + " " + some(5)) for k in range(30)]
        docs += [(None, bench[3][1] + " x"), (None, bench[4][1]), (5, bench[5][1]), (5, "other"), (300, None), (301, ""), (302, "a " * 3000),
                 (303, bench[6][1]), (303, bench[6][1]), (304, "x a, b É9 é9 y")]
        got = decontamination.decontaminate(
            frame(spark, docs, "items"), spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, words string"),
            span, gram).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == contaminated(docs, bench, span)
        assert all(r.n_hit == sum(s.end - s.begin for s in r.spans) for r in got)


def test_contamination_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b c")])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.decontaminate(none, bench).count() == 0
    row = decontamination.decontaminate(some, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row["items"]) == (3, 0, [])


def test_decontamination_runs_no_python(spark):
    plan = QUERIES["op12_decontaminate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- alignment -------------------------------------------------------------------------------------

def read_models():
    with open(alignment.BYTE_MODEL, encoding="utf-8") as a, open(alignment.PIECE_MODEL, "rb") as b:
        return alignment.load_models((a.read(), b.read()))


@functools.cache
def public_encoder():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(alignment.BYTE_MODEL)
    tokenizer.encode_special_tokens = True
    return tokenizer


def public_ids(text):
    return public_encoder().encode(text, add_special_tokens=False).ids


def test_byte_ids_equal_the_public_library():
    encode = read_models()["a"]
    rnd = random.Random(8)
    texts = [" " + t for t in ODD if t] + [" " * 5000 + "x", "\n" * 4096]
    texts += [f" a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}'s{chr(c)} x" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    any_letter = lambda: chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)]))
    texts += ["".join(any_letter() if rnd.random() < 0.5 else rnd.choice(" '\n\tsa1") for _ in range(60)) for _ in range(300)]
    assert encode(texts) == [public_ids(t) for t in texts]


def spans(table, ids):
    data, ends = table
    raw = [bytes(data[ends[k]:ends[k + 1]]) for k in ids]
    at, out = 0, []
    for r in raw:
        out.append((at, at + len(r)))
        at += len(r)
    return out, b"".join(raw)


def brute_alignment(texts):
    """Token spans compared pair by pair."""
    m, docs, count = read_models(), [], collections.Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a = public_ids(" " + text)
        b = m["b"].encode(text)
        (sa, ra), (sb, rb) = spans(m["a_bytes"], a), spans(m["b_bytes"], b)
        if ra != (" " + text).encode() or rb != ra:
            docs.append(None)
            continue
        links = [(x, y) for x, (p, q) in enumerate(sa) for y, (r, s) in enumerate(sb) if max(p, r) < min(q, s)]
        ends = sorted({q for _, q in sa} & {s for _, s in sb})
        groups, before = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, (p, q) in zip(a, sa, strict=True) if before < q <= e) + "|" + ",".join(
                str(i) for i, (p, q) in zip(b, sb, strict=True) if before < q <= e))
            before = e
        docs.append((a, b, links, ";".join(groups)))
        count.update((a[x], b[y]) for x, y in links)
    most = collections.Counter()
    for (_, b), c in count.items():
        most[b] = max(most[b], c)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = d
        counts = [count[a[x], b[y]] for x, y in links]
        out.append((len(a), len(b), groups.count(";") + 1, len(links),
                    sum(c == most[b[y]] for c, (_, y) in zip(counts, links, strict=True)), sum(counts), groups))
    return out, count


@pytest.mark.parametrize("pairs", [1 << 20, 40])
def test_alignment_matches_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    monkeypatch.setattr(alignment, "UNIT", 1 << 11)
    monkeypatch.setattr(alignment, "ALIGN", 1 << 9)
    rnd = random.Random(3)
    texts = ODD[:7] + ["x" * 700] + ODD[8:-1] + ["".join(rnd.choice("ab cé日\n 😀1") for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    texts += [r.text[:600] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ["twice", "twice"]
    rows = [(None if k % 9 == 0 else k // 2, t) for k, t in enumerate(texts)]
    units, _ = alignment.encode_units(frame(spark, rows, "a").repartition(4))
    posts, tables, salts = alignment.pair_tables(units)
    want, count = brute_alignment(texts)
    known = alignment.pair_counts(tables).collect()
    assert {(r.a, r.b): r["count"] for r in known} == count and len(known) == len(count)
    assert (salts > 1) == (pairs == 40)
    got = alignment.aligned(frame(spark, rows, "a").repartition(4)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_units_are_written_in_small_rows_and_groups(spark, monkeypatch):
    """What a task holds of the written texts does not grow with the texts of its split."""
    monkeypatch.setattr(alignment, "UNIT", 1 << 16)
    monkeypatch.setattr(alignment, "CALL", 1 << 13)
    monkeypatch.setattr(alignment, "GROUP", 1 << 15, raising=False)
    rnd = random.Random(5)
    rows = [(k, " ".join(str(rnd.random()) for _ in range(rnd.randint(1, 100)))) for k in range(600)]
    size = {k: len(t) for k, t in rows}
    units, _ = alignment.encode_units(frame(spark, rows, "a").coalesce(1))
    kept = units.where("ids is not null").select("unit", "ids").collect()
    assert sorted(k for r in kept for k in r.ids) == sorted(size)
    assert max(sum(size[k] for k in r.ids) for r in kept) <= alignment.CALL
    texts = collections.Counter()
    for r in kept:
        texts[r.unit] += sum(size[k] for k in r.ids)
    assert len(texts) > 5 and max(texts.values()) <= alignment.UNIT + alignment.CALL
    pairs = [r.unit for r in units.where("keys is not null").collect()]
    assert sorted(pairs) == sorted(texts)
    groups = [f.row_group(k).total_byte_size for name in units.inputFiles()
              for f in [pq.ParquetFile(name.removeprefix("file://")).metadata] for k in range(f.num_row_groups)]
    assert len(groups) > 3 and max(groups) <= 2 * alignment.GROUP


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(rng.integers(0, 2**46, n))
        at = alignment.hash_of(alignment.perfect_hash(keys), keys)
        assert sorted(at) == list(range(len(keys)))


def test_unknown_pairs_are_detected():
    keys = np.arange(100) * 7
    levels = alignment.perfect_hash(keys)
    ordered = np.zeros(100, np.int64)
    ordered[alignment.hash_of(levels, keys)] = keys
    row = {"levels": alignment._pack_levels(levels), "keys": alignment._pack(ordered)}
    assert (ordered[alignment._looked_up(row, keys)] == keys).all()
    with pytest.raises(ValueError):
        alignment._looked_up(row, np.array([5]))


def test_alignment_query_covers_all_documents(spark):
    got = QUERIES["op13_align"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() and QUERIES["op13_align"](spark, SF).where(F.col("n_a") > 0).count() > 0
    assert alignment.aligned(docs.limit(0)).count() == 0
