"""Text operators against one-row-at-a-time versions, with odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import models
from jobflow.llm import common, lm, mixing, ngram_join, passages, pieces, quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  \n\t ", "one", "One two THREE four", "one two three four", "x" * 5000, "a b " * 20000, "é Ü ß 日本 😀", "a\x00b \x0b c"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def near_rows(seed, families=6, size=14):
    """Families of near copies of different closeness, common passages, copies and odd texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    common_part = [word() for _ in range(60)]
    texts = []
    for f in range(families):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 150]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                k = rnd.randrange(len(w))
                w[k:k + rnd.randint(0, 1)] = [word()] if rnd.random() < 0.7 else []
            texts.append(" ".join(w))
        texts.append(" ".join(base[:30] + common_part))
        texts.append(" ".join(common_part + base[:20]))
    texts += texts[:9] + ODD
    rnd.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile", [2, 5, 32])
def test_near_copies_match_brute_force(spark, tile):
    rows = near_rows(tile)
    got = ngram_join.join_documents(frame(spark, [(i, t, "s") for i, t in rows]).repartition(5), tile=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == models.near_copies(rows)
    assert len(got) == len(rows)


def test_arrays_are_made_only_of_sets_that_may_link(spark, monkeypatch):
    """Documents that share a short passage are candidates; their bitmaps keep them from being compared."""
    rnd, rows = random.Random(3), []
    for k in range(20):
        passage = [f"p{k}x{i}" for i in range(12)]
        for side in "ab":
            own = [f"{side}{k}x{i}" for i in range(40)]
            rows += [" ".join(passage + own), " ".join(rnd.sample(own, 40))]  # each word comes twice
    near = [f"n{i}" for i in range(50)]
    rows += [" ".join(near), " ".join(near[:-1] + ["other"])]
    rows = list(enumerate(rows))
    counts, write = {}, ngram_join.written

    def counted(df, name):
        table = write(df, name)
        counts[name] = counts.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(ngram_join, "written", counted)
    got = ngram_join.join_documents(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == models.near_copies(rows)
    assert counts["pairs"] > 10
    assert counts["sets"] == 2


def test_bitmap_bound_is_an_upper_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 2**63, rng.integers(2, 900), dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1))) for _ in range(2))
        assert ngram_join.overlap(a, b) == len(set(a) & set(b))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) >= len(set(a) & set(b))


def test_word_hashes_follow_the_words():
    texts = [t for t in ODD if t is not None] + ["Ab aB AB ab", "end", "end"]
    data, offsets = common.text_buffers(common.pa.array(texts))
    hashes, bounds = common.word_hashes(data, offsets)
    seen = {}
    for k, t in enumerate(texts):
        w = models.words(t)
        got = hashes[bounds[k]:bounds[k + 1]]
        assert len(got) == len(w)
        for word, h in zip(w, got, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_passages_match_brute_force(spark):
    rnd = random.Random(4)
    sentence = lambda: " ".join(rnd.choice("alpha beta gamma delta eps".split()) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(1, 12)))
    shared = [", ".join(sentence() for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [sentence() for _ in range(rnd.randint(1, 8))]
        if i % 3 == 0:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        rows.append((i, rnd.choice([". ", "\n", " "]).join(parts)))
    rows += [(200 + k, t) for k, t in enumerate(t for t in ODD if t is not None)] + [(400, rows[0][1])]
    df = frame(spark, [(i, t, "s") for i, t in rows]).withColumn("spans", F.lit("clash")).repartition(7)
    got = {r.doc_id: r for r in passages.dedup_passages(df).collect()}
    want = models.cut_passages(rows)
    assert {i: (r.text, r.removed_words, [(s.begin, s.end) for s in r.spans]) for i, r in got.items()} == want
    text = dict(rows)
    for i, r in got.items():  # what is left and what was cut make up the original
        assert len(r.text) + sum(s.end - s.begin for s in r.spans) == len(text[i])
    assert any(v[1] for v in want.values())


def test_passages_keep_rows_of_one_id_and_nulls(spark):
    long = "a passage of many words " * 5
    df = frame(spark, [(1, long, "s"), (1, long, "s"), (2, long, "s"), (3, None, "s"), (None, None, "s")])
    got = sorted((str(r.doc_id), r.text) for r in passages.dedup_passages(df).collect())
    assert got == [("1", long), ("1", long), ("2", ""), ("3", None), ("None", None)]


def test_glued_passages_go_whole(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    passage = [word() for _ in range(64)]
    rows = []
    for i in range(60):
        around = [[word() for _ in range(rnd.randint(5, 40))] for _ in range(2)]
        rows.append((i, around, passage[:49] if i % 3 == 1 else passage if i % 3 else []))
    df = frame(spark, [(i, " ".join([*a, *p, *b]), "s") for i, (a, b), p in rows]).repartition(5)
    got = {r.doc_id: r for r in passages.dedup_passages(df).collect()}
    # 49 words are under a window; the first whole passage stays
    for i, (a, b), p in rows:
        cut = len(p) == 64 and i != 2
        assert got[i].text == " ".join([*a, *([] if cut else p), *b]), i
        assert got[i].removed_words == (64 if cut else 0)


def test_language_model_scores_rows_one_by_one(spark, monkeypatch):
    """Null and repeated ids with unlike texts, clashing columns, and many small units."""
    rows = [(3, "a b c d"), (3, "x"), (None, "a b"), (None, None), (5, "a b c d"), (5, "a b c d"), (6, ""), (7, "a b " * 400)]
    df = spark.createDataFrame([(i, t, True, k % 2, "q", 0) for k, (i, t) in enumerate(rows)],
                               "doc_id long, text string, train boolean, part long, unit string, score int").repartition(3)
    whole = sorted(map(str, lm.score_all(df, df).collect()))
    monkeypatch.setattr(lm, "GATHER", 1)
    got = lm.score_all(df, df).collect()
    assert sorted(map(str, got)) == whole and len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split()) + 1) for i, t in rows)
    text = {(r.doc_id, r.n_tokens): (r.score, r.base_score) for r in got}
    assert text[3, 5] == text[5, 5] and text[3, 2] != text[3, 5] and text[None, 1] == text[6, 1]


@pytest.mark.parametrize("share", [2.0 ** -9, 2.0 ** -20])
def test_language_model_counts_every_bigram(spark, share):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)]
    fold = lambda i: zlib.crc32(str(i).encode())
    trains = {i: fold(i) % 5 != 1 for i, _ in rows}
    df = spark.createDataFrame([(i, t, trains[i], int(fold(i) % 50 < 5)) for i, t in rows],
                               "doc_id long, text string, train boolean, part long").repartition(4)
    model = lm.fit_all(df.where("train"), share)
    got = {r.doc_id: r for r in lm.score_all(df, df.where("train"), share).collect()}
    tokens = {i: [*models.words(t), None] for i, t in rows}
    pairs = lambda t: list(zip(["<start>", *t[:-1]], t, strict=True))
    count = lambda part, of: collections.Counter(x for i, t in tokens.items() if trains[i] and part(i) for x in of(t))
    everything, kept = lambda i: True, lambda i: fold(i) % 50 >= 5
    c, pair, context = (count(everything, of) for of in (list, pairs, lambda t: [u for u, _ in pairs(t)]))
    n, v, mu = sum(c.values()), len(c), model["mu"]
    p1 = lambda w, c=c, n=n: mu * c[w] / n + (1 - mu) / (v + 1)
    # lam of a bucket: EM on held-out bigrams against counts of the rest
    c_k, pair_k, context_k = (count(kept, of) for of in (list, pairs, lambda t: [u for u, _ in pairs(t)]))
    held = collections.defaultdict(list)
    for (u, w), k in count(lambda i: not kept(i), pairs).items():
        if context_k[u]:
            held[int(math.log2(context_k[u]))].append((k, pair_k[u, w] / context_k[u], p1(w, c_k, sum(c_k.values()))))
    for b, events in held.items():
        assert model["lam"][b] == pytest.approx(lm.mixture(*np.array(events, float).T), abs=0.01), b
    lam = lambda u: model["lam"][int(math.log2(context[u]))] if context[u] else 0
    for i, t in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
        want = sum(math.log10(lam(u) * pair[u, w] / max(1, context[u]) + (1 - lam(u)) * p1(w)) for u, w in pairs(t))
        assert got[i].score == pytest.approx(want, rel=1e-9)


def test_mixture_learns_the_share():
    rng = np.random.default_rng(1)
    high, low = np.array([0.9, 0.1]), np.array([0.1, 0.9])
    draws = rng.random(20000) < 0.3 * 0.9 + 0.7 * 0.1
    assert lm.mixture(np.array([draws.sum(), (~draws).sum()], float), high, low) == pytest.approx(0.3, abs=0.03)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").select(
        "quality", "predicted", "score").toPandas()
    assert len(got) > 500 and got["score"].between(0, 1).all()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.1


def test_quality_of_odd_rows(spark):
    df = frame(spark, [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "x", "s")]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (5, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab cé\n 日😀▁the  in.") for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    model = pieces.load_model()
    ids, at = pieces.encode(model, texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(texts)
    assert pieces.decode(model, ids, at) == lib.decode(lib.encode(texts))
    table = pieces.encode_table(frame(spark, [(i, t, "s") for i, t in enumerate(ODD)]).withColumn("ids", F.lit(1)))
    got = {r.doc_id: r for r in table.collect()}
    assert all(got[i].ids == lib.encode(t or "") and got[i].round_trip and got[i].n_tokens == len(got[i].ids) for i, t in enumerate(ODD))


def test_viterbi_finds_the_best_path():
    import itertools

    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "▁a": -2.2, "ab": -3.1, "ba": -3.9, "aba": -4.4, "▁ab": -4.0, "bb": -4.6}
    names = ["<unk>", *scores]
    model = pieces.make_model([("<unk>", 0, "unknown"), *[(p, s, "normal") for p, s in scores.items()]], "unigram")
    texts = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)] + ["ab" * 60]
    ids, at = pieces.encode(model, texts)
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        found = [names[i] for i in ids[a:b]]
        word = "▁" + text
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max((best[k] + scores[word[k:end]] for k in range(end) if word[k:end] in scores), default=-math.inf)
        assert "".join(found) == word and sum(scores[p] for p in found) == pytest.approx(best[-1])


def test_mixing_meets_targets_and_caps(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + k, t, None if k % 2 else "odd") for k, t in enumerate(ODD)]
    small = mixing.draw(mixing.sizes_of(frame(spark, rows)), block_words=400, shard_words=2000).collect()
    got = mixing.draw(mixing.sizes_of(frame(spark, rows)), shard_words=2000).collect()
    assert len(got) == len(small) == len(rows)
    assert len({d["shard"] for r in got for d in r.draws}) > 8 and all(len(r.draws) <= 3 for r in small)
    taken, per = collections.defaultdict(int), {}
    for r in got:
        assert len(r.draws) <= 3 and len({d["pass"] for d in r.draws}) == len(r.draws)
        taken[r.source] += len(r.draws) * r.size
        per[r.source] = (r.source_size, r.target)
    assert sum(t for _, t in per.values()) == pytest.approx(sum(s for s, _ in per.values()))
    for s, (size, target) in per.items():
        assert target <= 3 * size + 1e-6
        # whole documents only: what is missing is less than any document that the last pass left out
        left = [r.size for r in got if r.source == s and r.size and len(r.draws) == int(target // size)]
        assert taken[s] <= target + 1e-6 and target - taken[s] < min([*left, math.inf]), s


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 37), (1, 0), (2, 500), (3, 1)], "sid int, quota long")
    rows = mixing.split_quotas(quotas, 3).collect()
    back, shard = collections.Counter(), collections.Counter()
    for r in rows:
        back[r.sid] += r.part
        shard[r.shard] += r.part
        assert r.part >= 0
    assert {k: v for k, v in back.items() if v} == {0: 37, 2: 500, 3: 1}
    assert max(shard.values()) - min(shard.values()) <= 3


def test_mix_returns_the_drawn_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("mix_pass", F.lit("clash"))
    drawn = {r.doc_id: len(r.draws) for r in mixing.draw(mixing.sizes_of(df)).collect()}
    rows = collections.Counter(r.doc_id for r in mixing.mix(df).select("doc_id").collect())
    assert {k: v for k, v in drawn.items() if v} == dict(rows)


def test_mix_shuffles_texts_once(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None if k % 3 else 7, t, None if k % 2 else "odd") for k, t in enumerate(ODD)] + rows[:5]
    df = frame(spark, rows).select("doc_id", "text", "source", F.lit("clash").alias("block"), F.lit(1).alias("size"))
    options = {"block_words": 400, "shard_words": 2000}
    mixed = mixing.mix(df, **options)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(mix_shard") == 1 and "SortMergeJoin" not in plan
    assert mixed.columns == ["doc_id", "text", "source", "block", "size", "mix_pass", "mix_shard"]
    want = collections.Counter((r.doc_id, r.source, r.size, d["pass"], d["shard"])
                               for r in mixing.draw(mixing.sizes_of(df), **options).collect() for d in r.draws)
    got = mixed.select("doc_id", "source", mixing._size().alias("n"), "mix_pass", "mix_shard").collect()
    assert collections.Counter(map(tuple, got)) == want and len({k[-1] for k in want}) > 8


def test_scratch_tables_that_nothing_reads_are_gone(spark, monkeypatch):
    made, gone = [], []
    for module in (ngram_join, passages, mixing):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or common.written(df, name))
        monkeypatch.setattr(module, "forget", lambda *tables: gone.extend(re.sub(r".*/|-[^-]*$", "", t._scratch) for t in tables) or common.forget(*tables))
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for done, left in ((lambda: ngram_join.join_documents(df.select("doc_id", "text")), {"tiles", "pairs", "reps"}),
                       (lambda: passages.dedup_passages(df), {"fingerprints", "windows"}), (lambda: mixing.mix(df), {"rows", "shares"})):
        assert done().count() and left <= set(gone) and left <= set(made)


def test_tasks_give_back_what_they_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.tidy(iter)([1, 2])) == [1, 2] and common.tidy_group(lambda t: t)(3) == 3 and len(calls) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (ngram_join.join_documents(none), passages.dedup_passages(none), mixing.draw(mixing.sizes_of(none)), mixing.mix(none),
               quality.quality_scores(none, labels), pieces.encode_table(none)):
        assert df.count() == 0
    folds = none.select("doc_id", "text", F.lit(True).alias("train"), F.lit(0).cast("long").alias("part"))
    assert lm.score_all(folds, folds).count() == 0
