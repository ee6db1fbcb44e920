"""Quality scores against plain loops: word vectors, pooled features, and the network word by word."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobflow.llm import common, quality as Q

WORDS = ["the", "The", "a", "Über", "ok.", "(x)", "12", "1,5", "same", "café", "longerthaneight", "#", "ü", "end!?"]


def kind(byte):
    if 48 <= byte <= 57:
        return 2
    at = b"!.,;:?|#*%&$-_()[]<>\"'/@=+".find(bytes([byte]))
    return 3 + at % 13 if at >= 0 else 1


def tokens(text):
    """(slot, form) of every word of one text, one at a time."""
    out, before = [], None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        raw = word.encode()
        data = np.frombuffer(raw, np.uint8)
        word_hash = int(common.word_hashes(data, np.array([0, len(raw)]))[0][0])
        form = kind(raw[-1]) * 16 + (kind(raw[-2]) if len(raw) > 1 else 0)
        form = form * 2 + any(97 <= b <= 122 for b in raw)
        form = form * 2 + (65 <= raw[0] <= 90)
        form = form * 4 + sum(len(raw) >= edge for edge in (2, 4, 8))
        form = form * 2 + (word_hash == before)
        mixed = int(common.mix(np.array([form], np.uint64))[0])
        out.append((word_hash % Q.SLOTS, mixed % Q.FORMS))
        before = word_hash
    return out


def features(text, vectors):
    found, forms = tokens(text), Q._index_vectors(Q.FORMS, Q.SEED + 1)
    row = [0.0] * (2 * Q.DIM + 1)
    for slot, form in found:
        for d in range(Q.DIM):
            row[d] += float(vectors[slot][d]) / len(found)
            row[Q.DIM + d] += float(forms[form][d]) / len(found)
    row[-1] = math.log(1 + len(found))
    return row


def probability(net, row):
    scaled = [(v - m) / s for v, m, s in zip(row, net["mean"], net["std"], strict=True)]
    logit = float(net["b2"][0])
    for h in range(Q.HIDDEN):
        logit += math.tanh(sum(v * w for v, w in zip(scaled, net["w1"][:, h], strict=True)) + net["b1"][h]) * net["w2"][h]
    return 1 / (1 + math.exp(-logit / net["temperature"]))


def texts_of(n, seed):
    rng = random.Random(seed)
    texts = [rng.choice(["", " ", "\n"]) + " ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) for _ in range(n)]
    return texts + ["", None, " \t\n", "same same same", "x" * 5000, "the " * 3000]


def test_word_vectors_match_plain_sums():
    texts = texts_of(12, 1)
    index, total = Q._index_vectors(Q.SLOTS, Q.SEED), {}
    for text in texts:
        slots = [slot for slot, _ in tokens(text or "")]
        for i, slot in enumerate(slots):
            for j in range(max(0, i - Q.AROUND), min(len(slots), i + Q.AROUND + 1)):
                if j != i:
                    total[slot] = total.get(slot, 0) + index[slots[j]].astype(float)
    got = Q.word_vectors(pa.array(texts))
    for slot, want in total.items():
        length = math.sqrt((want * want).sum())
        if length:
            assert np.allclose(got[slot], want / length, atol=1e-5)
    unseen = next(s for s in range(Q.SLOTS) if s not in total)
    assert np.allclose(got[unseen], index[unseen] / math.sqrt(Q.DIM / 4))


def test_scores_match_plain_network(spark):
    texts = texts_of(60, 2)
    vectors = Q.word_vectors(pa.array(texts))
    x = np.array([features(t or "", vectors) for t in texts])
    data, offsets = common.text_buffers(pa.array(texts))
    assert np.allclose(Q._pooled(data, offsets, vectors), x, atol=1e-4)
    net = Q.train_network(x, (np.arange(len(x)) % 3 == 0).astype(float), rounds=5)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in Q.score(df.repartition(3), {"vectors": vectors, "net": net}).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert math.isclose(got[i], probability(net, features(t or "", vectors)), abs_tol=1e-4)


def test_fit_returns_the_drivers_memory(spark):
    """What the fit needs besides the model does not stay in the driver, which lives on."""
    def held():
        with open("/proc/self/status") as status:
            return int(re.search(r"RssAnon:\s+(\d+)", status.read())[1]) / 1024

    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    words = F.expr("transform(sequence(1, 300), i -> concat('w', pmod(xxhash64(doc_id, i), 5000)))")
    docs = ids.select("doc_id", F.array_join(words, " ").alias("text"))
    labels = ids.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    Q.fit(docs.limit(100), labels, F.lit(True))
    common.give_back()
    before = held()
    model = Q.fit(docs, labels, F.lit(True))
    assert "net" in model
    assert held() - before < 50
