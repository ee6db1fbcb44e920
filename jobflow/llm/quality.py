"""Quality scores: random-indexing word vectors pooled per document and a two-layer network.

Words hash to slots. Each slot has a sparse random index vector; its word vector is the sum of the
index vectors around its occurrences in the fitting texts. Each token also has a form (kinds of its
last two characters, case, length, whether it repeats the token before it), with an index vector
per form. A document is the mean word vector and the mean form vector of all its tokens, plus its
length. A network with one hidden layer turns that into a logit; its temperature is fitted on a
part of the fitting rows that the weights did not see.

Fitting uses about ``FIT_ROWS`` labelled rows of the training fold (a hash sample of that expected
size; all, where there are fewer) on the driver; scoring reads every whole text once, where it
lies, with no shuffle. Labels, lang, source and doc_id are not inputs of a score.

Null texts are empty; an empty text has the zero vector and gets the network's score for it. Rows
without label or with a null id are scored like others. Several labels of a document count by their
mean. With no fitting rows, or one class only, every score is (good rows + 1) / (rows + 2). Repeated
rows repeat their score. Empty tables give empty results; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobflow.llm.common import give_back, mix, passes, text_buffers, tidy, word_hashes, word_spans
from jobflow.llm.registry import query

FIT_ROWS = 6000
KEEP_SCORE = 0.7
SLOTS, FORMS, DIM, HIDDEN, AROUND, SEED = 1 << 16, 1024, 32, 24, 2, 5


def _index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors: each entry is -1 or 1 with chance 1/8 each."""
    draw = np.random.default_rng(seed).integers(0, 8, (n, DIM))
    return (draw == 0).astype(np.float32) - (draw == 1).astype(np.float32)


_KIND = np.full(256, 1, np.int64)  # letters of other alphabets
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
for _n, _c in enumerate(b"!.,;:?|#*%&$-_()[]<>\"'/@=+"):
    _KIND[_c] = 3 + _n % 13


def _tokens(data, offsets):
    """(slot, form) per word, and the word offset of each text."""
    hashes, bounds = word_hashes(data, offsets)
    starts, ends = word_spans(data, offsets)
    size = ends - starts
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    last, second = _KIND[data[ends - 1]], np.where(size > 1, _KIND[data[np.maximum(ends - 2, 0)]], 0)
    lower = small[ends] > small[starts]
    upper = (data[starts] >= 65) & (data[starts] <= 90)
    length = np.digitize(size, [2, 4, 8])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][bounds[:-1] < len(again)]] = False
    raw = (((((last * 16 + second) * 2 + lower) * 2 + upper) * 4 + length) * 2 + again).astype(np.uint64)
    return (hashes % np.uint64(SLOTS)).astype(np.int64), (mix(raw) % np.uint64(FORMS)).astype(np.int64), bounds


def _pooled(data, offsets, vectors) -> np.ndarray:
    """Feature rows of many texts."""
    slot, form, bounds = _tokens(data, offsets)
    n = len(offsets) - 1
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    out = np.zeros((n, 2 * DIM + 1), np.float64)
    if len(slot):
        key, times = np.unique(doc * SLOTS + slot, return_counts=True)
        some = np.flatnonzero(count)
        first = np.searchsorted(key // SLOTS, some)
        out[some, :DIM] = np.add.reduceat(vectors[key % SLOTS] * times[:, None].astype(np.float32), first, axis=0)
        forms = np.bincount(doc * FORMS + form, minlength=n * FORMS).reshape(n, FORMS)
        out[:, DIM:2 * DIM] = forms @ _index_vectors(FORMS, SEED + 1)
        out[:, :2 * DIM] /= np.maximum(count, 1)[:, None]
    out[:, -1] = np.log1p(count)
    return out


def word_vectors(texts: pa.Array) -> np.ndarray:
    """Unit word vectors per slot from the neighbourhoods in ``texts``; unseen slots keep their
    index vector."""
    index = _index_vectors(SLOTS, SEED)
    total = np.zeros((SLOTS, DIM), np.float32)
    data, offsets = text_buffers(texts)
    for first, last in passes(offsets):
        slot, _, bounds = _tokens(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        doc = np.repeat(np.arange(last - first), np.diff(bounds))
        for step in range(1, AROUND + 1):
            same = doc[step:] == doc[:-step]
            a, b = slot[:-step][same], slot[step:][same]
            for to, of in ((a, b), (b, a)):
                order = np.argsort(to, kind="stable")
                if len(order):
                    at, begin = np.unique(to[order], return_index=True)
                    total[at] += np.add.reduceat(index[of[order]], begin, axis=0)
    length = np.sqrt((total * total).sum(1, keepdims=True))
    return np.where(length > 0, total / np.maximum(length, 1e-9), index / np.sqrt(DIM / 4)).astype(np.float32)


def _forward(net, x):
    hidden = np.tanh((x - net["mean"]) / net["std"] @ net["w1"] + net["b1"])
    return hidden, hidden @ net["w2"] + net["b2"]


def train_network(x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 256, rate: float = 0.01,
                  decay: float = 1e-3, seed: int = SEED) -> dict:
    """Two-layer network by Adam on the logistic loss; ``temperature`` fitted on a fifth of the rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    check, rest = order[:len(x) // 5], order[len(x) // 5:]
    net = {"mean": x[rest].mean(0), "std": x[rest].std(0) + 1e-3,
           "w1": rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b1": np.zeros(HIDDEN),
           "w2": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "b2": np.zeros(1)}
    names = ["w1", "b1", "w2", "b2"]
    first, second, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(rounds):
        rest = rng.permutation(rest)
        for s in range(0, len(rest), batch):
            rows = rest[s:s + batch]
            scaled = (x[rows] - net["mean"]) / net["std"]
            hidden, logit = _forward(net, x[rows])
            wrong = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            back = wrong[:, None] * net["w2"] * (1 - hidden * hidden)
            grads = {"w1": scaled.T @ back + decay * net["w1"], "b1": back.sum(0),
                     "w2": hidden.T @ wrong + decay * net["w2"], "b2": wrong.sum(keepdims=True)}
            t += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                net[k] = net[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    net["temperature"] = 1.0
    if len(check):
        _, logit = _forward(net, x[check])
        tries = 2.0 ** np.linspace(-2, 4, 49)
        loss = [np.logaddexp(0, np.where(y[check] == 1, -logit, logit) / t).mean() for t in tries]
        net["temperature"] = float(tries[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, train, fit_rows: int = FIT_ROWS) -> dict:
    """Word vectors and network from about ``fit_rows`` labelled rows with ``train`` (a condition
    on doc_id)."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & train).select("doc_id", "quality")
    n = marks.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit_rows / max(1, n)))
    marks = marks.where(chance).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = docs.where(F.col("doc_id").isNotNull() & train & chance).select("doc_id", "text").join(marks, "doc_id")
    rows = rows.toArrow().sort_by("doc_id")
    y = (rows.column("quality").to_numpy() >= 0.5).astype(float)
    if not len(y) or y.min() == y.max():
        return {"constant": float((y.sum() + 1) / (len(y) + 2))}
    vectors = word_vectors(rows.column("text"))
    data, offsets = text_buffers(rows.column("text"))
    x = np.concatenate([_pooled(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], vectors) for a, b in passes(offsets)])
    del rows, data, offsets
    give_back()  # the driver lives on
    net = train_network(x, y)
    del x
    give_back()
    return {"vectors": vectors, "net": net}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a ``score`` column between 0 and 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x DIM numbers and a small network
    docs = docs.drop("score")

    def run(batches):
        m = held.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            scores = np.full(len(offsets) - 1, m.get("constant", 0.0))
            if "net" in m:
                for a, b in passes(offsets):
                    x = _pooled(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], m["vectors"])
                    _, logit = _forward(m["net"], x)
                    scores[a:b] = 1 / (1 + np.exp(-np.clip(logit / m["net"]["temperature"], -500, 500)))
            yield batch.append_column("score", pa.array(scores))

    return docs.mapInArrow(tidy(run), T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted; learns from the other three quarters of ids."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    model = fit(docs, labels, fold % 4 != 2, fit_rows)
    return score(docs.drop("held_out", "predicted"), model).withColumn("held_out", fold % 4 == 2).withColumn(
        "predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")
