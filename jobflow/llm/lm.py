"""Language-model scoring with deleted interpolation.

Unigrams and bigrams of all training texts are counted exactly. The model of a word w after a
context u is

    p(w | u) = lam[u] * f2(w | u) + (1 - lam[u]) * p1(w),   p1(w) = mu * f1(w) + (1 - mu) / (V + 1)

with maximum-likelihood estimates f2 = c(u, w) / c(u) and f1. lam has one value per bucket of the
context's count (by powers of two); lam and mu are learned by expectation-maximisation on the
counts of held-out training texts against estimates from the rest (the deleted part). A context
without training count has lam 0. Texts begin after a start mark and close with an end token.

For a bigram without training count the probability is a product, so a text's score is a sum over
its words plus corrections at known bigrams. A word or bigram is *frequent* if its share of all
training tokens is at least ``share``; there are at most 1 / share of these, at any size of corpus,
so their counts may be broadcast and they are scored where the text is read. Occurrences of all
other words and bigrams, each rare by definition, are shuffled packed to buckets of their hashes,
counted and summed there, and sent back as sums per text. ``share`` moves work, not results. Counts
of rare words reach the bigrams they are in by joins of written tables.

Texts are read in units, the rows whose postings one map task has gathered; a posting names its unit and
the row in it. A bucket answers with one packed row per unit, and a unit adds its answers up, so rows go
with units times buckets (buckets by the bytes of the texts) and never with the occurrences.

Null texts are empty (one end token). Words without training count have c = 0. Without any training
text N and V are 0 and scores follow the same formulas. Every row has a result of its own, so repeated and
null ids, with one text or several, are scored one by one. Empty tables give empty results; other columns
are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm.common import buckets_for, forget, mix, passes, slices, text_buffers, tidy, word_hashes, written
from jobflow.llm.registry import query

SHARE = 2.0 ** -20
ROUNDS = 50
#: each tenth training text (by hash of the id) is the deleted part of the EM
DELETED = 10
#: postings that a map task gathers before it packs them by bucket
GATHER = 1 << 20
_START, _END = np.uint64(1), np.uint64(2)
_NULL = -(2**63)


def _tokens(data, offsets):
    """Token hashes with an end per text, their contexts, and the text of each token."""
    hashes, bounds = word_hashes(data, offsets)
    n = len(offsets) - 1
    tokens = np.insert(hashes, bounds[1:], _END)
    lengths = np.diff(bounds) + 1
    doc = np.repeat(np.arange(n), lengths)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = _START
    return tokens, before, doc


def _each_pass(batch, column="text"):
    data, offsets = text_buffers(batch.column(column))
    for first, last in passes(offsets):
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]


def _sum_by(keys, *counts):
    keys, at = np.unique(keys, return_inverse=True)
    return keys, *[np.bincount(at, c, minlength=len(keys)).astype(np.int64) for c in counts]


def count_words(train: DataFrame) -> DataFrame:
    """(word, kept, deleted) counts of all tokens of ``train`` (text, part), part 1 the deleted."""

    def count(batches):
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            found = []
            for first, last, data, offsets in _each_pass(batch):
                tokens, _, doc = _tokens(data, offsets)
                out = part[first:last][doc]
                found.append(_sum_by(tokens, 1 - out, out))
            if found:
                word, kept, deleted = _sum_by(*[np.concatenate(x) for x in zip(*found, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(kept), pa.array(deleted)], ["word", "kept", "deleted"])

    return train.select("text", "part").mapInArrow(tidy(count), "word long, kept long, deleted long").groupBy("word").agg(
        F.sum("kept").alias("kept"), F.sum("deleted").alias("deleted"))


def _place(words, tokens):
    """Index of each token in sorted ``words``, -1 where absent."""
    if not len(words):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    return np.where(words[at] == tokens, at, -1)


def mixture(weight, high, low, rounds: int = ROUNDS, start: float = 0.5) -> float:
    """EM for one mixture weight: events of ``weight`` with estimates ``high`` and ``low``."""
    total, lam = weight.sum(), start
    if not total:
        return lam
    for _ in range(rounds):
        mixed = lam * high + (1 - lam) * low
        lam = float((weight * np.divide(lam * high, mixed, out=np.zeros_like(mixed), where=mixed > 0)).sum() / total)
        lam = min(max(lam, 1e-6), 1 - 1e-6)
    return lam


#: bins to an octave of the ratio f2 / p1 in the EM, and the bin of ratio 0
_STEPS, _NONE = 32, -(1 << 20)


def _key(u, w):
    """Hash of a bigram of word hashes."""
    return mix(mix(u) * np.uint64(0x9E3779B97F4A7C15) + w)


def _packed(bucket, *columns):
    """(bucket, bytes of each column) for every bucket that occurs."""
    if not len(bucket):
        return
    if bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorts by radix
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[a]), *[c[a:b].tobytes() for c in columns]


def _held_by_ratio(context, kept, deleted, low):
    """(context bucket << 32 | ratio bin, held-out count): all that the EM reads of bigrams."""
    use = (deleted > 0) & (context > 0)
    context, kept, deleted, low = context[use], kept[use], deleted[use], low[use]
    ratio = np.full(len(kept), _NONE)
    seen = kept > 0
    ratio[seen] = np.rint(np.log2(kept[seen] / context[seen] / low[seen]) * _STEPS)
    return _sum_by(np.floor(np.log2(context)).astype(np.int64) << 32 | (ratio - _NONE), deleted)


def _gain(lam, context, pair, low):
    """log10 of p(w | u) over (1 - lam) p1(w)."""
    part = lam[np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)]
    return np.log10(1 + part * pair / np.maximum(context, 1) / ((1 - part) * low))


def _back(lam, context):
    return np.where(context > 0, np.log10(1 - lam[np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)]), 0.0)


def _neighbours(known, tokens, before):
    """Places of each token and of its context among the ``known`` words, -1 where absent."""
    w = _place(known, tokens)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[before == _START] = _place(known, np.array([_START]))[0]
    return u, w


PAIRS = "kind int, u long, w long, kept long, deleted long"


def count_all_pairs(train: DataFrame, held, least: float, buckets: int) -> DataFrame:
    """Counts of all neighbours by kind. 0: two broadcast words (places), ``least`` times or more;
    1: held-out counts of all pairs of broadcast words by context bucket and ratio (in u); 2: pairs with
    another word (hashes)."""
    names = [x.split()[0] for x in PAIRS.split(", ")]

    def packed(found, other):
        pair, kept, deleted = _sum_by(*[np.concatenate(x) for x in zip(*found, strict=True)])
        rows = [(k, c[0], None, *c[1:]) for k, *c in _packed(
            mix(pair.view(np.uint64)) % np.uint64(buckets), pair, kept.astype(np.int32), deleted.astype(np.int32))]
        u, w, out = (np.concatenate(x) for x in zip(*other, strict=True))
        key, at, back = np.unique(_key(u, w), return_index=True, return_inverse=True)
        kept, deleted = (np.bincount(back, c, minlength=len(key)).astype(np.int32) for c in (1 - out, out))
        rows += _packed(key % np.uint64(buckets), u[at], w[at], kept, deleted)
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]],
                                          ["bucket", "u", "w", "kept", "deleted"])

    def count(batches):
        known = held.value["words"]
        found, other, size = [], [], 0
        for batch in slices(batches):
            part = batch.column("part").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in _each_pass(batch):
                tokens, before, doc = _tokens(data, offsets)
                u, w = _neighbours(known, tokens, before)
                use = (u >= 0) & (w >= 0)
                out = part[first:last][doc]
                pair, kept, deleted = _sum_by(u[use] << 32 | w[use], 1 - out[use], out[use])
                found.append((pair, kept, deleted))
                other.append((before[~use], tokens[~use], out[~use]))
                size += len(pair) + len(other[-1][0])
            if size >= GATHER:
                yield packed(found, other)
                found, other, size = [], [], 0
        if found:
            yield packed(found, other)

    def merge(table: pa.Table) -> pa.Table:
        m = held.value
        pairs, other = [], []
        for row in table.to_pylist():
            kept, deleted = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("kept", "deleted"))
            if row["w"] is None:
                pairs.append((np.frombuffer(row["u"], np.int64), kept, deleted))
            else:
                other.append((np.frombuffer(row["u"], np.uint64), np.frombuffer(row["w"], np.uint64), kept, deleted))
        out = []
        if pairs:
            pair, kept, deleted = _sum_by(*[np.concatenate(x) for x in zip(*pairs, strict=True)])
            u, w = pair >> 32, pair & 0xFFFFFFFF
            often = (kept + deleted >= least) & (kept + deleted > 1)
            out.append((np.zeros(often.sum(), np.int64), u[often], w[often], kept[often], deleted[often]))
            ratio, number = _held_by_ratio(m["context_kept"][u], kept, deleted, m["low_kept"][w])
            none = np.zeros(len(ratio), np.int64)
            out.append((none + 1, ratio, none, none, number))
        if other:
            u, w, kept, deleted = (np.concatenate(x) for x in zip(*other, strict=True))
            key, at, back = np.unique(_key(u, w), return_index=True, return_inverse=True)
            kept, deleted = (np.bincount(back, c, minlength=len(key)).astype(np.int64) for c in (kept, deleted))
            out.append((np.full(len(key), 2), u[at].view(np.int64), w[at].view(np.int64), kept, deleted))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([pa.array(columns[0].astype(np.int32))] + [pa.array(c) for c in columns[1:]], names)

    return train.select("text", "part").mapInArrow(count, "bucket int, u binary, w binary, kept binary, deleted binary").groupBy(
        "bucket").applyInArrow(merge, PAIRS)


def _counted(pairs: DataFrame, held, rare: DataFrame) -> DataFrame:
    """``pairs`` with the counts of context (u_kept, u_all) and word (w_kept, w_all): of broadcast
    words from there, of the others, each rare, by joins."""
    names = ["u_kept", "u_all", "w_kept", "w_all"]
    columns = ["u", "w", "kept", "deleted"]

    def look(batches):
        m = held.value
        for batch in batches:
            found = []
            for c, kinds in (("u", ("context_kept", "context")), ("w", ("kept", "counts"))):
                at = _place(m["words"], batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64))
                found += [pa.array(m[k][at], mask=at < 0) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + found, columns + names)

    out = pairs.select(columns).mapInArrow(look, ", ".join(f"{c} long" for c in columns + names))
    for c in ("u", "w"):
        counts = rare.select(F.col("word").alias(c), F.col("kept").alias(f"{c}_kept"), (F.col("kept") + F.col("deleted")).alias(f"{c}_all"))
        missing = out.where(F.col(f"{c}_all").isNull()).drop(f"{c}_kept", f"{c}_all")
        out = out.where(F.col(f"{c}_all").isNotNull()).unionByName(missing.join(counts, c))
    return out


def fit_all(train: DataFrame, share: float = SHARE) -> dict:
    """The model of all bigrams. Arrays of bounded size: counts of frequent words and gains of
    frequent bigrams, ``lam`` by bucket; ``pairs`` is the written table of bigrams with a rare word."""
    spark = train.sparkSession
    table = written(count_words(train), "unigrams")
    both = F.col("kept") + F.col("deleted")
    n, n_kept, v = table.agg(F.sum(both), F.sum("kept"), F.count("*")).first()
    n, n_kept = n or 0, n_kept or 0
    bin_of = F.when(F.col("kept") > 0, F.floor(F.log2("kept") * 16)).otherwise(-1)
    bins = table.groupBy(bin_of.alias("bin")).agg(
        F.sum("deleted").alias("held"), F.avg("kept").alias("kept")).toPandas().sort_values("bin")
    mu = mixture(bins["held"].to_numpy(float), bins["kept"].to_numpy(float) / max(1, n_kept), np.full(len(bins), 1 / (v + 1)))
    frequent = table.where(both >= share * n).select("word", "kept", both.alias("c")).toPandas()
    texts = table.where(F.col("word") == int(_END)).select("kept", both.alias("c")).first() or (0, 0)
    words = np.append(frequent["word"].to_numpy(np.int64).view(np.uint64), _START)
    order = np.argsort(words)
    counted = lambda c, start: np.append(frequent[c].to_numpy(np.int64), start)[order]
    low = lambda c, of: mu * c / max(1, of) + (1 - mu) / (v + 1)
    model = {"words": words[order], "counts": counted("c", 0), "kept": counted("kept", 0), "context": counted("c", texts[1]),
             "context_kept": counted("kept", texts[0])}
    model |= {"low": low(model["counts"], n), "low_kept": low(model["kept"], n_kept)}
    held = spark.sparkContext.broadcast(model)
    pairs = written(count_all_pairs(train, held, share * n, buckets_for(train)), "bigrams")
    rare = written(_counted(pairs.where("kind = 2"), held, table.where(both < share * n)), "rare_bigrams")

    def ratios(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("u_kept", "kept", "deleted", "w_kept")}
            ratio, number = _held_by_ratio(c["u_kept"], c["kept"], c["deleted"], low(c["w_kept"], n_kept))
            yield pa.RecordBatch.from_arrays([pa.array(ratio), pa.array(number)], ["u", "deleted"])

    seen = pairs.where("kind = 1").select("u", "deleted").union(rare.mapInArrow(ratios, "u long, deleted long"))
    seen = seen.groupBy("u").agg(F.sum("deleted").alias("held")).toPandas()
    ratio, number = seen["u"].to_numpy(np.int64), seen["held"].to_numpy(float)
    bucket, ratio = ratio >> 32, (ratio & 0xFFFFFFFF) + _NONE
    high = np.where(ratio == _NONE, 0.0, 2.0 ** (np.maximum(ratio, -(1 << 15)) / _STEPS))
    lam = np.array([mixture(number[bucket == b], high[bucket == b], np.ones((bucket == b).sum())) for b in range(64)])
    often = pairs.where("kind = 0").select("u", "w", both.alias("c")).toPandas()
    u, w = (often[c].to_numpy(np.int64) for c in ("u", "w"))
    order = np.argsort(u << 32 | w)
    u, w = u[order], w[order]
    gain = _gain(lam, model["context"][u], often["c"].to_numpy(np.int64)[order], model["low"][w])
    forget(table, pairs)
    return model | {"n": n, "v": v, "mu": mu, "lam": lam, "pair": u << 32 | w, "gain": gain, "back": _back(lam, model["context"]),
                    "pairs": rare}


def score_all(docs: DataFrame, train: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text,
    train), by the model of ``train``, the rows of ``docs`` with that flag."""
    spark = docs.sparkSession
    model = fit_all(train, share)
    n, v, mu, lam, pairs = (model.pop(k) for k in ("n", "v", "mu", "lam", "pairs"))
    held = spark.sparkContext.broadcast({k: model[k] for k in ("words", "counts", "context", "low", "pair", "gain", "back")})
    buckets = buckets_for(docs)
    scale = float(np.log10(n + 0.5 * (v + 1)))
    low = lambda c: mu * c / max(1, n) + (1 - mu) / (v + 1)
    names = ["bucket", "kind", "unit", "row", "key", "sums"]
    schema = "bucket int, kind int, unit long, row binary, key binary, sums binary"

    def rows_of(out):
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def sent(unit, ids, sums, posts):
        """Rows of a unit: kind 0 its ids and own sums, 1 to 3 its postings by bucket."""
        out = [(unit % buckets, 0, unit, np.concatenate(ids).tobytes(), None, np.concatenate(sums, axis=1).tobytes())]
        for kind, found in posts.items():
            key, row = (np.concatenate(x) for x in zip(*found, strict=True))
            spread = mix(key) if kind == 2 else key
            out += [(k, kind, unit, r, keys, None) for k, keys, r in _packed(spread % np.uint64(buckets), key, row)]
        return rows_of(out)

    def read(batches):
        """A posting's row carries the training flag in its lowest bit."""
        m = held.value
        unit = TaskContext.get().partitionId() << 32
        fresh = lambda: ([], [], {1: [], 2: [], 3: []}, 0, 0)
        ids, sums, posts, count, size = fresh()
        for batch in slices(batches):
            ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
            flags = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint32)
            for first, last, data, offsets in _each_pass(batch):
                tokens, before, doc = _tokens(data, offsets)
                texts = last - first
                u, w = _neighbours(m["words"], tokens, before)
                seen = w >= 0
                add = lambda use, values: np.bincount(doc[use], values, minlength=texts)
                both = seen & (u >= 0)
                pair = u << 32 | w
                at = np.full(len(w), -1)
                at[both] = _place(m["pair"], pair[both])
                p = add(seen, np.log10(m["low"][w[seen]])) + add(u >= 0, m["back"][u[u >= 0]]) + add(at >= 0, m["gain"][at[at >= 0]])
                sums.append(np.stack([np.bincount(doc, minlength=texts), add(seen, m["counts"][w[seen]] > 0),
                                      add(seen, np.log10(m["counts"][w[seen]] + 0.5)), p]))
                row = (doc + first + count).astype(np.uint32) << np.uint32(1) | flags[doc + first]
                rest = both & (at < 0)
                for kind, key, of in ((1, tokens[~seen], ~seen), (2, pair[rest].view(np.uint64), rest),
                                      (3, _key(before[~both], tokens[~both]), ~both)):
                    posts[kind].append((key, row[of]))
                    size += len(key)
            count += batch.num_rows
            if size >= GATHER:
                yield sent(unit, ids, sums, posts)
                unit += 1
                ids, sums, posts, count, size = fresh()
        if sums:
            yield sent(unit, ids, sums, posts)

    def gains(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("u", "w", "kept", "deleted", "u_all", "w_all")}
            key = _key(c["u"].view(np.uint64), c["w"].view(np.uint64))
            gain = _gain(lam, c["u_all"], c["kept"] + c["deleted"], low(c["w_all"]))
            yield rows_of([(k, 4, None, None, a, g) for k, a, g in _packed(key % np.uint64(buckets), key, gain)])

    def settle(table: pa.Table) -> pa.Table:
        m = held.value
        out, posts, known = [], {1: [], 2: [], 3: []}, []
        units = {unit: k for k, unit in enumerate(sorted({u for u in table.column("unit").to_pylist() if u is not None}))}
        for row in table.to_pylist():
            if row["kind"] == 0:
                out.append((row["unit"], row["row"], row["sums"]))
            elif row["kind"] == 4:
                known.append((np.frombuffer(row["key"], np.uint64), np.frombuffer(row["sums"])))
            else:
                at = np.frombuffer(row["row"], np.uint32).astype(np.int64)
                posts[row["kind"]].append((np.frombuffer(row["key"], np.uint64), units[row["unit"]] << 32 | at >> 1, (at & 1).astype(np.uint8)))
        got = [(np.zeros(0, np.int64), *[np.zeros(0)] * 3)]
        for kind, found in posts.items():
            if not found:
                continue
            key, place, flag = (np.concatenate(x) for x in zip(*found, strict=True))
            if kind == 3:
                if not known:
                    continue
                have, gain = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(have)
                at = _place(have[order], key)
                place, p = place[at >= 0], gain[order][at[at >= 0]]
                hits = base = np.zeros(len(place))
            else:
                key, at = np.unique(key, return_inverse=True)
                c = np.bincount(at, flag, minlength=len(key)).astype(np.int64)
                if kind == 1:
                    hits, base = (c > 0)[at].astype(float), np.log10(c + 0.5)[at]
                    p = (np.log10(low(c)) + _back(lam, c))[at]
                else:
                    u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    hits = base = np.zeros(len(place))
                    p = _gain(lam, m["context"][u], c, m["low"][w])[at]
            got.append(_added(place, hits, base, p))
        place, *sums = _added(*[np.concatenate(x) for x in zip(*got, strict=True)])
        edges = np.searchsorted(place >> 32, np.arange(len(units) + 1))
        for unit, k in units.items():
            a, b = edges[k], edges[k + 1]
            if b > a:
                out.append((unit, (place[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes(), np.stack([x[a:b] for x in sums]).tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["unit", "row", "sums"])

    def total(table: pa.Table) -> pa.Table:
        """A unit's own sums hold four numbers a row, the buckets' answers three."""
        answers = []
        for row in table.to_pylist():
            sums = np.frombuffer(row["sums"])
            if len(row["row"]) * 4 == len(row["sums"]):
                ids, own = np.frombuffer(row["row"], np.int64), sums.reshape(4, -1).copy()
            else:
                answers.append((np.frombuffer(row["row"], np.uint32), sums.reshape(3, -1)))
        for rows, sums in answers:
            own[1:, rows] += sums
        tokens, hits, base, p = own
        return pa.table({"doc_id": pa.array(ids, mask=ids == _NULL), "n_tokens": tokens.astype(np.int64), "n_known": np.rint(hits).astype(np.int64),
                         "train_tokens": np.full(len(ids), n, np.int64), "base_score": base - tokens * scale, "score": p})

    ready = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text", "train")
    parts = ready.mapInArrow(read, schema).union(pairs.mapInArrow(gains, schema)).groupBy("bucket").applyInArrow(
        settle, "unit long, row binary, sums binary")
    return parts.groupBy("unit").applyInArrow(
        total, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _added(place, *sums):
    """Sums by place, ascending."""
    place, at = np.unique(place, return_inverse=True)
    return place, *[np.bincount(at, x, minlength=len(place)) for x in sums]


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", (fold % 5 != 1).alias("train"), (fold % (5 * DELETED) < 5).cast("long").alias("part"))
    scored = score_all(docs, docs.where("train"))
    return scored.select("doc_id", (fold % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
