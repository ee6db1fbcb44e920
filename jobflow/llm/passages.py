"""Substring dedup by hashing short units of lines.

A text's lines are cut into units: words up to one that ends with . ! ? , ; or : or at the line's
end. A unit's digest covers its words, lower-cased (A-Z), whatever blanks are between. Of the units
with one digest in the whole corpus the earliest, by (doc_id, position), stays; the others are
marked. Marked neighbours form runs, and a run of ``min_words`` words or more is removed, so a
repeated passage goes even where it lies inside a line, and short phrases that recur stay.
Every window of ``WINDOW`` words that an earlier document holds goes too, wherever it begins or ends
in a unit: so a passage that is glued to its surroundings goes whole. Removed spans are kept as
character offsets of the original text.

Windows are found in two steps. Of any ``WINDOW - GRAM + 1`` neighbouring grams of ``GRAM`` words
the one of smallest hash is a fingerprint, so texts that share a window share a fingerprint inside
it. Only windows around fingerprints of two documents or more are hashed and compared in full.

The map side keeps one occurrence per digest and batch and marks the rest at once, so a very common
line sends one posting per batch; postings travel packed by digest bucket. Marks go back by
doc_id and meet the whole text there.

Null texts stay null and have no spans; empty texts stay. Rows that share a doc_id must share the
text: they are one document and get one result each. A null doc_id ranks first. Empty tables give empty
results. Extra columns of ``docs`` pass through, but ``spans`` and ``removed_words`` are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobflow.llm.common import buckets_for, forget, mix, passes, slices, text_buffers, tidy, tidy_group, word_hashes, word_spans, written
from jobflow.llm.registry import query

MIN_WORDS = 15
#: postings that a map task gathers before it packs them by bucket
GATHER = 1 << 19
#: words of a window, and of a gram
WINDOW, GRAM = 50, 25
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?,;:")] = True
_Q = 0xA0761D6478BD642F
_QINV = pow(_Q, -1, 2**64)
_NULL = -(2**63)


def _powers(base, n):
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def units(data, offsets):
    """Of many texts: (digest, text, words, first byte, byte behind) per unit, in order."""
    hashes, bounds = word_hashes(data, offsets)
    starts, ends = word_spans(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(n, bool)
    new[1:] = _STOPS[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(new)
    behind = np.append(first[1:], n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_Q, n))])
    size = behind - first
    digest = mix((sums[behind] - sums[first]) * _powers(_QINV, n)[first] + size.astype(np.uint64))
    doc = np.searchsorted(bounds, first, "right") - 1
    till = np.append(starts, len(data))[behind]
    last = np.append(doc[1:] != doc[:-1], True)
    till[last] = offsets[1:][doc[last]]
    return digest, doc, size, starts[first], till


def _position(doc):
    """Position of each unit in its text."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def _grouped(ids, position):
    """(ids, lists of positions) of marks sorted by id."""
    order = np.lexsort((position, ids))
    ids, position = ids[order], position[order].astype(np.int32)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(position))


def _gathered(batches, find):
    """(digest, id, position) arrays of about ``GATHER`` postings each: ``find(batch, first, last, bytes,
    offsets)`` gives those of a few texts, with the text's index for the id."""
    found, held = [], 0
    for batch in slices(batches):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, offsets = text_buffers(batch.column("text"))
        for a, b in passes(offsets):
            digest, doc, at = find(batch, a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            if len(digest):
                found.append((digest, ids[doc + a], at.astype(np.int64)))
                held += len(digest)
        if held >= GATHER:
            yield [np.concatenate(x) for x in zip(*found, strict=True)]
            found, held = [], 0
    if found:
        yield [np.concatenate(x) for x in zip(*found, strict=True)]


def _by_bucket(buckets, digest, doc, at):
    """(bucket, ids, digests, positions) in bytes for every bucket that occurs."""
    bucket = (digest >> np.uint64(24)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    digest, doc, at, bucket = digest[order], doc[order], at[order].astype(np.int32), bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[a]), doc[a:b].tobytes(), digest[a:b].tobytes(), at[a:b].tobytes()


def _by_document(buckets, doc, at) -> pa.Table:
    """Marks as one packed row per group of documents (by hash of the id)."""
    group = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    doc, at, group = doc[order], at[order].astype(np.int32), group[order]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
    behind = np.append(edges[1:], len(group))
    spans = list(zip(edges, behind, strict=True)) if len(group) else []
    return pa.table([pa.array(group[edges].astype(np.int32)), pa.array([doc[a:b].tobytes() for a, b in spans], pa.binary()),
                     pa.array([at[a:b].tobytes() for a, b in spans], pa.binary())], ["group", "doc", "at"])


def _per_document(marks: DataFrame) -> DataFrame:
    """(doc_id, at): one row per marked document, positions ascending, from packed rows of marks."""

    def unite(table: pa.Table) -> pa.Table:
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("doc").to_pylist()])
        at = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("at").to_pylist()])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))[:len(doc)]
        ids, lists = _grouped(doc[new], at[new])
        return pa.table([pa.array(ids, pa.int64()), lists], ["doc_id", "at"])

    return marks.groupBy("group").applyInArrow(tidy_group(unite), "doc_id long, at array<int>")


def _rows(out, names):
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names)


def repeated_units(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, at): positions of the units of a document that occurred before. A null id is the
    smallest number."""

    def find(batch, a, b, data, offsets):
        digest, doc, *_ = units(data, offsets)
        return digest, doc, _position(doc) if len(doc) else doc

    def post(batches):
        for digest, doc, at in _gathered(batches, find):
            order = np.lexsort((at, doc, digest))
            digest, doc, at = digest[order], doc[order], at[order]
            first = np.append(True, digest[1:] != digest[:-1])
            same = np.append(False, (digest[1:] == digest[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
            again = ~first & ~same  # repeated rows of one document are no repetition
            marked, lists = _grouped(doc[again], at[again])
            out = [(int(doc[0]) % buckets, marked.tobytes(), None, np.asarray(lists.flatten()).astype(np.int32).tobytes(),
                    np.diff(np.asarray(lists.offsets)).astype(np.int32).tobytes())]
            out += [(*row, None) for row in _by_bucket(buckets, digest[first], doc[first], at[first])]
            yield _rows(out, ["bucket", "doc", "digest", "at", "counts"])

    def settle(table: pa.Table) -> pa.Table:
        marks, posts = [], []
        for row in table.to_pylist():
            doc, at = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["at"], np.int32)
            if row["counts"] is not None:
                marks.append((np.repeat(doc, np.frombuffer(row["counts"], np.int32)), at))
            else:
                posts.append((np.frombuffer(row["digest"], np.uint64), doc, at))
        if posts:
            digest, doc, at = (np.concatenate(x) for x in zip(*posts, strict=True))
            order = np.lexsort((at, doc, digest))
            digest, doc, at = digest[order], doc[order], at[order]
            same = digest[1:] == digest[:-1]
            first = np.flatnonzero(np.append(True, ~same))
            owner = np.repeat(first, np.diff(np.append(first, len(digest))))
            again = (doc != doc[owner]) | (at != at[owner])
            marks.append((doc[again], at[again]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return _by_document(buckets, *(np.concatenate(x) for x in zip(none, *marks, strict=True)))

    ready = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text")
    return _per_document(ready.mapInArrow(tidy(post), "bucket int, doc binary, digest binary, at binary, counts binary").groupBy(
        "bucket").applyInArrow(tidy_group(settle), "group int, doc binary, at binary"))


def _grams(hashes, size):
    """Digests of ``size`` words from each word on."""
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_Q, n))])
    return mix((sums[size:] - sums[:-size]) * _powers(_QINV, n)[:n - size + 1])


def fingerprints(data, offsets):
    """Of many texts: (digest, text, word position) of the grams of smallest hash of each window."""
    hashes, bounds = word_hashes(data, offsets)
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _grams(hashes, GRAM)
    at = np.arange(len(hashes) - WINDOW + 1)
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + WINDOW <= bounds[doc + 1]
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1) + at
    least = np.unique(least[inside])
    doc = np.searchsorted(bounds, least, "right") - 1
    return grams[least], doc, least - bounds[doc]


def windows(data, offsets, near):
    """(digest, text, word position) of the windows that hold a fingerprint of ``near``, lists of
    word positions per text."""
    hashes, bounds = word_hashes(data, offsets)
    doc = np.repeat(np.arange(len(near)), [len(x) for x in near])
    if len(hashes) < WINDOW or not len(doc):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = bounds[doc] + np.concatenate(near).astype(np.int64)
    at = start[:, None] - np.arange(WINDOW - GRAM + 1)
    at = np.unique(at[(at >= bounds[doc][:, None]) & (at + WINDOW <= bounds[doc + 1][:, None])])
    doc = np.searchsorted(bounds, at, "right") - 1
    return _grams(hashes, WINDOW)[at], doc, at - bounds[doc]


def _first_documents(digest, doc, at):
    """Postings sorted by digest and document; whether each is of its digest's first document, and
    whether the digest has several documents."""
    order = np.lexsort((at, doc, digest))
    digest, doc, at = digest[order], doc[order], at[order]
    edge = np.flatnonzero(np.append(True, digest[1:] != digest[:-1]))
    size = np.diff(np.append(edge, len(digest)))
    return digest, doc, at, doc == np.repeat(doc[edge], size), np.repeat(doc[edge] != doc[edge + size - 1], size)


def _shared(docs: DataFrame, find, first_too: bool, buckets: int) -> DataFrame:
    """(doc_id, at): positions of digests that several documents hold, in all of them or in all but
    the first. The map side keeps the first document of a digest and batch."""

    def post(batches):
        for digest, doc, at in _gathered(batches, find):
            digest, doc, at, first, several = _first_documents(digest, doc, at)
            mark = several & (first_too | ~first)
            out = [(int(doc[0]) % buckets, doc[mark].tobytes(), None, at[mark].astype(np.int32).tobytes())]
            out += _by_bucket(buckets, digest[first], doc[first], at[first])
            yield _rows(out, ["bucket", "doc", "digest", "at"])

    def settle(table: pa.Table) -> pa.Table:
        marks, posts = [(np.zeros(0, np.int64), np.zeros(0, np.int32))], []
        for row in table.to_pylist():
            doc, at = np.frombuffer(row["doc"], np.int64), np.frombuffer(row["at"], np.int32)
            if row["digest"] is None:
                marks.append((doc, at))
            else:
                posts.append((np.frombuffer(row["digest"], np.uint64), doc, at))
        if posts:
            _, doc, at, first, several = _first_documents(*[np.concatenate(x) for x in zip(*posts, strict=True)])
            mark = several & (first_too | ~first)
            marks.append((doc[mark], at[mark]))
        return _by_document(buckets, *(np.concatenate(x) for x in zip(*marks, strict=True)))

    return _per_document(docs.mapInArrow(tidy(post), "bucket int, doc binary, digest binary, at binary").groupBy(
        "bucket").applyInArrow(tidy_group(settle), "group int, doc binary, at binary"))


def repeated_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, at): first words of the windows of a document that an earlier document holds."""
    ready = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text")
    near = written(_shared(ready, lambda batch, a, b, data, offsets: fingerprints(data, offsets), True, buckets),
                   "fingerprints")

    def find(batch, a, b, data, offsets):
        return windows(data, offsets, [np.asarray(x) for x in batch.column("near").slice(a, b - a).to_pylist()])

    found = written(_shared(ready.join(near.withColumnRenamed("at", "near"), "doc_id"), find, False, buckets), "windows")
    forget(near)
    return found


def cut_runs(text: str, at, min_words: int, starts=()) -> tuple[str, list, int]:
    """(text without the marked runs of units and the windows from ``starts`` on, removed character
    spans, removed words)."""
    raw = text.encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    _, _, words, _, _ = units(data, offsets)
    marked = np.zeros(len(words) + 2, bool)
    at = np.unique(np.asarray(at, np.int64))
    marked[1 + at[at < len(words)]] = True
    first = np.flatnonzero(marked[1:] & ~marked[:-1])
    behind = np.flatnonzero(marked[:-1] & ~marked[1:])
    sums = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    first, behind = sums[first[:len(behind)]], sums[behind]
    use = behind - first >= min_words
    starts = np.asarray(starts, np.int64)
    edge = np.zeros(sums[-1] + 2, np.int64)
    np.add.at(edge, 1 + np.concatenate([first[use], starts]), 1)
    np.add.at(edge, 1 + np.concatenate([behind[use], starts + WINDOW]), -1)
    covered = np.cumsum(edge) > 0
    first, behind = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    if not len(first):
        return text, [], 0
    begin = np.append(word_spans(data, offsets)[0], len(raw))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    spans = [(int(a), int(b)) for a, b in zip(chars[begin[first]], chars[begin[behind]], strict=True)]
    kept, done = [], 0
    for a, b in spans:
        kept.append(text[done:a])
        done = b
    return "".join([*kept, text[done:]]), spans, int(covered.sum())


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and the columns ``spans`` (characters of
    the original text) and ``removed_words``."""
    buckets = buckets_for(docs)
    marks, starts = repeated_units(docs, buckets).withColumnRenamed("at", "_at"), repeated_windows(docs, buckets)
    # written, so that the postings are gone before the texts are shuffled
    marks = written(marks.join(starts.withColumnRenamed("at", "_starts"), "doc_id", "full"), "marks")
    forget(starts)
    docs = docs.drop("spans", "removed_words")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))
    rows = docs.withColumn("_key", key).join(marks.withColumnRenamed("doc_id", "_key"), "_key", "left").drop("_key")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    names = docs.columns

    def cut(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                done = [(t, [], 0) if t is None or (m is None and w is None) else cut_runs(t, m or [], min_words, w or [])
                        for t, m, w in zip(*[part.column(c).to_pylist() for c in ("text", "_at", "_starts")], strict=True)]
                columns = [pa.array([d[0] for d in done], pa.string()) if c == "text" else part.column(c) for c in names]
                spans = pa.array([[{"begin": a, "end": b} for a, b in d[1]] for d in done], kind)
                yield pa.RecordBatch.from_arrays(columns + [spans, pa.array([d[2] for d in done], pa.int64())],
                                                 names + ["spans", "removed_words"])

    return rows.mapInArrow(tidy(cut), T.StructType(docs.schema.fields + [
        T.StructField("spans", span), T.StructField("removed_words", T.LongType())]))


@query("op6_passages")
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated passages, and what was removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", "text", "removed_words", "spans")
