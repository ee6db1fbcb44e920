"""Helpers that several corpus operators share: scratch tables, numpy word hashing, components."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.session import discard, scratch_path

#: words of every text contract: runs of anything but blank and \t..\r
WORD = r"[^\x20\x09-\x0D]+"
#: bytes of text that one numpy pass handles (a longer single text is one pass of its own)
PASS_BYTES = 1 << 20

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_powers: dict = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str, group_bytes: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors.

    Nothing reads the shuffles of the write again, so their files go as soon as it has ended. Tables of
    large rows ask for row groups of ``group_bytes``: by itself the format looks at a group's size after
    100 rows first, and holds whole groups in memory when it writes and reads them. ``batch_bytes`` bounds
    the Arrow batches that Python gets.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    settings = {_CLEANUP: "true"} | ({} if batch_bytes is None else {_BATCH: str(batch_bytes)})
    before = {k: conf.get(k, None) for k in settings}
    writer = df.write if group_bytes is None else df.write.options(**{
        "parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    try:
        for k, v in settings.items():
            conf.set(k, v)
        writer.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        discard(table.sparkSession, [table._scratch])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else offsets


def passes(offsets: np.ndarray, most: int = PASS_BYTES):
    """(first, last) row ranges of about ``most`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def give_back() -> None:
    """Return the worker's freed memory to the system: Arrow's pool and the C library keep it otherwise,
    and a worker lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` over batches, whose worker gives back at the end what the task has freed."""

    def over(batches):
        yield from run(batches)
        give_back()

    return over


def tidy_group(run):
    """``run`` over one group, likewise."""

    def over(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return over


def slices(batches, most: int = 4 * PASS_BYTES, column: str = "text"):
    """Arrow batches cut so that each holds about ``most`` bytes of text: bounds a worker's memory."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        for first, last in passes(offsets, most):
            yield batch.slice(first, last - first)
            give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a text's end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    now = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(now & ~before), np.flatnonzero(now & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of many texts, and the word offset of each text."""
    starts, ends = word_spans(data, offsets)
    n = len(data) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, n)[:-1][:len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_PINV, n)[starts])
    return hashes, np.searchsorted(starts, offsets)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``: component is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then follows labels once, so paths
    halve. Every round is a written table: neither labels nor edges pass through the driver, and
    both join sides are plain tables, so a node with very many edges can be split.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(
        edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = written(both.where("u != v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v")
        near = near.groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = written(labels.select("node", "label").join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "hooked")
        forget(labels)
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(hooked.join(jump, "label").select("node", "old", F.col("next").alias("label")), "labels")
        forget(hooked)
        if not labels.where("old != label").limit(1).count():
            forget(both)
            return labels.select("node", F.col("label").alias("component"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: bytes of text whose postings one bucket should hold
BUCKET_BYTES = 1 << 23


def buckets_for(docs: DataFrame, each: int = BUCKET_BYTES) -> int:
    """How many hash buckets the postings of ``docs`` need: by the bytes of their texts, not by the
    cluster's size, so that a bucket's row holds many postings of a batch at any size."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // each))
