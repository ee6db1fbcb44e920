"""Fill-in-middle transformation by displacement scatter.

A text is cut into lines, and two of its cuts, drawn from a hash of the seed and the id, part it into
prefix, middle and suffix. The output holds them in psm order, ``<P>``prefix``<S>``suffix``<M>``middle,
or in spm order, ``<S>``suffix``<P>``prefix``<M>``middle. Empty texts, texts that contain a marker,
and a share of ``100 - rate`` in a hundred stay as they are: plain.

All bytes of a batch move at once. The start of every part enters the change of the shift into a
difference array; its running sum is the shift of every byte from its place in the batch to its
place in the output, and one scatter writes them all. The inverse reads the markers of an output,
builds the same kind of array over the restored bytes, and gathers.

Null texts are empty texts. A null id is hashed as the text ``null``. Rows that share an id and a text
share the result; rows that share an id alone are cut by the same hashes. Texts of any length are
one piece of a batch. Empty tables give empty results. Extra columns are kept, but those with the
names that are added are replaced. Nothing is shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobflow.llm.common import passes, text_buffers
from jobflow.llm.registry import query

SEED = 7
#: of a hundred texts: so many are transformed, and so many of those in spm order
RATE, SPM = 100, 50
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
_MARKERS = {name: np.frombuffer(f"<{name}>".encode(), np.uint8) for name in "PSM"}
_SIZE = 3
#: order of the parts (0 prefix, 1 middle, 2 suffix) and of their markers
_ORDER = {PSM: ((0, "P"), (2, "S"), (1, "M")), SPM_FORM: ((2, "S"), (0, "P"), (1, "M"))}


def marker_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, text) of every marker inside a text."""
    if len(data) < _SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = data[1:-1]
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & ((letter == 80) | (letter == 83) | (letter == 77)))
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + _SIZE <= offsets[doc + 1]
    return at[inside], doc[inside]


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte behind every line of many texts, and the lines before each text."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    open_end = offsets[full + 1] - 1
    last = np.unique(np.concatenate([np.flatnonzero(data == 10), open_end]))
    return last + 1, np.searchsorted(last, offsets)


def _moved(starts: np.ndarray, shifts: np.ndarray, total: int) -> np.ndarray:
    """Place plus shift of every byte; ``starts`` ascend, and a part keeps its shift up to the next."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change[:-1]) + np.arange(total)


def _layout(forms, part_sizes):
    """(first byte of each part, first byte of each marker, size) of every output, from 0 on."""
    parts, marks = np.zeros((3, len(forms)), np.int64), np.zeros((3, len(forms)), np.int64)
    size = part_sizes.sum(0)
    parts[1], parts[2] = part_sizes[0], part_sizes[0] + part_sizes[1]
    for form, order in _ORDER.items():
        rows = np.flatnonzero(forms == form)
        at = np.zeros(len(rows), np.int64)
        for part, _ in order:
            marks[part, rows] = at
            parts[part, rows] = at + _SIZE
            at = at + _SIZE + part_sizes[part, rows]
        size[rows] = at
    return parts, marks, size


def scatter(data, offsets, draws, rate=RATE, spm=SPM):
    """Of many texts, with four drawn numbers each: (lines, forms, prefix bytes, middle bytes,
    output bytes, output offsets)."""
    ends, before = line_ends(data, offsets)
    n = np.diff(before)
    cuts = np.sort(draws[:2] % (n + 1), axis=0)
    cut = np.where(cuts > 0, np.append(ends, 0)[np.minimum(before[:-1] + cuts - 1, len(ends))], offsets[:-1])
    forms = np.where(draws[3] % 100 < spm, SPM_FORM, PSM)
    forms[(n == 0) | (draws[2] % 100 >= rate)] = PLAIN
    forms[marker_places(data, offsets)[1]] = PLAIN
    edges = np.stack([offsets[:-1], cut[0], cut[1], offsets[1:]])
    sizes = np.diff(edges, axis=0)
    parts, marks, size = _layout(forms, sizes)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.uint8)
    out[_moved(edges[:3].T.ravel(), (begin[:-1] + parts - edges[:3]).T.ravel(), len(data))] = data
    for form, order in _ORDER.items():
        rows = np.flatnonzero(forms == form)
        for part, name in order:
            out[(begin[rows] + marks[part, rows])[:, None] + np.arange(_SIZE)] = _MARKERS[name]
    return n, forms, sizes[0], sizes[1], out, begin


def gather(data, offsets, forms):
    """The inverse: (text bytes, offsets, whether each output could be read). An output that is not
    plain and does not hold exactly its three markers in order gives no bytes."""
    at, doc = marker_places(data, offsets)
    first = np.searchsorted(doc, np.arange(len(forms) + 1))
    good = np.ones(len(forms), bool)
    edges = np.stack([offsets[:-1], offsets[1:], offsets[1:]])
    sizes = np.stack([offsets[1:] - offsets[:-1], np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64)])
    for form, order in _ORDER.items():
        rows = np.flatnonzero(forms == form)
        whole = first[rows + 1] - first[rows] == 3
        good[rows[~whole]] = False
        rows = rows[whole]
        found = at[first[rows][:, None] + np.arange(3)].reshape(-1, 3)
        letters = np.array([ord(name) for _, name in order])
        right = (data[found + 1] == letters).all(1) & (found[:, 0] == offsets[rows])
        good[rows[~right]] = False
        rows, found = rows[right], found[right]
        till = np.concatenate([found[:, 1:], offsets[rows + 1][:, None]], axis=1)
        for k, (part, _) in enumerate(order):
            edges[part, rows] = found[:, k] + _SIZE
            sizes[part, rows] = till[:, k] - found[:, k] - _SIZE
    sizes[:, ~good] = 0
    size = sizes.sum(0)
    begin = np.concatenate([[0], np.cumsum(size)])
    places = begin[:-1] + np.stack([np.zeros_like(size), sizes[0], sizes[0] + sizes[1]])
    source = _moved(places.T.ravel(), (edges - places).T.ravel(), int(begin[-1]))
    return data[source], begin, good


def _strings(data, offsets, good=None):
    """An Arrow string column from bytes and offsets."""
    mask = None if good is None or good.all() else pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [
        mask, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` (code points, null
    where plain) and ``output``."""
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    docs = docs.drop(*added)
    names = docs.columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_fim_{k}") for k in range(4)]

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            drawn = np.stack([batch.column(f"_fim_{k}").to_numpy() for k in range(4)])
            for a, b in passes(offsets):
                here, bounds = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                n, forms, prefix, middle, out, begin = scatter(here, bounds, drawn[:, a:b], rate, spm)
                chars = np.concatenate([[0], np.cumsum((here & 0xC0) != 0x80)])
                cut = np.stack([bounds[:-1], bounds[:-1] + prefix, bounds[:-1] + prefix + middle])
                lengths, plain = np.diff(chars[cut], axis=0), forms == PLAIN
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [
                        pa.array(n, pa.int64()), pa.array(FORMS[forms].tolist(), pa.string()),
                        pa.array(lengths[0], pa.int64(), mask=plain), pa.array(lengths[1], pa.int64(), mask=plain),
                        _strings(out, begin)], names + added)

    fields = docs.schema.fields + [
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return docs.select("*", *draws).mapInArrow(run, T.StructType(fields))


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``, the text rebuilt from ``output`` and ``form``; null where the output
    is null, the form unknown, or the markers are not those of the form."""
    rows = rows.drop("restored")
    names = rows.columns

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("output"))
            for a, b in passes(offsets):
                part = batch.slice(a, b - a)
                known = np.array([f in FORMS for f in part.column("form").to_pylist()], bool)
                known &= ~np.asarray(part.column("output").is_null())
                forms = np.array([int(np.flatnonzero(FORMS == f)[0]) if k else PLAIN
                                  for f, k in zip(part.column("form").to_pylist(), known, strict=True)], np.int64)
                text, begin, good = gather(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], forms)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [_strings(text, begin, good & known)],
                                                 names + ["restored"])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField("restored", T.StringType())]))


OP11_SQL = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units FROM documents),
drawn AS (SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS c1,
    CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS h3,
    CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS h4 FROM hashed),
cut AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain'
      WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:CAST(least(c1, c2) AS BIGINT)], '') AS prefix,
    array_to_string(units[CAST(least(c1, c2) AS BIGINT) + 1:CAST(greatest(c1, c2) AS BIGINT)], '') AS middle,
    array_to_string(units[CAST(greatest(c1, c2) AS BIGINT) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""


@query("op11_fill_middle", OP11_SQL)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from the output."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = transform(docs).drop("text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
