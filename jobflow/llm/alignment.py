"""Alignment of two tokenizers over a corpus, with corpus-wide counts of aligned ids.

A text is encoded by a byte-level BPE (A) and by a SentencePiece model (B); both are read as tokens of
bytes of ``space + text``. Offsets where tokens of both end cut the tokens into groups, and every pair of
an A and a B token whose bytes overlap is a link. The overlap of two tokens is one range between
neighbouring token ends, so the ends of both tokenizers, merged, list all links.

Counts of id pairs come in steps, each a Spark shuffle of packed arrays:

1. texts are encoded once into a written table: a row of ids per ``CALL`` bytes of text, and a row of the
   distinct pairs with their counts per unit of about ``UNIT`` bytes;
2. pairs are dealt by B id to buckets, units to salts. Distinct pairs of a bucket are united salt by salt,
   then over the salts, and get a minimal perfect hash: levels of bit arrays in which a key owns a bit if
   no other key of the level falls on it, the rest goes to the next level;
3. a salt's counts become a dense vector indexed by the hash; vectors are summed over the salts. The key
   at every place is stored, so a look-up is verified;
4. units look their pairs up in the salts' copies of the tables, and the second pass meets a unit's rows with
   its answers, aligns every document of the written table again and reads its links' counts.

So no step holds the counts of all pairs, and nothing is broadcast but the two model files. A task holds one
unit of text, in either pass and however large its split is; the written tables have small row groups.

Texts that are null, empty, or whose joined A or B bytes differ from space + text have no tokens: zeros, and
empty ``groups``. Strings of special tokens are plain text. Null, repeated ids: every row has its own
result. Long texts are a row of their own. Ties of counts are all best. Empty tables give
empty results. Extra columns are not read.
"""

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm.common import forget, give_back, mix, passes, slices, text_buffers, written
from jobflow.llm.registry import query

BYTE_MODEL = os.environ.get("BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: bytes of text of a unit, of one call of an encoder, and of one alignment
UNIT, CALL, ALIGN = 1 << 22, 1 << 18, 1 << 20
#: pairs that a (bucket, salt) should hold
PAIRS = 1 << 20
#: bytes of a row group of the written tables
GROUP = 1 << 24

#: how byte-level vocabularies of this kind cut a text before they merge (fixed value)
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: a blank run this long is too deep for the fast encoder's pattern
_BLANKS = re.compile(r"\s{4096}")

_models: dict = {}


def _flat(tokens: list[bytes]):
    """(bytes of all tokens, offset of each)."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), ends


def byte_letters() -> dict:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_encoder(file: str):
    """Texts -> id lists, for a byte-level vocabulary file.

    Where ids follow the order of the merges and texts are cut by the usual pattern, merging by rank gives
    the same ids in a quarter of the time (tested over all code points); other files, and texts with a
    very long run of blanks, go through the file's own library.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(file)
    own.encode_special_tokens = True
    slow = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    spec, letters = json.loads(file), byte_letters()
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {t: k for t, k in model["vocab"].items() if t not in special}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    usual = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    usual = usual and spec.get("normalizer") is None and not model.get("ignore_merges") and merged == list(range(256, 256 + len(merged)))
    if not usual or any(c not in letters for t in vocabulary for c in t):
        return slow
    import tiktoken

    ranks = {bytes(letters[c] for c in t): k for t, k in vocabulary.items()}
    fast = tiktoken.Encoding("byte_level", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [slow([t])[0] if _BLANKS.search(t) else fast.encode_ordinary(t) for t in texts]


def load_models(spec: tuple[str, bytes]) -> dict:
    """Encoders and token bytes from the contents of the two model files; once per worker."""
    key = hash(spec)
    if key not in _models:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        letters = byte_letters()
        vocabulary = json.loads(spec[0])["model"]["vocab"]
        texts = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in letters for c in token):
                texts[k] = bytes(letters[c] for c in token)
        b = sentencepiece.SentencePieceProcessor(model_proto=spec[1])
        pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()
                  for k, p in ((k, b.id_to_piece(k)) for k in range(b.get_piece_size()))]
        _models[key] = {"decimals": _decimals(max(len(texts), len(pieces))), "a": byte_encoder(spec[0]), "b": b, "a_bytes": _flat(texts), "b_bytes": _flat(pieces)}
    return _models[key]


def _spelled(table, ids):
    """Bytes of tokens, joined."""
    data, ends = table
    size = np.diff(ends)[ids]
    till = np.cumsum(size)
    return data[np.repeat(ends[ids] - (till - size), size) + np.arange(int(till[-1]) if len(till) else 0)]


def encode(models: dict, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, B ids, A tokens of each text, B tokens of each text); zeros for texts without tokens."""
    have = [k for k, t in enumerate(texts) if t]
    said = [texts[k] for k in have]
    a_of = models["a"]([" " + t for t in said])
    b_of = models["b"].encode(said, num_threads=1) if said else []
    counts, out = np.zeros((2, len(texts)), np.int64), ([], [])
    for k, text, a, b in zip(have, said, a_of, b_of, strict=True):
        raw = (" " + text).encode()
        ids = np.array(a, np.int64), np.array(b, np.int64)
        if all(_spelled(models[m], i).tobytes() == raw for m, i in zip(("a_bytes", "b_bytes"), ids, strict=True)):
            for side in (0, 1):
                counts[side, k] = len(ids[side])
                out[side].append(ids[side])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return a, b, counts[0], counts[1]


def align(models: dict, a, b, n_a, n_b):
    """Of the tokens of some texts: (A token, B token, text, is a group's end) per link, in order."""
    a_end = np.cumsum(np.diff(models["a_bytes"][1])[a])
    b_end = np.cumsum(np.diff(models["b_bytes"][1])[b])
    ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two ascending runs: a merge
    ends = ends[np.append(ends[1:] != ends[:-1], True)[:len(ends)]]
    at_a, at_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    text = np.searchsorted(np.cumsum(n_a), at_a, "right")
    return at_a, at_b, text, (a_end[at_a] == ends) & (b_end[at_b] == ends) if len(ends) else np.zeros(0, bool)


def _decimals(n: int):
    """Decimal digits of the numbers below ``n`` as rows of right-aligned bytes, and how many each has."""
    width = len(str(max(n - 1, 1)))
    digits = (np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)) % 10 + 48
    return digits.astype(np.uint8), 1 + sum((np.arange(n) >= 10**k).astype(np.int8) for k in range(1, width))


def written_groups(models, a, b, n_a, n_b, at_a, at_b, ends) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every text, as a string column."""
    last_a, last_b = at_a[ends], at_b[ends]
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    before_b = np.concatenate([[0], last_b + 1])
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + last_a[group_b] + 1 if len(b) else np.zeros(0, np.int64)
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    digits, size = (x[ids] for x in models["decimals"])
    till = np.cumsum(size + 1, dtype=np.int64)
    out = np.zeros(int(till[-1]) if len(till) else 0, np.uint8)
    width = digits.shape[1]
    for k in range(width):
        on = size >= width - k
        out[till[on] - 1 - (width - k)] = digits[on, k]
    out[till - 1] = mark
    tokens = np.concatenate([[0], np.cumsum(n_a + n_b)])
    bounds = np.concatenate([[0], till])[tokens]
    keep = np.ones(len(out), bool)
    keep[bounds[1:][np.diff(bounds) > 0] - 1] = False  # the last mark of a text
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return pa.Array.from_buffers(pa.large_string(), len(n_a), [
        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[keep])]).cast(pa.string())


# --- packed arrays ---------------------------------------------------------------------------------

def _pack(x: np.ndarray) -> bytes:
    import zstandard

    x = np.asarray(x, np.int64)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _open(raw: bytes) -> np.ndarray:
    import zstandard

    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[raw[0]]
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), kind).astype(np.int64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _open_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_open(raw))


# --- minimal perfect hash --------------------------------------------------------------------------

def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash of distinct keys."""
    levels = []
    while len(keys):
        size = 8 * (len(keys) // 4 + 1)
        slot = _slots(keys, len(levels), size)
        alone = np.bincount(slot, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[slot]]
    return levels


def hash_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Index of each key; for others than the hashed keys, any index, or -1."""
    out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    base = 0
    for k, bits in enumerate(levels):
        slot = _slots(keys[open_], k, len(bits))
        found = bits[slot]
        rank = np.cumsum(bits) - 1
        out[open_[found]] = base + rank[slot[found]]
        open_ = open_[~found]
        base += int(rank[-1]) + 1
    return out


def _pack_levels(levels):
    return [np.packbits(x).tobytes() for x in levels]


def _open_levels(levels):
    return [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in levels]


def _looked_up(row: dict, keys: np.ndarray) -> np.ndarray:
    """Verified indexes of ``keys`` in a bucket's table."""
    return _found(_open_levels(row["levels"]), _open(row["keys"]), keys)


def _found(levels, ordered, keys):
    at = hash_of(levels, keys)
    if (at < 0).any() or (ordered[at] != keys).any():
        raise ValueError("a pair is missing from its bucket's table")
    return at


# --- jobs ------------------------------------------------------------------------------------------

def _counted(a, b, at_a, at_b):
    """Distinct pairs (B id above A id in one number), ascending, and their counts."""
    return np.unique((b[at_b] << 32) | a[at_a], return_counts=True)


def _summed(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some (keys, counts), ascending, and their summed counts."""
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in found]))
    return keys, counts


def encode_units(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL):
    """(units, models): a written table of encoded units, and the broadcast contents of the models. Its rows
    hold the ids of some texts (``keys`` is null) or a unit's pairs (``ids`` is null)."""
    with open(byte_model, encoding="utf-8") as a, open(piece_model, "rb") as b:
        held = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def record(*row):
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, UNIT_TYPES, strict=True)], UNIT_COLUMNS)

    def paired(unit, found):
        keys, counts = _summed(found)
        return record(unit, *[None] * 5, len(keys), _pack_sorted(keys), _pack(counts))

    def run(batches):
        models = load_models(held.value)
        unit, size, found = TaskContext.get().partitionId() << 32, 0, []
        for batch in slices(batches, UNIT):
            _, offsets = text_buffers(batch.column("text"))
            for x, y in passes(offsets, CALL):
                part = batch.slice(x, y - x)
                a, b, n_a, n_b = encode(models, part.column("text").to_pylist())
                found.append(_counted(a, b, *align(models, a, b, n_a, n_b)[:2]))
                yield record(unit, part.column("doc_id").cast(pa.int64()).to_pylist(), _pack(n_a), _pack(n_b), _pack(a), _pack(b), 0, None, None)
                size += int(offsets[y] - offsets[x])
                if size >= UNIT:
                    yield paired(unit, found)
                    unit, size, found = unit + 1, 0, []
        if found:
            yield paired(unit, found)

    units = docs.select("doc_id", "text").mapInArrow(
        run, "unit long, ids array<long>, n_a binary, n_b binary, a binary, b binary, pairs long, keys binary, counts binary")
    return written(units, "units", GROUP, UNIT), held


UNIT_COLUMNS = ["unit", "ids", "n_a", "n_b", "a", "b", "pairs", "keys", "counts"]
UNIT_TYPES = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), *[pa.binary()] * 2]


def _rows(batch):
    """Rows of a batch or table one by one, as dicts."""
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _table(columns: dict, schema: list) -> pa.Table:
    return pa.table({n: pa.array(columns[n], k) for n, k in schema})


_TABLE = [("bucket", pa.int32()), ("levels", pa.list_(pa.binary())), ("keys", pa.binary()), ("totals", pa.binary()),
          ("best", pa.binary())]


def pair_tables(units: DataFrame):
    """(postings, tables, salts): pairs of the units dealt to buckets and salts, and per bucket the perfect
    hash, the keys in its order, their corpus-wide counts, and whether a pair is its B id's best."""
    pairs = units.agg(F.sum("pairs")).first()[0] or 0
    buckets = max(1, int(np.ceil(np.sqrt(pairs / (1 << 16)))))  # rows of units x buckets, pairs of salts x buckets
    salts = max(1, int(np.ceil(pairs / buckets / PAIRS)))

    def deal(batches):
        for batch in batches:
            for row in _rows(batch):
                keys, counts = _open_sorted(row["keys"]), _open(row["counts"])
                bucket = (mix((keys >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                rows = [(int(k), row["unit"] % salts, row["unit"], _pack_sorted(keys[bucket == k]), _pack(counts[bucket == k]))
                        for k in np.unique(bucket)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [
                        pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)],
                        ["bucket", "salt", "unit", "keys", "counts"])

    posts = written(units.where("keys is not null").select("unit", "keys", "counts").mapInArrow(
        deal, "bucket int, salt long, unit long, keys binary, counts binary"), "postings", GROUP, UNIT)

    def united(table):
        rows = table.to_pylist()
        keys = np.unique(np.concatenate([_open_sorted(r["keys"]) for r in rows]))
        return _table({"bucket": [rows[0]["bucket"]], "keys": [_pack_sorted(keys)]}, [("bucket", pa.int32()), ("keys", pa.binary())])

    def hashed(table):
        keys = _open_sorted(united(table).column("keys")[0].as_py())
        levels = perfect_hash(keys)
        ordered = np.zeros(len(keys), np.int64)
        ordered[hash_of(levels, keys)] = keys
        return _table({"bucket": [table.column("bucket")[0].as_py()], "levels": [_pack_levels(levels)], "keys": [_pack(ordered)]},
                      _TABLE[:3])

    one = posts.select("bucket", "salt", "keys").groupBy("bucket", "salt").applyInArrow(united, "bucket int, keys binary")
    hashes = written(one.groupBy("bucket").applyInArrow(hashed, "bucket int, levels array<binary>, keys binary"), "hashes", GROUP)

    def vector(left, right):
        rows, table = left.to_pylist(), right.to_pylist()
        if not rows:
            return _table({"bucket": [], "totals": []}, [("bucket", pa.int32()), ("totals", pa.binary())])
        total = np.zeros(len(_open(table[0]["keys"])), np.int64)
        keys = np.concatenate([_open_sorted(r["keys"]) for r in rows])
        np.add.at(total, _looked_up(table[0], keys), np.concatenate([_open(r["counts"]) for r in rows]))
        return _table({"bucket": [rows[0]["bucket"]], "totals": [_pack(total)]}, [("bucket", pa.int32()), ("totals", pa.binary())])

    def summed(left, right):
        table = right.to_pylist()[0]
        total = np.sum([_open(v) for v in left.column("totals").to_pylist()], axis=0)
        keys = _open(table["keys"])
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order] >> 32, prepend=-1))
        most = np.zeros(len(keys), np.int64)
        most[order] = np.repeat(np.maximum.reduceat(total[order], first), np.diff(np.append(first, len(keys))))
        return _table({"bucket": [table["bucket"]], "levels": [table["levels"]], "keys": [table["keys"]],
                       "totals": [_pack(total)], "best": [_pack(total == most)]}, _TABLE)

    vectors = posts.select("bucket", "salt", "keys", "counts").groupBy("bucket", "salt").cogroup(
        salted(hashes, salts).groupBy("bucket", "salt")).applyInArrow(vector, "bucket int, totals binary")
    tables = written(vectors.groupBy("bucket").cogroup(hashes.groupBy("bucket")).applyInArrow(
        summed, "bucket int, levels array<binary>, keys binary, totals binary, best binary"), "pair_tables", GROUP)
    forget(hashes)
    return posts, tables, salts


def salted(tables: DataFrame, salts: int) -> DataFrame:
    """A copy of every bucket's table for each salt."""
    return tables.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def pair_counts(tables: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked id pair of the corpus."""

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = _open(row["keys"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys & 0xFFFFFFFF), pa.array(keys >> 32), pa.array(_open(row["totals"])),
                     pa.array(_open(row["best"]).astype(bool))], ["a", "b", "count", "best"])

    return tables.mapInArrow(spread, "a long, b long, count long, best boolean")


def aligned(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``, the
    groups' ids as text."""
    units, held = encode_units(docs, byte_model, piece_model)
    posts, tables, salts = pair_tables(units)

    def answered(left, right):
        out = {"unit": [], "keys": [], "totals": [], "best": []}
        if left.num_rows:
            table = right.to_pylist()[0]
            levels, ordered, totals, best = _open_levels(table["levels"]), *(_open(table[c]) for c in ("keys", "totals", "best"))
        for row in _rows(left):
            at = _found(levels, ordered, _open_sorted(row["keys"]))
            for name, x in (("unit", row["unit"]), ("keys", row["keys"]), ("totals", _pack(totals[at])), ("best", _pack(best[at]))):
                out[name].append(x)
        return _table(out, [("unit", pa.int64()), *[(n, pa.binary()) for n in ("keys", "totals", "best")]])

    answers = written(posts.select("bucket", "salt", "unit", "keys").groupBy("bucket", "salt").cogroup(
        salted(tables, salts).groupBy("bucket", "salt")).applyInArrow(
        answered, "unit long, keys binary, totals binary, best binary"), "answers", GROUP)
    texts = units.where("ids is not null").select("unit", "ids", "n_a", "n_b", "a", "b")

    def second_pass(left, right):
        models = load_models(held.value)
        widths = np.diff(models["a_bytes"][1])
        known = _known(right)
        out = [part for row in _rows(left) for part in _results(models, widths, row, known)]
        give_back()
        return pa.Table.from_batches(out, _RESULT)

    return texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        second_pass, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


_RESULT = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.string())])


def _known(answers):
    """(keys, totals, best) of a unit's pairs, by ascending key."""
    parts = [[_open_sorted(r["keys"]), _open(r["totals"]), _open(r["best"])] for r in _rows(answers)]
    keys, totals, best = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    order = np.argsort(keys)
    return keys[order], totals[order], best[order]


def _results(models, widths, row, known):
    """Result rows of a row of encoded texts, in passes of about ``ALIGN`` bytes of tokens."""
    n_a, n_b, a, b = (_open(row[c]) for c in ("n_a", "n_b", "a", "b"))
    keys, totals, best = known
    till_a, till_b = (np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b))
    sizes = np.concatenate([[0], np.cumsum(widths[a])])[till_a]
    for x, y in passes(sizes, ALIGN):
        a_, b_, na, nb = a[till_a[x]:till_a[y]], b[till_b[x]:till_b[y]], n_a[x:y], n_b[x:y]
        at_a, at_b, text, ends = align(models, a_, b_, na, nb)
        at = np.searchsorted(keys, (b_[at_b] << 32) | a_[at_a])
        total = lambda w, t=text, n=y - x: np.bincount(t, w, minlength=n).astype(np.int64)
        sums = np.zeros(y - x, np.int64)
        np.add.at(sums, text, totals[at])  # exact: a float sum would round above 2^53
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"][x:y], pa.int64()), pa.array(na), pa.array(nb), pa.array(total(ends)),
             pa.array(np.bincount(text, minlength=y - x).astype(np.int64)), pa.array(total(best[at])), pa.array(sums),
             written_groups(models, a_, b_, na, nb, at_a, at_b, ends)], schema=_RESULT)


@query("op13_align")
def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document by both tokenizers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups"), 256))
    return aligned(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                digest.alias("groups_sha256"))
