"""SentencePiece encoding and decoding in batched numpy.

A text is cut into words (a run of word marks and what follows it); no piece crosses such a cut.
Distinct words of equal length advance together as one matrix; a substring is looked up by its
hash among the sorted piece keys.

Unigram models are encoded by Viterbi: for each end position the best score over all piece lengths
is a vectorised maximum, whose arg is the backpointer. The best-scoring path is not what a BPE model
yields (its scores only order the merges), so BPE models are encoded on the same matrices by
merging, in every word at once, the adjacent pair with the best score, the leftmost of equals,
until none is a piece. Characters outside the vocabulary become byte pieces, else the unknown.

Null and empty texts have no ids. Decoding gives the text back, except that the word mark U+2581
itself decodes to a blank, as in the public library; ids outside the vocabulary raise an error. Repeated
rows repeat their result; empty tables give empty results; other columns of ``docs`` are kept.
Texts are encoded where they lie, without a shuffle.
"""

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobflow.llm.common import give_back, mix, passes, text_buffers
from jobflow.llm.registry import query

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = 0x2581
#: bytes of text per numpy pass; words longer than this go through a heap instead of a matrix
PASS, LONG = 1 << 20, 64
#: characters of one matrix of equal-length words
CELLS = 1 << 18
_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 2**64)


def _powers(base, n):
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_P, LONG + 1), _powers(_PINV, LONG + 1)
_CODE = lambda cp: mix(cp.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def load_model(path: str = MODEL) -> dict:
    """Tables of a model file: piece texts, scores, kinds, and keys sorted by hash."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    if spec.normalizer_spec.name != "identity" or spec.normalizer_spec.remove_extra_whitespaces or \
            not spec.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with identity normalisation and a leading word mark are supported")
    kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
    return make_model([(p.piece, p.score, kinds.get(p.type, "normal")) for p in spec.pieces],
                      "bpe" if spec.trainer_spec.model_type == 2 else "unigram")


def make_model(pieces: list, kind: str) -> dict:
    """Tables of (piece, score, kind of piece) triples."""
    hashes, ids, scores, longest = [], [], [], 1
    raw, unknown, first_byte = [], 0, None
    for i, (piece, score, what) in enumerate(pieces):
        if what == "normal":
            cp = _points(piece)
            longest = max(longest, len(cp))
            hashes.append((_CODE(cp) * _powers(_P, len(cp))).sum(dtype=np.uint64))
            ids.append(i)
            scores.append(score)
            raw.append(piece.replace(chr(MARK), " ").encode())
        elif what == "byte":
            first_byte = i if first_byte is None else first_byte
            raw.append(bytes([int(piece[1:-1], 16)]))
        else:
            unknown = i if what == "unknown" else unknown
            raw.append(" ⁇ ".encode() if what == "unknown" else b"")
    if any(chr(MARK) in p.lstrip(chr(MARK)) for p, _, what in pieces if what == "normal"):
        raise ValueError("pieces that cross words are not supported")
    keys = mix(np.array(hashes, np.uint64))
    order = np.argsort(keys)
    return {"keys": keys[order], "ids": np.array(ids, np.int32)[order],
            "scores": np.array(scores, np.float64)[order], "kind": kind, "longest": longest, "unknown": unknown,
            "first_byte": first_byte, "bytes": np.frombuffer(b"".join(raw), np.uint8),
            "ends": np.cumsum([0] + [len(r) for r in raw])}


def _probe(model, hashes):
    """Index into the sorted keys, -1 where a substring is no piece."""
    at = np.minimum(np.searchsorted(model["keys"], hashes), len(model["keys"]) - 1)
    return np.where(model["keys"][at] == hashes, at, -1)


def _prefix(cp):
    """Prefix sums of position-weighted codes of words of one length."""
    sums = np.zeros((len(cp), cp.shape[1] + 1), np.uint64)
    np.cumsum(_CODE(cp) * _UP[:cp.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _sub(sums, i, j):
    """Hashes of substrings [i, j) of each row (arrays of equal shape)."""
    return mix((np.take_along_axis(sums, j, 1) - np.take_along_axis(sums, i, 1)) * _DOWN[i])


def viterbi_words(model, cp: np.ndarray) -> np.ndarray:
    """Cuts of words of one length by the best sum of piece scores: rows of boundaries, padded with
    the length. A character that is no piece costs more than any path without it."""
    n, length = cp.shape
    sums = _prefix(cp)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int64)
    worst = (model["scores"].min() if len(model["scores"]) else 0) - 10
    for end in range(1, length + 1):
        begins = np.arange(max(0, end - model["longest"]), end)
        i = np.broadcast_to(begins, (n, len(begins)))
        at = _probe(model, _sub(sums, i, np.full_like(i, end)))
        gain = np.where(at >= 0, model["scores"][at], -np.inf)
        gain[:, -1] = np.where(at[:, -1] >= 0, gain[:, -1], worst)
        total = best[:, begins] + gain
        pick = total.argmax(1)
        best[:, end], back[:, end] = total[np.arange(n), pick], begins[pick]
    cuts = np.full((n, length + 1), length)
    at, k = np.full(n, length), length
    while (at > 0).any():
        at = np.where(at > 0, back[np.arange(n), at], 0)
        k -= 1
        cuts[:, k] = at
    return _left(cuts, k, length)


def _left(cuts, first, length):
    """Drop the leading repeats of 0 of right-aligned boundaries."""
    out = np.full_like(cuts, length)
    zeros = (cuts[:, first:] == 0).sum(1) - 1 + first
    span = np.arange(cuts.shape[1])
    src = zeros[:, None] + span
    out[:] = np.where(src < cuts.shape[1], np.take_along_axis(cuts, np.minimum(src, cuts.shape[1] - 1), 1), length)
    return out


def merge_words(model, cp: np.ndarray) -> np.ndarray:
    """Cuts of words of one length by merging best pairs: rows of boundaries, padded with the length."""
    n, length = cp.shape
    sums = _prefix(cp)
    out = np.full((n, length + 1), length)
    rows, cuts = np.arange(n), np.broadcast_to(np.arange(length + 1), (n, length + 1)).copy()
    while len(rows):
        width = cuts.shape[1]
        if width < 3:
            out[rows, :width] = cuts
            break
        i, j = cuts[:, :-2], cuts[:, 2:]
        at = _probe(model, _sub(sums, i, j))
        real = (at >= 0) & (cuts[:, 1:-1] < length)
        score = np.where(real, model["scores"][at], -np.inf)
        pick = score.argmax(1)
        more = score[np.arange(len(rows)), pick] > -np.inf
        out[rows[~more], :width] = cuts[~more]
        rows, sums, cuts, pick = rows[more], sums[more], cuts[more], pick[more]
        keep = np.ones(cuts.shape, bool)
        keep[np.arange(len(rows)), pick + 1] = False
        cuts = cuts[keep].reshape(len(rows), width - 1)
    return out


def _merge_long(model, cp: np.ndarray) -> np.ndarray:
    """Boundaries of one long word, by a heap of pairs."""
    n = len(cp)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE(cp) * _powers(_P, n))])
    down = _powers(_PINV, n)

    def scores(i, j):
        at = _probe(model, mix((sums[j] - sums[i]) * down[i]))
        return np.where(at >= 0, model["scores"][at], -np.inf)

    begins = np.arange(n - 1)
    heap = [(-s, i, i + 1, i + 2) for i, s in enumerate(scores(begins, begins + 2)) if s > -np.inf]
    heapq.heapify(heap)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    while heap:
        _, i, mid, j = heapq.heappop(heap)
        if not (alive[i] and mid < n and alive[mid] and after[i] == mid and after[mid] == j):
            continue
        alive[mid] = False
        after[i] = j
        if j < n:
            before[j] = i
        near = [(before[i], i, j)] if before[i] >= 0 else []
        near += [(i, j, after[j])] if j < n else []
        if near:
            got = scores(np.array([x[0] for x in near]), np.array([x[2] for x in near]))
            for (a, b, c), s in zip(near, got, strict=True):
                if s > -np.inf:
                    heapq.heappush(heap, (-s, a, b, c))
    return np.append(np.flatnonzero(alive), n)


def _viterbi_long(model, cp: np.ndarray) -> np.ndarray:
    n = len(cp)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE(cp) * _powers(_P, n))])
    down, best, back = _powers(_PINV, n), np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    best[0], worst = 0, model["scores"].min() - 10
    for end in range(1, n + 1):
        i = np.arange(max(0, end - model["longest"]), end)
        at = _probe(model, mix((sums[end] - sums[i]) * down[i]))
        gain = np.where(at >= 0, model["scores"][at], -np.inf)
        gain[-1] = gain[-1] if at[-1] >= 0 else worst
        total = best[i] + gain
        k = int(total.argmax())
        best[end], back[end] = total[k], i[k]
    cuts = [n]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    return np.array(cuts[::-1])


def _ids_of(model, cp, begins, ends):
    """(ids, number of ids) of the substrings [begin, end) of ``cp``; foreign ones as bytes."""
    size = ends - begins
    power = int(size.max(initial=1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE(cp) * _powers(_P, len(cp)))])
    at = _probe(model, mix((sums[ends] - sums[begins]) * _powers(_PINV, len(cp) + 1)[begins])) if power else size
    ids, counts = np.where(at >= 0, model["ids"][at], model["unknown"]).astype(np.int32), np.ones(len(at), np.int64)
    odd = np.flatnonzero(at < 0)
    if not len(odd) or model["first_byte"] is None:
        return ids, counts
    raw = [cp[begins[k]:ends[k]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for k in odd]
    counts[odd] = [len(r) for r in raw]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    single = at >= 0
    out[place[single]] = ids[single]
    for k, r in zip(odd, raw, strict=True):
        out[place[k]:place[k] + len(r)] = np.frombuffer(r, np.uint8).astype(np.int32) + model["first_byte"]
    return out, counts


def encode(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text)."""
    lengths = np.array([len(t) + 1 if t else 0 for t in texts])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    cp = _points("".join(" " + t for t in texts if t)).copy()
    cp[cp == 32] = MARK
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    mark = cp == MARK
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    start[bounds[:-1][lengths > 0]] = True
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], len(cp))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE(cp) * _powers(_P, len(cp)))])
    key = mix((sums[ends] - sums[begins]) * _powers(_PINV, len(cp))[begins])
    _, first, word_of = np.unique(key, return_index=True, return_inverse=True)
    begin, size = begins[first], (ends - begins)[first]
    cuts_of, owners = [], []
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        if length > LONG:
            long_cuts = _merge_long if model["kind"] == "bpe" else _viterbi_long
            for r in rows:
                cuts = long_cuts(model, cp[begin[r]:begin[r] + length])
                cuts_of.append(np.stack([cuts[:-1], cuts[1:]]) + begin[r])
                owners.append(np.full(len(cuts) - 1, r))
            continue
        cut_words = merge_words if model["kind"] == "bpe" else viterbi_words
        step = max(1, CELLS // int(length))
        for k in range(0, len(rows), step):
            some = rows[k:k + step]
            cuts = cut_words(model, cp[begin[some][:, None] + np.arange(length)])
            real = cuts[:, :-1] < length
            r, c = np.nonzero(real)
            cuts_of.append(np.stack([cuts[r, c], cuts[r, c + 1]]) + begin[some][r])
            owners.append(some[r])
    spans, owner = np.concatenate(cuts_of, axis=1), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    spans, owner = spans[:, order], owner[order]
    ids, counts = _ids_of(model, cp, spans[0], spans[1])
    per_word = np.bincount(owner, counts, minlength=len(first)).astype(np.int64)
    at = np.cumsum(per_word) - per_word
    n = per_word[word_of]
    out = ids[np.repeat(at[word_of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    words_before = np.searchsorted(begins, bounds)
    return out, np.concatenate([[0], np.cumsum(n)])[words_before]


def decode(model: dict, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of id ranges."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model["ends"]) - 1):
        raise ValueError("id outside the vocabulary")
    size = np.diff(model["ends"])[ids]
    till = np.concatenate([[0], np.cumsum(size)])
    raw = model["bytes"][np.repeat(model["ends"][:-1][ids] - till[:-1], size) + np.arange(int(till[-1]))].tobytes()
    out = []
    for a, b in zip(till[offsets[:-1]], till[offsets[1:]], strict=True):
        text = raw[a:b].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def encode_table(docs: DataFrame, path: str = MODEL, drop_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip`` (decoding gave the text back)."""
    held = docs.sparkSession.sparkContext.broadcast(load_model(path))  # as large as the model file
    docs = docs.drop("ids", "n_tokens", "round_trip")
    names = [c for c in docs.columns if not (drop_text and c == "text")]

    def run(batches):
        model = held.value
        for batch in batches:
            column = batch.column("text")
            _, bounds = text_buffers(column)
            for a, b in passes(bounds, PASS):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, offsets = encode(model, texts)
                back = decode(model, ids, offsets)
                same = [t.replace(chr(MARK), " ") == r for t, r in zip(texts, back, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [lists, pa.array(np.diff(offsets), pa.int64()), pa.array(same)],
                    names + ["ids", "n_tokens", "round_trip"])
                give_back()

    fields = [docs.schema[c] for c in names] + [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(fields))


@query("op5_pieces")
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again for a check."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_table(docs).select("doc_id", "n_tokens", "ids", "round_trip")
