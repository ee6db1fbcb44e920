"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Equal sets fold into
one node (identified by a hash of the set), so exact copies are compared once.

Tiles. Two sets with Jaccard >= t share one of the first n - ceil(t n) + 1 hashes of each, in any
order that is the same for all, and their sizes differ by a factor of at most 1 / t. The order here
is by the count of a shingle's rarest word (by octaves; words under ``share`` of all words count as
equally rare, so at most 1 / share counts are broadcast), then by hash, so common passages come
last. Each set posts its first hashes, and some spare ones, to tiles, packed by hash bucket. A tile
of up to ``tile`` sets gives the pairs whose sizes lie in one band of that factor. A larger tile
belongs to a frequent shingle; it gives three pairs per set, with its smallest member and with its
neighbours by set id. Sets whose posted
hashes are still enough without the frequent ones (ordering frequent hashes last) meet their
partners in small tiles. The other, *crowded* sets (large families of near copies, texts made of
common passages) are completed below.

Bounds. Every set has a bitmap of its hashes, its length set by the band of its size (folded to
the shorter of two). Equal bits bound the overlap from above: (|A| + |B| - differing bits) / 2.
Only pairs whose bound reaches the threshold go on. The bitmaps are made where the texts are first read.

Exact. Each set is first bounded with its smallest partner, and compared by intersecting sorted arrays where
the bound lets them link. Pairs that are not connected then are bounded, each set is compared with its
smallest partner and with the one of the best bound, and what is still apart is compared in full. Arrays are made
of sets that such a pair or a crowded tile holds only. Then the tiles of frequent shingles are visited
again, in blocks of bounded size: where a crowded set meets sets of another component, longer bitmaps tell
which sets of the block have a partner that may link. Only these send their arrays to the block, where
pairs that pass the bound are intersected, best bounds first, unless links found before have joined
them; only links that join components leave the block. So a family of g near copies costs
some comparisons per member, not g * g, and no link that would join two components is missed.

Null, empty and wordless texts have an empty set and are components of their own. Texts under five
words are one shingle. Rows that repeat an id are one document with one row in the result each. A
null id takes part as the smallest number and comes back as null. Empty tables give empty results; other columns are
not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm.common import buckets_for, components, forget, give_back, mix, passes, slices, text_buffers, tidy, tidy_group, word_hashes, written
from jobflow.llm.lm import count_words
from jobflow.llm.registry import query

WORDS, SIMILAR = 5, 75  # shingle length, per cent
#: sets in a tile whose pairs are all candidates; spare postings, as a part of the set
TILE, SPARE = 32, 0.02
#: rows per block where a frequent shingle's tile is compared again
BLOCK = 4096
#: bits per hash of the bitmaps used there
SHARP = 16
#: postings that a map task gathers before it packs them by bucket
GATHER = 1 << 19
#: share of all words at which a word's count is told apart
SHARE = 2.0 ** -22
_NULL = -(2**63)
_MIXERS = np.random.default_rng(11).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data, offsets, rarity=None):
    """Sorted distinct shingle hashes of each text. With ``rarity`` (sorted words, their octaves)
    pairs of those and the octave of each one's rarest word."""
    words, bounds = word_hashes(data, offsets)
    n = len(words)
    octave = np.zeros(n, np.uint8)
    if rarity is not None and len(rarity[0]):
        at = np.minimum(np.searchsorted(rarity[0], words), len(rarity[0]) - 1)
        octave = np.where(rarity[0][at] == words, rarity[1][at], 0).astype(np.uint8)
    rarest = octave[:max(0, n - WORDS + 1)].copy()
    for k in range(1, WORDS):
        np.minimum(rarest, octave[k:k + len(rarest)], out=rarest)
    whole = np.zeros(0, np.uint64)
    if n >= WORDS:
        whole = np.zeros(n - WORDS + 1, np.uint64)
        for k in range(WORDS):
            whole += words[k:n - WORDS + 1 + k] * _MIXERS[k]
        whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            own, first = np.unique(whole[a:b - WORDS + 1], return_index=True)
            octaves = rarest[a:b - WORDS + 1][first]
        elif b > a:
            own = mix((words[a:b] * _MIXERS[:b - a]).sum(keepdims=True) + np.uint64(b - a))
            octaves = octave[a:b].min(keepdims=True)
        else:
            own, octaves = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        out.append(own if rarity is None else (own, octaves))
    return out


def word_octaves(docs: DataFrame, share: float = SHARE):
    """(words, octaves of their counts) of the words that make up ``share`` of all or more; sorted,
    1 / share of them at most."""
    table = written(count_words(docs.select("text", F.lit(0).cast("long").alias("part"))), "words")
    total = table.agg(F.sum("kept")).first()[0] or 0
    found = table.where(F.col("kept") >= share * total).select("word", "kept").toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    octaves = np.floor(np.log2(np.maximum(found.column("kept").to_numpy(), 1))).astype(np.uint8)
    words, octaves = words[order], octaves[order]
    del found, order
    give_back()
    return words, octaves


def set_id(shingles: np.ndarray) -> np.int64:
    """Hash of a whole set (order-free sum of independent hashes, with the size)."""
    total = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(shingles))
    return mix(total).view(np.int64)[0]


def prefix_size(n):
    """First hashes of which similar sets must share one: n - ceil(t n) + 1."""
    return n - -(-n * SIMILAR // 100) + 1


def posted_size(n):
    return np.minimum(n, prefix_size(n) + np.ceil(n * SPARE).astype(np.int64) + 1)


def bitmap(shingles: np.ndarray, times: int = 4) -> np.ndarray:
    """Bits of a set: the next power of two over ``times`` its size, 64 at least, as 64-bit words."""
    bits = max(64, 1 << int(times * len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """Upper bound of the overlap; the longer bitmap is folded to the shorter's length."""
    n = min(len(a), len(b))
    a = np.bitwise_or.reduce(a.reshape(-1, n), axis=0) if len(a) > n else a
    b = np.bitwise_or.reduce(b.reshape(-1, n), axis=0) if len(b) > n else b
    return (na + nb - int(np.bitwise_count(a ^ b).sum())) // 2


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(common, na, nb):
    return 100 * common >= SIMILAR * (na + nb - common)


def _binary(*arrays):
    return tuple(a.tobytes() for a in arrays)


def tiles(docs: DataFrame, tile: int = TILE, share: float = SHARE) -> DataFrame:
    """Rows (kind, a, b, na, nb, bits): 0 a document (a its id, b its set, na the size, bits the set's
    bitmap in one row of each set at least), 1 a candidate pair of sets, 2 a posting of a frequent hash
    (a the hash, b the set), 3 a pair with the first set of a frequent hash's tile."""
    buckets = buckets_for(docs)
    held = docs.sparkSession.sparkContext.broadcast(word_octaves(docs, share))

    def packed(ids, sets, sizes, maps, hashes, owners):
        """Rows of gathered documents; copies among them post once and have one bitmap."""
        ids, sets, sizes = np.concatenate(ids), np.array(sets, np.int64), np.array(sizes, np.int32)
        once = np.zeros(len(sets), bool)
        once[np.unique(sets, return_index=True)[1]] = True
        maps = [x if first else None for x, first in zip(maps, once, strict=True)]
        rows = [(int(ids[0]) % buckets, 0, *_binary(ids, sets, sizes), maps)] if len(ids) else []
        if hashes:
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            hashes, owners = hashes[once[owners]], owners[once[owners]]
            bucket = mix(hashes) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            hashes, owners, bucket = hashes[order], owners[order], bucket[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
                rows.append((int(bucket[a]), 1, *_binary(hashes[a:b].view(np.int64), sets[owners[a:b]], sizes[owners[a:b]]), None))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)],
                                          ["bucket", "kind", "x", "y", "z", "maps"])

    def post(batches):
        rarity = held.value
        held_back, size = ([], [], [], [], [], []), 0
        for batch in slices(batches):
            ids, sets, sizes, maps, hashes, owners = held_back
            ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
            data, offsets = text_buffers(batch.column("text"))
            for a, b in passes(offsets):
                for shingles, octaves in shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], rarity):
                    sizes.append(len(shingles))
                    sets.append(set_id(shingles))
                    maps.append(bitmap(shingles).tobytes() if len(shingles) else None)
                    if len(shingles):
                        few = int(posted_size(np.int64(len(shingles))))
                        hashes.append(shingles[np.argsort(octaves, kind="stable")[:few]])
                        owners.append(np.full(few, len(sets) - 1))
                        size += few
            if size >= GATHER:
                yield packed(*held_back)
                held_back, size = ([], [], [], [], [], []), 0
        if held_back[0]:
            yield packed(*held_back)

    def meet(table: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out, posts = [(none.astype(np.int32), none, none, none.astype(np.int32), none.astype(np.int32))], []
        bits = []
        for row in table.to_pylist():
            x, y, z = np.frombuffer(row["x"], np.int64), np.frombuffer(row["y"], np.int64), np.frombuffer(row["z"], np.int32)
            if row["kind"] == 0:
                out.append((np.zeros(len(x), np.int32), x, y, z, z))
                bits += row["maps"]
            else:
                posts.append((x, y, z))
        if posts:
            h, s, n = (np.concatenate(c) for c in zip(*posts, strict=True))
            del posts
            order = np.lexsort((s, n, h))
            h, s, n = h[order], s[order], n[order]
            new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
            h, s, n = h[new], s[new], n[new]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(first, len(h)))
            many = np.repeat(size, size)
            pairs = []
            some = np.flatnonzero((many > 1) & (many <= tile))
            hs, ss, ns = h[some], s[some], n[some]
            for d in range(1, min(tile, len(hs))):
                k = np.flatnonzero((hs[d:] == hs[:-d]) & (100 * ns[:-d].astype(np.int64) >= SIMILAR * ns[d:].astype(np.int64)))
                if not len(k):
                    if not (hs[d:] == hs[:-d]).any():
                        break
                    continue
                pairs.append((ss[k], ss[k + d], ns[k], ns[k + d]))
            out += _pairs(pairs, 1)
            big = np.flatnonzero(many > tile)
            if len(big):
                out.append((np.full(len(big), 2, np.int32), h[big], s[big], n[big], n[big]))
                order = big[np.lexsort((s[big], h[big]))]
                begin = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                lead = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
                near = [(s[lead], s[order], n[lead], n[order])]
                for d in (1, 2):
                    k = np.flatnonzero(h[order][d:] == h[order][:-d])
                    i, j = order[:-d][k], order[d:][k]
                    near.append((s[i], s[j], n[i], n[j]))
                out += _pairs(near, 3)
        kind, a, b, na, nb = (np.concatenate(c) for c in zip(*out, strict=True))
        bits += [None] * (len(kind) - len(bits))  # the documents come first
        return pa.table({"kind": kind, "a": a, "b": b, "na": na, "nb": nb, "bits": pa.array(bits, pa.binary())})

    ready = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text")
    return ready.mapInArrow(tidy(post), "bucket int, kind int, x binary, y binary, z binary, maps array<binary>").groupBy(
        "bucket").applyInArrow(tidy_group(meet), "kind int, a long, b long, na int, nb int, bits binary")


def _pairs(found, kind):
    """Distinct pairs of different sets with sizes in one band, the smaller id first."""
    if not found:
        return []
    a, b, na, nb = (np.concatenate(c) for c in zip(*found, strict=True))
    low, high = np.minimum(na, nb).astype(np.int64), np.maximum(na, nb).astype(np.int64)
    turn = a > b
    a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
    use = (a != b) & (100 * low >= SIMILAR * high)
    a, b, na, nb = a[use], b[use], na[use], nb[use]
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    return [(np.full(int(new.sum()), kind, np.int32), a[new], b[new], na[new], nb[new])]


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, hashes) of the documents of ``wanted`` (doc_id, s), from their whole texts."""

    def build(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in passes(offsets):
                found = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("s").slice(a, b - a), pa.array([x.tobytes() for x in found], pa.binary())], ["s", "hashes"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), "text").join(wanted, "doc_id")
    rows = rows.dropDuplicates(["doc_id"])  # where the join has put them: repeated rows of one document
    return rows.select("s", "text").mapInArrow(tidy(build), "s long, hashes binary")


def bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bitmaps (s, n, bits) let them reach the threshold, with the bound of their similarity."""
    rows = pairs.select("a", "b").join(bits.toDF("a", "na", "ba"), "a").join(bits.toDF("b", "nb", "bb"), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column("ba").to_pylist(), batch.column("bb").to_pylist()
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
            most = np.array([overlap_bound(np.frombuffer(p, np.uint64), i, np.frombuffer(q, np.uint64), j)
                             for p, i, q, j in zip(a, na, b, nb, strict=True)], np.int64)
            keep = similar(most, na, nb)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("a", "b")] + [pa.array((most / (na + nb - most))[keep])],
                ["a", "b", "most"])

    return rows.mapInArrow(tidy(run), "a long, b long, most double")


def linked(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by exact intersection of the arrays (s, hashes)."""
    rows = pairs.select("a", "b").join(arrays.toDF("a", "ha"), "a").join(arrays.toDF("b", "hb"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                keep.append(bool(similar(overlap(x, y), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that do not lie in one component yet."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    rows = pairs.join(a, "a", "left").join(b, "b", "left")
    return rows.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)


def _choices(pairs: DataFrame) -> DataFrame:
    """For every set its pair with the smallest partner and the one with the best bound."""
    sides = pairs.select(F.col("a").alias("s"), F.col("b").alias("o"), "most").union(pairs.select("b", "a", "most"))
    best = sides.groupBy("s").agg(F.min("o").alias("low"), F.max(F.struct("most", "o")).alias("top"))
    both = best.select("s", F.explode(F.array("low", "top.o")).alias("o"))
    return both.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def _smallest(pairs: DataFrame) -> DataFrame:
    """For every set its pair with the smallest partner."""
    sides = pairs.select(F.col("a").alias("s"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    low = sides.groupBy("s").agg(F.min("o").alias("o"))
    return low.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """(s) of all sets in ``pairs``."""
    return pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()


def _links(pairs: DataFrame, bits: DataFrame, docs: DataFrame, reps: DataFrame, also: DataFrame, rounds: int = 1):
    """Written edges that join all components which ``pairs`` can join, and the written arrays (s, hashes), in two
    tables, of the sets compared and of those of ``also`` (s). Each set meets its smallest partner first: most
    families are one component then, and only pairs still apart ship bitmaps."""
    maps = bits.join(_ends(pairs), "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    maps = written(maps, "bitmaps")
    chosen = written(_smallest(pairs), "chosen")
    first = written(bounded(chosen, maps), "first")
    sets = written(sets_of(docs, _ends(first).join(reps, "s")), "sets")
    edges = written(linked(first, sets), "links")
    rest = written(_apart(pairs.join(chosen, ["a", "b"], "left_anti"), components(edges)), "rest")
    left = written(bounded(rest, maps), "bounded")
    forget(chosen, first, rest, maps)
    more = _ends(left).union(also).distinct().join(sets.select("s"), "s", "left_anti")
    more = written(sets_of(docs, more.join(reps, "s")), "sets")
    arrays = sets.union(more)
    for _ in range(rounds):
        chosen = written(_choices(left), "chosen")
        joined = written(edges.union(linked(chosen, arrays)), "links")
        rest = written(_apart(left.join(chosen, ["a", "b"], "left_anti"), components(joined)), "rest")
        forget(left, chosen, edges)
        left, edges = rest, joined
    found = written(edges.union(linked(left, arrays)), "links")
    forget(left, edges)
    return found, (sets, more)


def _across(rows: DataFrame, mixed: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links that join components within one tile, a crowded set in each. ``rows`` are
    postings (h, s, n, crowded, label), ``mixed`` tiles (h, main, all, minor), ``sets`` the arrays.

    The sets outside a tile's main component meet all of its sets in blocks of ``block`` rows.
    """
    used = written(rows.join(mixed, "h"), "mixed_rows")
    blocks = used.withColumn("bi", F.ceil(F.col("minor") / block)).withColumn("bj", F.ceil(F.col("all") / block))
    place = lambda n: F.pmod(F.xxhash64("s"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1).cast("array<long>"))
    left = blocks.where("label != main").withColumn("i", place("bi")).withColumn("j", each("bj")).withColumn("side", F.lit(0))
    right = blocks.withColumn("j", place("bj")).withColumn("i", each("bi")).withColumn("side", F.lit(1))
    columns = ["h", "i", "j", "side", "s", "n", "crowded", "label"]

    def sketch(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("s"), pa.array([bitmap(np.frombuffer(x.as_buffer(), np.uint64), SHARP).tobytes()
                                              for x in batch.column("hashes")], pa.binary())], ["s", "bits"])

    def rows_of(table):
        side, s, n, label = (table.column(c).to_numpy() for c in ("side", "s", "n", "label"))
        return side, s, n, np.array(table.column("crowded").to_pylist(), bool), label

    def hopeful(table: pa.Table) -> pa.Table:
        """The block's rows with a partner whose bitmap lets the pair reach the threshold."""
        side, s, n, crowded, label = rows_of(table)
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        keep = np.zeros(len(s), bool)
        for k, at, _ in _met(side, n, crowded, label, bits):
            keep[k] = True
            keep[at] = True
        return table.select(columns).filter(pa.array(keep))

    def meet(table: pa.Table) -> pa.Table:
        side, s, n, crowded, label = rows_of(table)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        found = [(np.full(len(at), k), at, most) for k, at, most in _met(side, n, crowded, label, [bitmap(x, SHARP) for x in sets])]
        a, b = _joining(found, sets, label)
        return pa.table({"a": np.minimum(s[a], s[b]), "b": np.maximum(s[a], s[b])})

    sketches = sets.join(used.select("s").distinct(), "s", "left_semi").select("s", "hashes")
    sketches = written(sketches.mapInArrow(tidy(sketch), "s long, bits binary"), "sketches")
    placed = left.select(columns).unionByName(right.select(columns))
    some = placed.join(sketches, "s").groupBy("h", "i", "j").applyInArrow(
        tidy_group(hopeful), "h long, i long, j long, side int, s long, n long, crowded boolean, label long")
    some = written(some, "hopeful")
    forget(sketches)
    return some.join(sets, "s").groupBy("h", "i", "j").applyInArrow(tidy_group(meet), "a long, b long").distinct()


def _met(side, n, crowded, label, bits):
    """(row of side 0, rows of side 1 that may link with it, bounds of similarity) of a block."""
    length = np.array([len(x) for x in bits])
    theirs = np.flatnonzero(side == 1)
    by_length = {w: theirs[length[theirs] == w] for w in np.unique(length[theirs])}
    stacked = {w: np.stack([bits[k] for k in at]) for w, at in by_length.items()}
    for k in np.flatnonzero(side == 0):
        for w, at in by_length.items():
            use = (label[at] != label[k]) & (crowded[at] | crowded[k]) & (
                100 * np.minimum(n[at], n[k]) >= SIMILAR * np.maximum(n[at], n[k]))
            if not use.any():
                continue
            own, other, at = bits[k], stacked[w][use], at[use]
            if len(own) > w:
                own = np.bitwise_or.reduce(own.reshape(-1, w), axis=0)
            elif len(own) < w:
                other = np.bitwise_or.reduce(other.reshape(len(other), -1, len(own)), axis=1)
            most = (n[at] + n[k] - np.bitwise_count(other ^ own).sum(1, dtype=np.int64)) // 2
            keep = similar(most, n[at], n[k])
            if keep.any():
                yield k, at[keep], (most / (n[at] + n[k] - most))[keep]


def _joining(found, sets, label):
    """Rows (a, b) of the pairs that link and join two components, best bounds first."""
    out = []
    if found:
        a, b, most = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-most, kind="stable")
        a, b = a[order], b[order]
        root = np.unique(label, return_inverse=True)[1]
        while len(a):
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            for x, y in zip(a[:256], b[:256], strict=True):
                if root[x] != root[y] and similar(overlap(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                    out.append((x, y))
                    root[root == root[y]] = root[x]
            a, b = a[256:], b[256:]
    return (np.array([p[k] for p in out], np.int64) for k in (0, 1))


def join_documents(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    found = written(tiles(docs, tile), "tiles")
    docs_sets = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("s"), F.col("na").alias("n"))
    docs_sets = written(docs_sets, "doc_sets")  # narrow: what the result reads when the tiles are gone
    reps = written(docs_sets.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("doc_id")), "reps")
    pairs = written(found.where("kind IN (1, 3)").select("a", "b").distinct(), "pairs")
    bits = found.where("kind = 0 AND bits IS NOT NULL").select(F.col("b").alias("s"), F.col("na").alias("n"), "bits")

    # crowded sets: too few of their posted hashes are rare
    frequent = found.where("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("s"), F.col("na").cast("long").alias("n"))
    n = F.col("n")
    prefix = n - F.ceil(n * SIMILAR / 100) + 1
    posted = F.least(n, prefix + F.ceil(n * SPARE) + 1)
    crowded = frequent.groupBy("s", "n").agg(F.count("*").alias("f")).where(posted - F.col("f") < prefix)
    crowded = written(crowded.select("s", F.lit(True).alias("crowded")), "crowded")
    some = crowded.limit(1).count() > 0
    also = reps.select("s").limit(0)
    if some:  # all sets that share a frequent hash with a crowded one
        tight = frequent.join(crowded, "s", "left_semi").select("h").distinct()
        also = frequent.join(tight, "h", "left_semi").select("s").distinct()
    edges, arrays = _links(pairs, bits, docs, reps, also)
    if some:
        labels = components(edges).toDF("s", "label")
        rows = frequent.join(crowded, "s", "left").join(labels, "s", "left").select(
            "h", "s", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.coalesce("label", "s").alias("label"))
        rows = written(rows, "frequent")
        parts = rows.groupBy("h", "label").agg(F.count("*").alias("c"), F.max("crowded").alias("crowded"))
        mixed = parts.groupBy("h").agg(
            F.count("*").alias("labels"), F.max("crowded").alias("crowded"), F.sum("c").alias("all"),
            F.max(F.struct("c", "label")).alias("main")).where("labels > 1 AND crowded")
        mixed = written(mixed.select("h", "main.label", "all", (F.col("all") - F.col("main.c")).alias("minor")).toDF(
            "h", "main", "all", "minor"), "mixed")
        edges = written(edges.union(_across(rows, mixed, arrays[0].union(arrays[1]))), "links")
    forget(*arrays)

    by_doc = reps.toDF("s", "d")
    named = edges.join(by_doc.toDF("a", "da"), "a").join(by_doc.toDF("b", "db"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    labels = components(named).toDF("d", "component")
    per_set = written(by_doc.join(labels, "d", "left").select("s", F.coalesce("component", "d").alias("component")), "per_set")
    forget(found, reps, pairs, crowded, edges)
    out = docs_sets.join(per_set, "s", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    null = F.lit(_NULL)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("component_id", null).alias("component_id"))


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS i, w FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.h = q.h AND p.doc_id <> q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {SIMILAR} * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""


@query("op1_ngram_join", OP1_SQL)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
