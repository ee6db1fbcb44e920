"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is turned by random rotations into ``bits`` coordinates; its code is one sign bit per
coordinate and correction scalars (its length, and how well the signs stand for it). Queries are
turned alike and cut into bit planes, so that a query's inner product with a code is a count of common
bits on packed words. The correction makes of it an unbiased estimate, with an interval that holds with
a chosen probability. A code's first level is a short code of its own: all pairs are bounded by it, and
the pairs it leaves by the whole code. Codes are written once; whole vectors are read only where the
intervals ask.

1. *Leads.* Blocks of queries meet blocks of codes; each query's ``k`` largest lower bounds over all
   blocks name ``k`` rows. Their exact products (double precision) are reached by ``k`` rows, so the
   smallest of them is a floor that every answer must reach.
2. *Choice.* The blocks meet again; a row whose upper bound reaches a query's floor is asked for. A row
   goes once to a block of queries, with the list of queries that ask, however many they are.
3. *Rerank.* Asked pairs are scored with the original vectors in double precision; each query keeps its
   best ``k`` of a block, then of all. So bounds choose what is reranked, and scores are exact.

The query set (rows whose id divides by ``stride``) meets all rows in blocks. Bytes per task are fixed
by the block sizes; a group of rows that are near one another is dealt over all blocks.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do null ids.
Rows that repeat an id are candidates each (for other ids; a query skips all rows of its own id).
Ties go to the smaller id. Empty tables give empty results; other columns are not read. Vectors
of different lengths are not compared.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jobflow.llm.common import forget, written
from jobflow.llm.registry import query

K, STRIDE = 20, 20
#: rows per block of vectors and of queries; error bounds in standard deviations
BLOCK_ROWS, QUERY_ROWS, SIGMAS = 1 << 14, 1 << 10, 4.0
#: sign bits of a code and of its first level, at least (a level has a bit per component); bit planes of a
#: query for whole codes and for first levels
BITS, LEVEL, PLANES, FIRST_PLANES = 1024, 256, 6, 4
#: (query, row) estimates of one numpy pass
PASS_PAIRS = 1 << 18
SEED = 9


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a vector that has a direction."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


@lru_cache(8)
def rotation(dim: int, seed: int = SEED, bits: int = BITS) -> np.ndarray:
    """``dim`` orthonormal rows over ``bits`` coordinates or more: levels of :func:`level_bits` side by
    side, each a random rotation of its own, so that the first level alone is a code as well."""
    wide = level_bits(dim)
    rng, levels = np.random.default_rng(seed), []
    for _ in range(-(-bits // wide)):
        q, r = np.linalg.qr(rng.standard_normal((wide, dim)))
        levels.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(levels, axis=1) / np.sqrt(len(levels))


def level_bits(dim: int) -> int:
    """Bits of one level: whole 64-bit words, a bit per component at least."""
    return -(-max(dim, LEVEL) // 64) * 64


def first_level(turn: np.ndarray) -> np.ndarray:
    wide = level_bits(len(turn))
    return turn[:, :wide] * np.sqrt(turn.shape[1] / wide)


def encode(x: np.ndarray, turn: np.ndarray):
    """Packed sign bits, lengths, and <signs / sqrt(bits), unit turned vector> of every row."""
    length = np.sqrt((x * x).sum(1))
    unit = (x / length[:, None]) @ turn
    fit = np.abs(unit).sum(1) / np.sqrt(turn.shape[1])
    return np.packbits(unit > 0, axis=1), length, fit


class Asked:
    """Queries, turned and cut into bit planes: a turned query is about least + step * level, and plane p
    holds bit p of the levels; ``rest`` is the length of what the levels miss."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        self.wide, self.length = turn.shape[1], np.sqrt((queries * queries).sum(1))
        unit = (queries / self.length[:, None]) @ turn
        self.least = unit.min(1)
        self.step = np.maximum(unit.max(1) - self.least, 1e-30) / ((1 << planes) - 1)
        level = np.rint((unit - self.least[:, None]) / self.step[:, None]).astype(np.uint8)
        self.rest = np.sqrt(((unit - self.least[:, None] - self.step[:, None] * level) ** 2).sum(1))
        self.levels = level.sum(1, dtype=np.int64)
        self.planes = [np.packbits((level >> p) & 1, axis=1).view(np.uint64) for p in range(planes)]

    def all_bounds(self, bits, length, fit, sigmas):
        """(middles, half widths) of all queries with all coded rows."""
        words = np.ascontiguousarray(np.ascontiguousarray(bits).view(np.uint64).T)
        shape = (len(self.length), len(fit))
        weighted, common, both = np.zeros(shape, np.int32), np.empty(shape, np.uint16), np.empty(shape, np.uint64)
        for p, plane in enumerate(self.planes):
            common[:] = 0
            for w, word in enumerate(words):
                np.bitwise_and(word[None, :], plane[:, w][:, None], out=both)
                common += np.bitwise_count(both)
            weighted += common.astype(np.int32) << p
        ones = np.bitwise_count(words).sum(0, dtype=np.int64)
        return self._interval(weighted, ones[None, :], length[None, :], fit[None, :], np.arange(shape[0])[:, None], sigmas)

    def pair_bounds(self, q, r, bits, length, fit, sigmas):
        """(middles, half widths) of the pairs of query ``q[i]`` with row ``r[i]``."""
        words = np.ascontiguousarray(bits).view(np.uint64)
        middle, half = np.empty(len(q)), np.empty(len(q))
        for s in range(0, len(q), PASS_PAIRS):
            i, j = q[s:s + PASS_PAIRS], r[s:s + PASS_PAIRS]
            has = words[j]
            weighted = sum(np.bitwise_count(has & plane[i]).sum(1, dtype=np.int64) << p for p, plane in enumerate(self.planes))
            ones = np.bitwise_count(has).sum(1, dtype=np.int64)
            middle[s:s + PASS_PAIRS], half[s:s + PASS_PAIRS] = self._interval(weighted, ones, length[j], fit[j], i, sigmas)
        return middle, half

    def _interval(self, weighted, ones, length, fit, q, sigmas):
        # signs are 2 bit - 1, so a product with them is twice the sum over set bits less the sum over all
        product = self.least[q] * (2 * ones - self.wide) + self.step[q] * (2 * weighted - self.levels[q])
        near = product / (fit * np.sqrt(self.wide))
        a = sigmas ** 2 * (1 - fit * fit) / (fit * fit * (self.wide - 1))
        b = sigmas ** 2 * self.rest[q] ** 2 / (fit * fit * self.wide)
        half = np.sqrt(np.maximum(0, (a + b) * (1 + a) - a * near * near)) / (1 + a)
        scale = self.length[q] * length
        return near / (1 + a) * scale, (half + 1e-9) * scale


def bounds(queries: np.ndarray, codes, turn: np.ndarray, sigmas: float = SIGMAS):
    """(middles, half widths) of the intervals of inner products of queries with coded rows.

    A unit vector lies at angle arccos(fit) from its code; what the code misses is orthogonal to it and,
    after a random rotation, spreads like one coordinate of a random direction: an estimate of the cosine
    c has the variance a (1 - c^2) + b, b for the remainder of the query's planes. The interval holds
    every c for which the estimate is within ``sigmas`` deviations (a quadratic inequality in c).
    """
    return Asked(queries, turn).all_bounds(*codes, sigmas)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _met(ask, has, pick, sigmas, seed, bits):
    """(query, row, middle, half) as arrays over the pairs of one block that ``pick`` leaves after the
    first level, bounded by the whole codes; in passes of bounded size."""
    if not len(ask) or not len(has):
        return
    queries = _matrix(ask["v"])
    turn = rotation(queries.shape[1], seed, bits)
    first, length = first_level(turn), has["length"].to_numpy()
    code = np.frombuffer(b"".join(has["code"]), np.uint8).reshape(len(has), turn.shape[1] // 8)
    whole, brief = (code, length, has["fit"].to_numpy()), (
        np.ascontiguousarray(code[:, :first.shape[1] // 8]), length, has["first_fit"].to_numpy())
    ids, own = has["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
    step = max(1, PASS_PAIRS // len(has))
    for s in range(0, len(queries), step):
        middle, half = Asked(queries[s:s + step], first, FIRST_PLANES).all_bounds(*brief, sigmas)
        q, r = np.nonzero(pick(slice(s, s + step), middle, half) & (own[s:s + step, None] != ids[None, :]))
        yield q + s, r, *Asked(queries[s:s + step], turn).pair_bounds(q, r, *whole, sigmas)


def leads(ask: pd.DataFrame, has: pd.DataFrame, k: int, sigmas: float, seed: int, bits: int) -> pd.DataFrame:
    """(query_row, row, low): each query's k largest lower bounds among the first level's 4 k best of one block."""

    def best(_, middle, half):
        most = min(4 * k + 1, len(has))
        return middle >= -np.partition(-middle, most - 1, axis=1)[:, most - 1:most]

    out = []
    for q, r, middle, half in _met(ask, has, best, sigmas, seed, bits):
        low = middle - half
        order = np.lexsort((-low, q))
        q, r, low = q[order], r[order], low[order]
        top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        out.append(pd.DataFrame({"query_row": ask["row"].to_numpy()[q[top]], "row": has["row"].to_numpy()[r[top]], "low": low[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "row": [], "low": []})


def chosen(ask: pd.DataFrame, has: pd.DataFrame, sigmas: float, seed: int, bits: int) -> pd.DataFrame:
    """(row, asked): the rows of one block that may reach a query's floor, with those queries' rows."""
    floor = ask["floor"].to_numpy()
    rows, asks = [], []
    for q, r, middle, half in _met(ask, has, lambda part, m, h: m + h >= floor[part, None], sigmas, seed, bits):
        reach = middle + half >= floor[q]
        rows.append(r[reach])
        asks.append(ask["row"].to_numpy()[q[reach]])
    if not sum(map(len, rows)):
        return pd.DataFrame({"row": [], "asked": pd.Series([], dtype=object)})
    r, q = np.concatenate(rows), np.concatenate(asks)
    order = np.argsort(r, kind="stable")
    r, q = r[order], q[order]
    cuts = np.flatnonzero(np.diff(r)) + 1
    return pd.DataFrame({"row": has["row"].to_numpy()[r[np.concatenate([[0], cuts])]],
                         "asked": pd.Series(np.split(q, cuts), dtype=object)})


def rerank(ask: pd.DataFrame, has: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, query_row, vec_id, score): each query's k best of the rows asked for in one block."""
    out = []
    if len(ask) and len(has):
        lens = has["asked"].map(len).to_numpy()
        pair_row, pair_query = np.repeat(np.arange(len(has)), lens), np.concatenate(has["asked"].to_list())
        order = np.argsort(pair_query, kind="stable")
        pair_row, pair_query = pair_row[order], pair_query[order]
        x, ids, q = _matrix(has["v"]), has["vec_id"].to_numpy(), _matrix(ask["v"])
        rows = ask["row"].to_numpy()
        first, last = np.searchsorted(pair_query, rows, "left"), np.searchsorted(pair_query, rows, "right")
        for i in range(len(ask)):
            at = pair_row[first[i]:last[i]]
            exact = (x[at] * q[i]).sum(1)
            top = np.lexsort((ids[at], -exact))[:k]
            out.append(pd.DataFrame({"query_id": ask["vec_id"].iloc[i], "query_row": rows[i], "vec_id": ids[at][top], "score": exact[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})


def coded(table: DataFrame, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """Written table (row, vec_id, dim, v, code, length, fit, first_fit) of all vectors that take part."""
    rows = usable(table).where("vec_id IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("dim"), F.col("embedding").alias("v"))

    def add_codes(parts):
        for part in parts:
            for dim, same in part.groupby("dim"):
                x, turn = _matrix(same["v"]), rotation(int(dim), seed, bits)
                code, length, fit = encode(x, turn)
                first_fit = encode(x, first_level(turn))[2]
                yield same.assign(code=[c.tobytes() for c in code], length=length, fit=fit, first_fit=first_fit)

    kind = rows.schema["v"].dataType.simpleString()
    return written(rows.mapInPandas(
        add_codes, f"row long, vec_id long, dim int, v {kind}, code binary, length double, fit double, first_fit double"), "codes")


def _cogroup(asks: DataFrame, has: DataFrame, fn, schema: str) -> DataFrame:
    keys = ["dim", "qblock", "block"]
    schema = "dim int, qblock long, block long, " + schema

    def with_keys(key, ask, row):
        return fn(ask, row).assign(dim=key[0], qblock=key[1], block=key[2])

    return asks.groupBy(*keys).cogroup(has.groupBy(*keys)).applyInPandas(with_keys, schema)


def candidates(codes: DataFrame, stride: int = STRIDE, k: int = K, block_rows: int = BLOCK_ROWS,
               query_rows: int = QUERY_ROWS, sigmas: float = SIGMAS, seed: int = SEED, bits: int = BITS):
    """(questions, asked): every query in every block, and the written rows that the bounds choose."""
    n = codes.count()
    blocks, qblocks = -(-max(n, 1) // block_rows), -(-max(n, 1) // (stride * query_rows))

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))

    # columns of their own: both sides of a cogroup come from one table
    queries = codes.where(F.col("vec_id") % stride == 0).select([F.col(c).alias(c) for c in ("dim", "row", "vec_id", "v")]).withColumn(
        "qblock", F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(qblocks)))
    asks = queries.withColumn("block", every(blocks))
    has = codes.select("dim", "row", "vec_id", "code", "length", "fit", "first_fit").withColumn(
        "block", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks))).withColumn("qblock", every(qblocks))
    led = _cogroup(asks, has, lambda a, h: leads(a, h, k, sigmas, seed, bits), "query_row long, row long, low double")
    first = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("low"), "row"))
    led = led.withColumn("nth", first).where(F.col("nth") <= k).select("query_row", "row")
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    led = led.join(codes.select("row", "v"), "row").join(
        queries.select(F.col("row").alias("query_row"), F.col("v").alias("q")), "query_row")
    # a sum in another order differs in its last digits
    size = F.sqrt(F.aggregate(F.transform("q", lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    floors = led.groupBy("query_row").agg(
        F.min(product - F.abs(product) * 1e-9 - size * 1e-12).alias("least"), F.count("*").alias("led"))
    floors = written(floors.select(F.col("query_row").alias("row"), F.when(F.col("led") >= k, F.col("least")).alias("floor")), "floors")
    asking = asks.join(floors, "row", "left").fillna({"floor": float("-inf")})
    asked = written(_cogroup(asking, has, lambda a, h: chosen(a, h, sigmas, seed, bits), "row long, asked array<long>"), "asked")
    forget(floors)
    return asks, asked


def search(table: DataFrame, stride: int = STRIDE, k: int = K, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS, sigmas: float = SIGMAS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries ``vec_id % stride = 0`` against all rows."""
    codes = coded(table, seed, bits)
    asks, asked = candidates(codes, stride, k, block_rows, query_rows, sigmas, seed, bits)
    met = _cogroup(asks, asked.join(codes.select("row", "vec_id", "v"), "row"), lambda a, h: rerank(a, h, k),
                   "query_id long, query_row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_nearest", OP9_SQL)
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every query vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
