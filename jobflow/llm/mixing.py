"""Mixing sources to target weights with built-in expressions only.

Every source is cut into blocks: random groups of documents of about ``block_words`` words (the
block of a document follows from a hash of its id). A source is taken in whole passes plus one part
of a pass: its first blocks, and of the next block the documents that still fit, largest first, so
it misses its target by less than any document of that block it leaves out. The block draws of all sources are dealt to output shards by a splitting tree: each node halves its
draws between two children by an exact multivariate hypergeometric draw (balls taken one by one), so
the quotas of the shards add up to the quotas of the sources. The draws of a source are then
permuted and cut by these quotas, so shards get disjoint blocks; rows are shuffled inside a shard.

Nulls: a null text has size 0, a null source is a source of its own (the last one), a null id hashes
as the text ``null``. Documents without words are never taken. Rows that repeat an id and size are
taken or left together. Empty tables give empty results; extra columns pass through ``mix`` unless
they bear the names it adds.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jobflow.llm.common import WORD, forget, written
from jobflow.llm.registry import query

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 23
SEED = 7
#: a prime above any number of block draws of one source: steps of this length permute them
_STEP = 2147483647


def _hash(*parts):
    """Hash of the parts' texts below 2^52, the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str)
                              else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every whole text."""
    return docs.select("doc_id", "source", _size().alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: (source, sid, source_size, target).

    Sources share all words by weight; one that would pass ``cap`` times its size stops there. They
    are filled in the order in which they reach their cap, so the shared level is a running sum. The
    windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    full_at = F.col("cap") / F.col("weight")
    order = Window.orderBy(full_at, "sid")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                         / F.sum("weight").over(after))
    level = F.max(F.when(full_at > F.col("share"), F.col("share"))).over(everything)
    per = per.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (full_at <= F.col("level")), F.col("cap").cast("double")) \
        .otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "sid", "source_size", target.alias("target"))


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """Deal block quotas (sid, quota) to ``2 ** levels`` shards: (shard, sid, part).

    A node is one row with an array of its sources' quotas. Balls go left one by one with the chance
    that an urn gives, source after source, so every split is an exact multivariate hypergeometric
    draw and no block is lost or doubled. A level's work is the number of blocks.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("sid", "quota"))).alias("have")).select(
        F.lit(0).cast("long").alias("shard"), "have")
    for level in range(levels):
        nodes = nodes.selectExpr("shard", "have", "aggregate(have, 0L, (s, x) -> s + x.quota) AS n").selectExpr(
            "shard", "have",
            f"""aggregate(have,
              named_struct('n', n, 'room', n div 2, 'parts', CAST(array() AS array<struct<sid:int,quota:bigint>>)),
              (s, x) -> named_struct(
                'n', s.n - x.quota,
                'room', s.room - aggregate(IF(x.quota > 0, sequence(1L, x.quota), array()), 0L, (t, i) ->
                   t + IF((s.room - t) > (s.n - i + 1) * (pmod(xxhash64({seed}, {level}, shard, x.sid, i), 1048576)
                          + 0.5D) / 1048576, 1L, 0L)),
                'parts', concat(s.parts, array(named_struct('sid', x.sid, 'quota',
                   aggregate(IF(x.quota > 0, sequence(1L, x.quota), array()), 0L, (t, i) ->
                   t + IF((s.room - t) > (s.n - i + 1) * (pmod(xxhash64({seed}, {level}, shard, x.sid, i), 1048576)
                          + 0.5D) / 1048576, 1L, 0L)))))),
              s -> s.parts) AS lefts""")
        nodes = nodes.selectExpr(
            "explode(array(named_struct('shard', shard * 2, 'have', lefts), named_struct('shard', shard * 2 + 1,"
            " 'have', zip_with(have, lefts, (h, l) -> named_struct('sid', h.sid, 'quota', h.quota - l.quota))))) AS x"
        ).select("x.*")
    return nodes.select("shard", F.explode("have").alias("x")).selectExpr("shard", "x.sid AS sid", "x.quota AS part")


def _in_blocks(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, more) with the columns of their source and their block of it."""
    named = targets.withColumnRenamed("source", "_source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows.withColumn("block", _hash("doc_id", seed) % F.col("blocks"))


def plan_draws(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS,
               shard_words: int = SHARD_WORDS, seed: int = SEED):
    """Written tables of the mix of ``sizes`` (doc_id, source, size): rows in their blocks, a row per source, the
    places of every block, and the documents that the last pass takes of the blocks in which it ends."""
    targets = source_targets(sizes, weights, cap).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = written(targets.withColumn("passes", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    rows = written(_in_blocks(sizes, targets, seed), "rows")

    # whole blocks of the last pass, and the block in which it ends
    per_block = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    till = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_block = per_block.withColumn("till", F.sum("words").over(till))
    ends = per_block.join(targets.select("sid", "rest", "passes"), "sid").select(
        "sid", "block", "passes", F.when(F.col("till") <= F.col("rest"), "whole")
        .when(F.col("till") - F.col("words") < F.col("rest"), "part").otherwise("none").alias("last"),
        (F.col("rest") - F.col("till") + F.col("words")).alias("room"))
    ends = written(ends, "blocks")
    part = rows.where("size > 0").join(ends.where("last = 'part'").select("sid", "block", "room"), ["sid", "block"])
    part = part.groupBy("sid", "block", "room", "doc_id", "size").agg((F.count("*") * F.col("size")).alias("all"))
    fits = part.groupBy("sid", "block", "room").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("all")).alias("less"), "doc_id", "size"))).alias("docs")).select("sid", "block", F.expr("""
            explode(aggregate(docs, named_struct('room', room, 'took', filter(docs, d -> false)), (s, d) ->
              IF(-d.less <= s.room, named_struct('room', s.room + d.less, 'took', concat(s.took, array(d))), s),
              s -> s.took)) AS d""")).selectExpr(
        "sid AS _sid", "block AS _block", "d.doc_id AS _doc", "d.size AS _size", "true AS fits")

    # deal the block draws: pass p of block b is draw p * blocks + b of its source
    drawn = targets.select("sid", "blocks", "passes").join(
        ends.where("last != 'none'").groupBy("sid").agg(F.count("*").alias("more"), F.max("block").alias("top")),
        "sid", "left").select("sid", "blocks", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("top") + 1, F.lit(0)))
                              .alias("quota"))
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    levels = 0
    while shard_words << levels < total:
        levels += 1
    shares = split_quotas(drawn.select("sid", "quota"), levels, seed).groupBy("sid").agg(
        F.array_sort(F.collect_list(F.struct("shard", "part"))).alias("parts")).join(drawn, "sid").withColumn(
        "tops", F.expr("""aggregate(parts, CAST(array() AS array<bigint>), (s, p) ->
            concat(s, array(p.part + IF(size(s) = 0, 0L, element_at(s, -1)))))"""))
    shares = written(shares.select("sid", "blocks", "quota", "tops"), "shares")
    places = ends.join(shares, "sid").select(
        "sid", "block", "last", F.expr(f"""transform(
            IF(passes + 1 > 0, sequence(0L, passes), array()), p -> named_struct('pass', p, 'shard',
              CAST(size(filter(tops, t -> t <= pmod((p * blocks + block) * {_STEP}L + {seed}L, quota))) AS bigint)))
            """).alias("places"))
    places, fits = written(places, "places"), written(fits, "fits")
    forget(shares, ends)
    return rows, targets, places, fits


def _drawn(rows: DataFrame, places: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows in their blocks with ``draws``. A block has one row in ``places``, and ``fits`` are documents of one
    block of each source: where the planner broadcasts both, the rows stay where they are."""
    out = rows.join(places, ["sid", "block"]).join(fits, (
        F.col("sid") == F.col("_sid")) & (F.col("block") == F.col("_block"))
        & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size")), "left")
    more = (F.col("last") == "whole") | F.coalesce(F.col("fits"), F.lit(False))
    n = F.when(F.col("size") > 0, F.col("passes") + F.when(more, 1).otherwise(0)).otherwise(0)
    return out.withColumn("draws", F.slice("places", F.lit(1), n.cast("int")))


def draw(sizes: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """Per row of ``sizes`` (doc_id, source, size): source_size, target and ``draws``, the places
    (pass, shard) at which the mix holds it."""
    rows, _, places, fits = plan_draws(sizes, seed=seed, **options)
    return _drawn(rows, places, fits).select("doc_id", "source", "size", "source_size", "target", "draws")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated as drawn, with the columns ``mix_pass`` and
    ``mix_shard``, one partition per shard in shuffled order. Texts are shuffled once, to their shards."""
    sized, targets, places, fits = plan_draws(sizes_of(docs), seed=seed, **options)
    forget(sized)
    docs = docs.drop("mix_pass", "mix_shard")
    rows = docs.withColumn("_row", F.struct(*docs.columns))  # columns may be named like ours
    rows = rows.select("_row", "doc_id", "source", _size().alias("size"))
    rows = _drawn(_in_blocks(rows, targets, seed), places, fits).select("_row", F.explode("draws").alias("_d"))
    rows = rows.select("_row.*", F.col("_d.pass").alias("mix_pass"), F.col("_d.shard").alias("mix_shard"))
    return rows.repartition("mix_shard").sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed), "doc_id", "mix_pass"))


OP2_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM per),
weighed AS (SELECT *, [5, 2, 1][CAST(sid % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM ranked),
shared AS (SELECT *, CAST(cap AS DOUBLE) / weight AS full_at,
  CAST((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, sid
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, sid
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM weighed),
leveled AS (SELECT *, (SELECT max(share) FROM shared WHERE full_at > share) AS level FROM shared),
targets AS (SELECT source, sid, source_size, CASE WHEN level IS NULL OR full_at <= level THEN CAST(cap AS DOUBLE)
  ELSE level * weight END AS target, greatest(1, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT)) AS blocks FROM leveled),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes
  FROM targets),
rows_ AS (SELECT d.doc_id, d.size, p.*, p.target - p.passes * p.source_size AS rest,
  CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 13) AS BIGINT) % p.blocks AS block
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source),
per_block AS (SELECT sid, block, any_value(rest) AS rest, CAST(sum(size) AS BIGINT) AS words FROM rows_ GROUP BY sid, block),
ends AS (SELECT *, sum(words) OVER (PARTITION BY sid ORDER BY block) AS till FROM per_block),
part AS (SELECT r.sid, r.doc_id, r.size, e.rest - e.till + e.words AS room,
  row_number() OVER (PARTITION BY r.sid ORDER BY r.size DESC, r.doc_id) AS rn
  FROM rows_ r JOIN ends e ON r.sid = e.sid AND r.block = e.block
  WHERE r.size > 0 AND e.till > e.rest AND e.till - e.words < e.rest),
greedy AS (
  SELECT sid, doc_id, rn, size <= room AS took, CASE WHEN size <= room THEN room - size ELSE room END AS room
  FROM part WHERE rn = 1
  UNION ALL
  SELECT p.sid, p.doc_id, p.rn, p.size <= g.room, CASE WHEN p.size <= g.room THEN g.room - p.size ELSE g.room END
  FROM greedy g JOIN part p ON p.sid = g.sid AND p.rn = g.rn + 1)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * (r.passes
   + CASE WHEN e.till <= e.rest THEN 1 WHEN g.took THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows_ r JOIN ends e ON r.sid = e.sid AND r.block = e.block
LEFT JOIN greedy g ON g.sid = r.sid AND g.doc_id = r.doc_id
"""


@query("op2_mix_sources", OP2_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return draw(sizes_of(docs)).select(
        "doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"))
