"""Connected components of links between rows, as joins and map-side combined aggregates.

Links are kept as pairs (hi, lo) with hi > lo. A round has two steps, after the published
large-star and small-star method:

* large star: every link (hi, lo) is moved to the smallest node that ``lo`` is known to reach;
* small star: all smaller neighbours of a node are tied to the smallest of them.

Both keep the components and only ever lower the nodes that links point to. When no node has two
smaller neighbours and none is smaller than one node and larger than another, every component is
a star around its smallest node. Paths shorten by a factor each round, so the number of rounds
grows with the logarithm of the longest path and not with its length.

No neighbourhood is collected: a node with very many links is a hot key of joins whose other side
has one row per key, which adaptive execution splits.
"""

import logging

from pyspark.sql import DataFrame, functions as F

from jobflow.session import cut_lineage, discard

log = logging.getLogger(__name__)


def _lowest(links: DataFrame, written: list) -> DataFrame:
    """Per node with smaller neighbours: the smallest of them. Written, so joins on it have an exchange."""
    return cut_lineage(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("lowest")), written)


def _large_star(links: DataFrame, written: list) -> DataFrame:
    lowest = _lowest(links, written)
    return links.join(lowest, F.col("lo") == F.col("node"), "left").select(
        "hi", F.coalesce("lowest", "lo").alias("lo")
    ).distinct()


def _small_star(links: DataFrame, written: list) -> DataFrame:
    lowest = _lowest(links, written)
    moved = links.join(lowest, F.col("hi") == F.col("node")).where(F.col("lo") != F.col("lowest")).select(
        F.col("lo").alias("hi"), F.col("lowest").alias("lo")
    )
    return moved.unionByName(lowest.select(F.col("node").alias("hi"), F.col("lowest").alias("lo"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))
    )
    return not loose.limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", written: list | None = None) -> DataFrame:
    """(node, component) of every node that has a link to another; component is the smallest node reachable.

    Repeated links, links both ways and links of a node to itself change nothing; links with a null
    end are ignored. No links give no rows. The result is a written table, its path is added to
    ``written``.
    """
    spark = edges.sparkSession
    kept: list = []
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    links = cut_lineage(links, kept)
    rounds = 0
    while not _are_stars(links):
        aside: list = []
        following: list = []
        links = cut_lineage(_large_star(links, aside), aside)
        links = cut_lineage(_small_star(links, aside), following)
        discard(spark, kept + aside)
        kept = following
        rounds += 1
        log.info("components, round %d", rounds)
    labels = links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
    labels = cut_lineage(labels, written)
    discard(spark, kept)
    return labels
