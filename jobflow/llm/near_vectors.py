"""Near-duplicate vectors: small-world graphs per shard, audited beams, exact cosines, components.

Only vectors of one label meet. Equal vectors are first folded into a class with a count, so a very
common vector is one node. The classes of a label are dealt to shards of about ``shard_rows``; each
shard gets a hierarchical navigable small-world graph, built and searched in numpy with many
queries in step. Every class queries every shard of its label: a task holds one graph and one
group of queries, both of bounded size. A beam whose worst entry still reaches the threshold is
widened for that query; a bounded sample of the queries is compared with all rows of the shard, and
while the share of links found stays under ``recall`` the beam is doubled. Cosines are then computed
in double precision and only pairs at or over the threshold link.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or
id, link with nothing (n_links 0, component their own id, kept). Rows that repeat an id count as
vectors of their own. Vectors of different length never link. Empty tables give empty results;
other columns are not read.
"""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobflow.llm.ann import usable
from jobflow.llm.common import components, written
from jobflow.llm.registry import query

THRESHOLD = 0.98
SHARD_ROWS, QUERY_ROWS = 4096, 4096
#: links per node, width of the building and of the first search beam, share of links an audit needs
LINKS, BUILD_BEAM, BEAM, RECALL, AUDIT = 12, 48, 48, 0.999, 128
STEP, WIDTH, SEED = 256, 4, 3


def beam_search(x, links, queries, entry, beam):
    """Best ``beam`` nodes per query on one layer: (ids, similarities), -1 where fewer.

    All queries advance together; each round expands the ``WIDTH`` best unexpanded nodes of each.
    """
    n_q, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n_q, len(x) + 1), bool)
    ids = np.full((n_q, beam), -1, np.int64)
    sims = np.full((n_q, beam), -np.inf, np.float32)
    done = np.ones((n_q, beam), bool)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    sims[:, :width] = np.where(entry[:, :width] >= 0, np.einsum("qd,qed->qe", queries, x[entry[:, :width]]), -np.inf)
    done[:, :width] = entry[:, :width] < 0
    seen[rows, ids] = True
    while True:
        open_sims = np.where(done, -np.inf, sims)
        w = min(max(WIDTH, beam // 12), beam)
        at = np.argpartition(-open_sims, w - 1, axis=1)[:, :w]
        live = np.take_along_axis(open_sims, at, 1) > -np.inf
        if not live.any():
            return ids, sims
        np.put_along_axis(done, at, True, 1)
        near = links[np.take_along_axis(ids, at, 1)]
        near = np.where(live[:, :, None], near, -1).reshape(n_q, -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[rows, near]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        node = near[r, c]
        seen[r, node] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("pd,pd->p", queries[r], x[node])
        all_sims, all_ids = np.concatenate([sims, got], 1), np.concatenate([ids, np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done, ~fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))


def spread(x, centre, ids, sims, most):
    """Of each row's candidates the ``most`` that lie nearer to the centre than to one another's
    chosen ones; free places go to the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ok = (ids >= 0) & (ids != centre[:, None])
    between = np.einsum("qad,qbd->qab", x[ids], x[ids])
    chosen = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        blocked = (chosen[:, :k] & (between[:, k, :k] > sims[:, k, None])).any(1) if k else False
        chosen[:, k] = ok[:, k] & ~blocked & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    pick = np.argsort(rank, axis=1)[:, :most]
    return np.where(np.take_along_axis(ok, pick, 1), np.take_along_axis(ids, pick, 1), -1)


def build_graph(x: np.ndarray, m: int = LINKS, beam: int = BUILD_BEAM, seed: int = SEED) -> dict:
    """Layers of links over unit rows ``x`` (the lowest has all rows) and the entry row."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n)) / np.log(m)).astype(int), 6)
    order = np.argsort(-level, kind="stable")  # upper layers are complete before lower ones grow
    top = int(level[order[0]])
    layers = [np.full((n + 1, m * (2 if k == 0 else 1)), -1, np.int64) for k in range(top + 1)]
    entry, at = int(order[0]), 1
    while at < n:
        batch = order[at:at + max(1, min(STEP, at // 2))]
        at += len(batch)
        start = np.full((len(batch), 1), entry)
        for k in range(top, -1, -1):
            on = level[batch] >= k
            wide = beam if on.any() else 1
            found, sims = beam_search(x, layers[k], x[batch], start, wide)
            start = found
            if not on.any():
                continue
            new = batch[on]
            most = layers[k].shape[1]
            ids, near = found[on], sims[on]
            mates = np.broadcast_to(new, (len(new), len(new)))  # rows of one batch may be neighbours too
            if len(new) > 1:
                mate_sims = x[new] @ x[new].T
                np.fill_diagonal(mate_sims, -np.inf)
                few = min(m, len(new) - 1)
                pick = np.argpartition(-mate_sims, few - 1, axis=1)[:, :few]
                ids = np.concatenate([ids, np.take_along_axis(mates, pick, 1)], 1)
                near = np.concatenate([near, np.take_along_axis(mate_sims, pick, 1)], 1)
            links = spread(x, new, ids, near, m)
            layers[k][new, :m] = links
            back_from, slot = np.nonzero(links >= 0)
            _link_back(x, layers[k], links[back_from, slot], new[back_from], most)
    return {"x": x, "layers": layers, "entry": entry}


def _link_back(x, layer, to, source, most):
    """Add ``source`` to the links of ``to``; full lists are thinned again."""
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), STEP):
        node, start, count = nodes[lo:lo + STEP], first[lo:lo + STEP], counts[lo:lo + STEP]
        widest = int(count.max())
        slot = np.arange(widest)[None, :]
        extra = np.where(slot < count[:, None], source[np.minimum(start[:, None] + slot, len(source) - 1)], -1)
        have = layer[node]
        ids = np.concatenate([have, extra], 1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, np.einsum("qd,qed->qe", x[node], x[ids]), -np.inf)
        if ids.shape[1] > 4 * most:  # only the nearest are compared with one another
            keep = np.argpartition(-sims, 4 * most - 1, axis=1)[:, :4 * most]
            ids, sims = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)
        layer[node] = spread(x, node, ids, sims, most)


def range_search(graph, queries, threshold, beam):
    """(query rows, graph rows) with similarity of about ``threshold`` or more."""
    x, near = graph["x"], threshold - 1e-4  # float32 slack; exact cosines follow
    out = []
    for lo in range(0, len(queries), STEP):
        todo = np.arange(lo, min(lo + STEP, len(queries)))
        wide = beam
        while len(todo):
            start = np.full((len(todo), 1), graph["entry"])
            for layer in reversed(graph["layers"][1:]):
                start, _ = beam_search(x, layer, queries[todo], start, 4)
            ids, sims = beam_search(x, graph["layers"][0], queries[todo], start, min(wide, len(x)))
            full = (sims.min(axis=1) >= near) & (wide < len(x))
            r, c = np.nonzero((sims >= near) & ~full[:, None])
            out.append((todo[r], ids[r, c]))
            todo, wide = todo[full], wide * 2
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


def audited_search(graph, queries, threshold=THRESHOLD, beam=BEAM, recall=RECALL, audit=AUDIT):
    """:func:`range_search` with the beam doubled until the audited queries find their links."""
    x = graph["x"]
    sample = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    truth = queries[sample] @ x.T >= threshold
    while beam < len(x):
        r, c = range_search(graph, queries[sample], threshold, beam)
        hit = np.zeros(truth.shape, bool)
        hit[r, c] = True
        if (hit & truth).sum() >= recall * truth.sum():
            break
        beam *= 2
    return range_search(graph, queries, threshold, beam)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS,
                 query_rows: int = QUERY_ROWS) -> DataFrame:
    """(id, root, others) per linked class and task: over the rows (id, label, dim, v, copies) of one
    label, ``others`` is the number of vectors that the class was found linked to and ``root`` the
    smallest class joined to it by the links that this task found. So a group of many near copies
    leaves a row per member, not a row per pair."""
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    groups = written(groups.select("label", "dim", F.ceil(F.col("n") / shard_rows).alias("shards"),
                                   F.ceil(F.col("n") / query_rows).alias("asks")), "groups")
    placed = written(classes.join(groups, ["label", "dim"]).select(
        "label", "dim", "id", "v", "copies", "shards", "asks", F.pmod(F.xxhash64("id"), "shards").alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(1)), "asks").alias("ask")), "placed")

    def unit(part):
        v = np.stack(part["v"].to_numpy()).astype(np.float64)
        return v, (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        v, x = unit(part)
        graph = build_graph(x) | {"v": v, "id": part["id"].to_numpy(), "copies": part["copies"].to_numpy()}
        return pd.DataFrame({"label": part["label"].iloc[:1], "dim": part["dim"].iloc[:1], "shard": part["shard"].iloc[:1],
                             "asks": part["asks"].iloc[:1], "graph": [pickle.dumps(graph)]})

    graphs = written(placed.groupBy("label", "dim", "shard").applyInPandas(
        build, "label int, dim int, shard long, asks long, graph binary"), "graphs")

    def ask(graph: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(part):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "others": np.zeros(0, np.int64)})
        g = pickle.loads(graph["graph"].iloc[0])
        v, x = unit(part)
        r, c = audited_search(g, x, threshold)
        ids, other = part["id"].to_numpy()[r], g["id"][c]
        p, q = v[r], g["v"][c]
        cosine = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
        keep = (cosine >= threshold) & (ids != other)
        ids, other, copies = ids[keep], other[keep], g["copies"][c[keep]]
        nodes, at = np.unique(np.concatenate([ids, other]), return_inverse=True)
        root = _roots(len(nodes), at[:len(ids)], at[len(ids):])
        others = np.bincount(at[:len(ids)], copies, minlength=len(nodes)).astype(np.int64)
        return pd.DataFrame({"id": nodes, "root": nodes[root], "others": others})

    keys = ["label", "dim", "shard", "ask"]
    left = graphs.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).select(*keys, "graph")
    right = placed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*keys, "id", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(ask, "id long, root long, others long")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``table``."""
    table = table.select("vec_id", "label", F.col("embedding").alias("v"))
    good = usable(table, "v").where("label IS NOT NULL AND vec_id IS NOT NULL")
    key = F.xxhash64("v")
    classes = written(good.groupBy("label", key.alias("key"), "v").agg(
        F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies")), "classes")
    found = written(link_classes(
        classes.select("id", F.col("label").cast("int").alias("label"), F.size("v").alias("dim"), "v", "copies"),
        threshold, **options), "found")
    counts = found.groupBy("id").agg(F.sum("others").alias("others"))
    links = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    per_class = classes.join(counts, "id", "left").join(
        components(links).withColumnRenamed("node", "id"), "id", "left").select(
        "label", "key", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    per_class = written(per_class, "per_class")
    rows = usable(table, "v").where("label IS NOT NULL AND vec_id IS NOT NULL").withColumn("key", key)
    linked = rows.join(per_class, ["label", "key", "v"]).select("vec_id", "n_links", "component_id")
    v = F.col("v")
    bad = v.isNull() | F.col("label").isNull() | F.col("vec_id").isNull() | F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: F.coalesce(x, F.lit(0)) != 0)
    alone = table.where(F.coalesce(bad, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("vec_id").cast("long").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
  AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
  AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query("op3_near_vectors", OP3_SQL)
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
