"""Approximate nearest neighbours by a robust-pruned directed graph.

Distinct vectors are dealt into shards by hash. Each shard's graph is built in batches: greedy searches from
the central vector propose neighbours, relaxed pruning keeps those that no kept neighbour is much closer to
(edges in diverse directions), and reverse edges are added and pruned alike. The index is written once,
one row a shard. A query runs a beam search over every shard's graph; the best of all shards are its result.

Nearness is the largest inner product. One more coordinate, sqrt(M**2 - |x|**2) with M the largest length,
turns that into Euclidean nearness for building; searching needs the product alone. Candidates of the beam
are scored in double precision on the vectors as given.

Equal vectors are one node, known by its smallest ``k + 1`` ids: ties go to smaller ids, so no other copy can be
in a result. Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do null ids;
of repeated ids with different vectors each is a candidate. Vectors meet only those of their own length.
Fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

DEGREE = 32
BEAM = 64
RELAXED = 1.2
BATCH = 256
EXPAND = 4


def _beam(
    graph: np.ndarray, x: np.ndarray, queries: np.ndarray, start: int, width: int, product: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for many queries at once: the ``width`` nearest nodes met (-1: none) and their distances, in order.

    Distance is minus the product, or squared Euclidean. Each step opens the ``EXPAND`` nearest unopened nodes.
    """
    b, n = len(queries), len(x)
    length = np.einsum("ij,ij->i", x, x)

    def far(q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", queries[q], x[ids])
        return -dots if product else length[ids] - 2 * dots

    ids = np.full((b, width), -1, np.int32)
    dist = np.full((b, width), np.inf, np.float32)
    ids[:, 0], dist[:, 0] = start, far(np.arange(b), np.full(b, start))
    opened = np.ones((b, width), bool)
    opened[:, 0] = False
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        closed = opened[live]
        pick = np.argsort(closed, axis=1, kind="stable")[:, :EXPAND]  # unopened ones first, nearest first
        fresh = ~np.take_along_axis(closed, pick, 1)
        nodes = np.where(fresh, np.take_along_axis(ids[live], pick, 1), -1)
        np.put_along_axis(closed, pick, True, 1)
        opened[live] = closed
        new_ids = np.full((len(live), EXPAND * graph.shape[1]), -1, np.int32)
        for e in range(EXPAND):
            around = np.where(nodes[:, e : e + 1] >= 0, graph[nodes[:, e]], -1)
            unseen = (around >= 0) & ~seen[live[:, None], around]
            q, k = np.nonzero(unseen)
            seen[live[q], around[q, k]] = True
            new_ids[:, e * graph.shape[1] : (e + 1) * graph.shape[1]] = np.where(unseen, around, -1)
        q, k = np.nonzero(new_ids >= 0)
        new_dist = np.full(new_ids.shape, np.inf, np.float32)
        new_dist[q, k] = far(live[q], new_ids[q, k])
        all_dist = np.concatenate([dist[live], new_dist], 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        all_ids = np.concatenate([ids[live], new_ids], 1)
        all_open = np.concatenate([closed, new_ids < 0], 1)
        ids[live] = np.take_along_axis(all_ids, best, 1)
        dist[live] = np.take_along_axis(all_dist, best, 1)
        opened[live] = np.take_along_axis(all_open, best, 1)
        live = live[~opened[live].all(axis=1)]
    return ids, dist


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Robust pruning: of each point's candidates (-1: none) keep the nearest, drop what lies ``relaxed`` times closer to it
    than to the point, and so on, until ``degree`` are kept."""
    b, c = candidates.shape
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.sort(candidates, axis=1)
    repeated = np.zeros(order.shape, bool)
    repeated[:, 1:] = order[:, 1:] == order[:, :-1]
    candidates = np.where(repeated, -1, order)
    y = x[candidates]
    gap = y - x[points][:, None, :]
    dist = np.einsum("bcd,bcd->bc", gap, gap)
    alive = candidates >= 0
    length = np.einsum("bcd,bcd->bc", y, y)
    between = length[:, :, None] + length[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
    out = np.full((b, degree), -1, np.int32)
    row = np.arange(b)
    for k in range(degree):
        if not alive.any():
            break
        nearest = np.where(alive, dist, np.inf).argmin(axis=1)
        some = alive[row, nearest]
        out[some, k] = candidates[row, nearest][some]
        alive &= ~((relaxed * between[row, nearest] <= dist) & some[:, None])
        alive[row, nearest] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relaxed: float = RELAXED, seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (-1: none) of every vector and the node where searches start."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    centre = x - x.mean(axis=0, dtype=np.float64).astype(x.dtype)
    start = int(np.einsum("ij,ij->i", centre, centre).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    at = 1
    while at < n:
        size = min(BATCH, max(1, at), n - at)  # a batch no larger than the graph it is searched in
        points = order[at : at + size]
        at += size
        found, _ = _beam(graph, x, x[points], start, beam, product=False)
        graph[points] = _prune(x, points, found, degree, relaxed)
        source = np.repeat(points, degree)
        target = graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        place = np.arange(len(target)) - np.searchsorted(target, target)  # the how-manieth edge to its target
        for low in range(0, int(place.max(initial=-1)) + 1, degree):
            part = (place >= low) & (place < low + degree)
            nodes, index = np.unique(target[part], return_inverse=True)
            extra = np.full((len(nodes), degree), -1, np.int32)
            extra[index, place[part] - low] = source[part]
            merged = np.concatenate([graph[nodes], extra], 1)
            count = (merged >= 0).sum(axis=1)
            fits = count <= degree
            packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph[nodes[fits]] = packed[fits]
            if not fits.all():
                graph[nodes[~fits]] = _prune(x, nodes[~fits], merged[~fits], degree, relaxed)
    return graph, start


def usable(vector: Column) -> Column:
    """Neither null, zero nor holding null or non-finite numbers."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    good = ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def index(spark: SparkSession, vectors: DataFrame, k: int, per_shard: int = 10_000) -> DataFrame:
    """One row a shard: its vectors, their ids, edges and start. ``vectors``: id, vector."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    # the smallest ids of each distinct vector; rows beyond are cut before they are moved
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = Scratch(spark, "graph-nodes").save(nodes, "nodes")
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).first()
    shards, longest = max(1, round(facts["n"] / per_shard)), float(facts["m"] or 0)

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort([v[0] for v in rows["ids"]], kind="stable")]
        x = np.stack(rows["vector"].to_numpy()).astype("<f4")
        extra = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x, dtype=np.float64), 0)).astype("<f4")
        graph, start = build(np.concatenate([x, extra[:, None]], 1))
        ids = np.full((len(rows), k + 1), -1, "<i8")
        count = np.array([len(v) for v in rows["ids"]])
        for i, v in enumerate(rows["ids"]):
            ids[i, : len(v)] = v
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])], "size": [x.shape[1]], "start": [start], "x": [x.tobytes()],
            "graph": [graph.astype("<i4").tobytes()], "ids": [ids.tobytes()], "counts": [count.astype("<i4").tobytes()],
        })

    shard = F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")
    grouped = nodes.select("ids", "vector", F.size("vector").alias("size"), shard.alias("shard")).groupBy("size", "shard")
    out = grouped.applyInPandas(made, "shard int, size int, start int, x binary, graph binary, ids binary, counts binary")
    return Scratch(spark, "graph-index").save(out, "index")


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int = 128, per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (id, vector), its own id left out.

    Queries go in blocks to every shard's row, so a task holds one shard and one block.
    """
    asked = queries.select(F.col("id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    asked = asked.filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    blocks = max(1, -(-asked.count() // per_block))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    keys = graphs.select("size", "shard").distinct()
    left = asked.withColumn("block", block).join(keys, "size").select(
        "query_id", "vector", F.col("size").alias("size"), F.col("shard").alias("shard"), "block"
    )
    right = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(asked) or not len(shard):
            return empty
        row = shard.iloc[0]
        x = np.frombuffer(row["x"], "<f4").reshape(-1, int(row["size"]))
        graph = np.frombuffer(row["graph"], "<i4").reshape(len(x), -1)
        ids = np.frombuffer(row["ids"], "<i8").reshape(len(x), -1)
        counts = np.frombuffer(row["counts"], "<i4")
        outs = []
        for at in range(0, len(asked), BATCH):
            part = asked.iloc[at : at + BATCH]
            q = np.stack(part["vector"].to_numpy()).astype("<f4")
            near, _ = _beam(graph, x, q, int(row["start"]), beam, product=True)
            r, c = np.nonzero(near >= 0)
            node = near[r, c]
            score = (q[r].astype(np.float64) * x[node].astype(np.float64)).sum(axis=1)
            own = np.repeat(np.arange(len(node)), counts[node])
            member = ids[node][np.arange(ids.shape[1])[None, :] < counts[node][:, None]]
            hit = pd.DataFrame({"q": r[own], "query_id": part["query_id"].to_numpy()[r[own]], "vec_id": member, "score": score[own]})
            hit = hit[hit["query_id"] != hit["vec_id"]].sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
            outs.append(hit.groupby("q").head(k)[["query_id", "vec_id", "score"]])
        return pd.concat(outs) if outs else empty

    by = ["size", "shard", "block"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(found, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    return search(index(spark, vectors, k), queries, k)
