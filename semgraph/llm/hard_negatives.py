"""Hard negatives: for an anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies just below the positive's.

Vectors are made integers, and scores are exact inner products. Rows are dealt into blocks by hash of the id; each
block is brought to one task, and the anchors stream past it, so candidates move once and anchors once a block. A tile
of anchors and candidates is multiplied by Strassen's recursion in 64-bit integers, odd sides padded with zeros. What a
tile finds goes into heaps, the ``k`` best by descending score and ascending id: one heap an anchor for its positives in
the first pass, one for each anchor and positive in the second, when the window below each positive is known. Heaps
merge in any order: over the tiles of a block in its task, over blocks by Spark.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Neither do vectors so long
that a product could leave 64 bits: components beyond ``sqrt((2**63 - 1) / length)`` of the longest vector. Vectors of
unequal length meet as if the shorter ended in zeros. Of repeated ids the row with the least (label, vector) counts.
Equal vectors are rows of their own and tie by id. An anchor without positives, or a positive without a row in its window,
gives nothing; neither does an empty table. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

#: Sides at which the recursion multiplies plainly.
LEAF = 32
#: Numbers in the vectors of a block, rows of a block at most, and rows of a tile on either side.
BLOCK_NUMBERS, BLOCK_ROWS, TILE = 1 << 21, 8192, (256, 4096)

Triples = tuple[np.ndarray, np.ndarray, np.ndarray]


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven half-size products; exact wherever the result fits 64 bits.

    Sums of halves may wrap around, which later differences undo: all steps are exact modulo 2**64.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ik,kj->ij", a, b)  # for integers three times as fast as matmul
    a, b = (np.pad(x, [(0, side % 2) for side in x.shape]) if any(side % 2 for side in x.shape) else x for x in (a, b))
    (h, i), j = (side // 2 for side in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def merge(heaps: list[Triples], k: int) -> Triples:
    """(row, id, score) of several heaps as one: of each row the ``k`` first by descending score, then ascending id."""
    row, ids, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*heaps, strict=True)) or [(), (), ()]))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], score[kept]


def heap(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> Triples:
    """The heap of each row of a tile: its ``k`` best allowed columns."""
    least = np.iinfo(np.int64).min
    seen = np.where(allowed, scores, least)
    floor = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else np.full(len(seen), least)
    row, column = np.nonzero((seen >= floor[:, None]) & allowed)
    return merge([(row, ids[column], seen[row, column])], k)


class Rows:
    """Rows of one side: ids, labels, vectors as a matrix padded with zeros, and the positives of anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, found: list | None = None) -> None:
        self.ids, self.labels, self.x, self.found = ids, labels, x, found

    @staticmethod
    def of(batch: pa.RecordBatch, width: int) -> Rows:
        vectors = batch.column("vector")
        length = vectors.value_lengths().to_numpy()
        x = np.zeros((len(vectors), width), np.int64)
        x[np.arange(width) < length[:, None]] = vectors.flatten().to_numpy()
        found = batch.column("found").to_pylist() if "found" in batch.schema.names else None
        return Rows(batch.column("id").to_numpy(), batch.column("label").to_numpy(), x, found)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        ids, labels, x = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "labels", "x"))
        order = np.lexsort((ids, labels))
        return Rows(ids[order], labels[order], np.ascontiguousarray(x[order]))

    def part(self, chosen: slice | np.ndarray) -> Rows:
        found = [self.found[i] for i in np.arange(len(self.ids))[chosen]] if self.found is not None else None
        return Rows(self.ids[chosen], self.labels[chosen], self.x[chosen], found)


def tiles(anchors: Rows, block: Rows) -> Iterator[tuple[Rows, np.ndarray]]:
    """Parts of a block of at most a tile's width, and their scores with the anchors."""
    for at in range(0, len(block.ids), TILE[1]):
        part = block.part(slice(at, at + TILE[1]))
        yield part, strassen(anchors.x, np.ascontiguousarray(part.x.T))


def positives_of(anchors: Rows, block: Rows, k: int) -> Iterator[dict]:
    """Heaps of rows of the anchors' labels; only the block's rows of these labels are multiplied."""
    for label in np.unique(anchors.labels):
        first, end = np.searchsorted(block.labels, [label, label], side="left")[0], np.searchsorted(block.labels, label, side="right")
        mine = anchors.part(anchors.labels == label)
        found = [heap(s, mine.ids[:, None] != part.ids, part.ids, k) for part, s in tiles(mine, block.part(slice(first, end)))]
        row, ids, score = merge(found, k)
        yield {"anchor_id": mine.ids[row], "other_id": ids, "score": score}


def negatives_of(anchors: Rows, block: Rows, k: int, window: tuple[int, int]) -> Iterator[dict]:
    """For each positive of an anchor the heap of rows of other labels in its window."""
    depth = max(len(f) for f in anchors.found)
    low, high = np.full((len(anchors.ids), depth), 1), np.full((len(anchors.ids), depth), 0)  # empty windows
    for i, found in enumerate(anchors.found):
        for j, positive in enumerate(found):
            low[i, j], high[i, j] = bounds(positive["score"], window)
    heaps: list[list[Triples]] = [[] for _ in range(depth)]
    for part, s in tiles(anchors, block):
        other = anchors.labels[:, None] != part.labels
        for j in range(depth):
            heaps[j].append(heap(s, other & (s >= low[:, j : j + 1]) & (s <= high[:, j : j + 1]), part.ids, k))
    for j in range(depth):
        row, ids, score = merge(heaps[j], k)
        yield {
            "anchor_id": anchors.ids[row], "positive_id": np.array([anchors.found[i][j]["other_id"] for i in row], np.int64),
            "positive_score": np.array([anchors.found[i][j]["score"] for i in row], np.int64), "other_id": ids, "score": score,
        }


def bounds(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """Least and largest x with window[0] * score <= 100 * x <= window[1] * score, within 64 bits."""
    low, high = -(-window[0] * score // 100), window[1] * score // 100
    return max(low, np.iinfo(np.int64).min), min(high, np.iinfo(np.int64).max)


def mine(
    spark: SparkSession, rows: DataFrame, anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 5,
    window: tuple[int, int] = (80, 100), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of a table (id, label, vector).

    ``anchor`` says on id and label which rows are anchors; ``window`` is in hundredths of the positive's score.
    """
    scratch = Scratch(spark, "hard-negatives")
    x = F.col("vector")
    usable = rows.filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
             F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))
    one = usable.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    table, seen = scratch.measured(one, "rows", width=F.coalesce(F.max(F.size("vector")), F.lit(0)))
    width = max(1, seen["width"])
    largest = int(((2**63 - 1) // width) ** 0.5) - 1
    table = table.filter(F.forall("vector", lambda v: F.abs(v) <= F.lit(largest)))
    blocks = max(1, -(-seen["n"] // max(64, min(block_rows, BLOCK_NUMBERS // width))))
    dealt = table.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "id", "label", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def meet(anchors: DataFrame, act: Callable[[Rows, Rows], Iterator[dict]], schema: str) -> DataFrame:
        """``act`` for every block and every tile of anchors."""
        found = ["found"] if "found" in anchors.columns else []
        candidates = dealt.select("*", *[F.lit(None).cast(anchors.schema["found"].dataType).alias(c) for c in found])
        both = candidates.unionByName(anchors.select(every, F.lit(1).alias("side"), "id", "label", "vector", *found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, parts, block = -1, [], None
            for batch in batches:
                of, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
                edges = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(of)]
                for start, end in zip(edges, edges[1:], strict=False):
                    if start == end:
                        continue
                    if of[start] != at:
                        at, parts, block = int(of[start]), [], None
                    if side[start] == 0:
                        parts.append(Rows.of(batch.slice(start, end - start), width))
                        continue
                    if block is None:
                        if not parts:
                            continue
                        block, parts = Rows.joined(parts), []
                    for first in range(start, end, TILE[0]):
                        anchors_ = Rows.of(batch.slice(first, min(TILE[0], end - first)), width)
                        for columns in act(anchors_, block):
                            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns.items()})

        placed = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side")
        return placed.mapInArrow(run, schema)

    def first(found: DataFrame, k: int, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    chosen = table.filter(anchor)
    near = first(
        meet(chosen, lambda a, b: positives_of(a, b, positives), "anchor_id long, other_id long, score long"), positives, "anchor_id"
    ).groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("found"))
    known = scratch.save(chosen.join(near, "id"), "anchors")  # at most ``positives`` entries an anchor
    schema = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
    mined = first(meet(known, lambda a, b: negatives_of(a, b, negatives, window), schema), negatives, "anchor_id", "positive_id")
    return mined.select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
