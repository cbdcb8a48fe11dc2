"""Ranked lexical search by a dual tree: the best documents for every item, exactly.

One pass over the documents counts their terms and keeps, of each, the terms that some item has. From that table come
the number of documents and terms and each term's document frequency. A document then is a sparse vector of what each
term would add to a score, an item the set of its terms.

Each task builds a tree over runs of its documents, those with the same strongest term next to each other, and one over
the items, those with the same rarest term next to each other. A node holds the coordinate maxima of what lies below it:
the largest share of each term, or whether some item has the term. The product of two nodes bounds the score of every
pair below them. A pair of nodes goes down as long as the bound reaches the weakest kth score among the node's items;
otherwise the whole batch of pairs is left out, which loses nothing. What remains at the leaves is scored in 64-bit
integers. Each item's best leaves are scored first, and kth scores carry over from run to run. A task returns its best
of each item; Spark merges them.

Items come to the tasks in batches of ``batch_bytes`` of text (one longer item is a batch of its own), each batch one pass
over the documents. Null and empty texts have no term. A null doc_id counts like any other, ranks after all ids among
equal scores and is returned as null; repeated documents rank one by one. Equal rows (item_id, text) are answered once,
one item_id with different texts once a text. Items without terms, and empty tables, give nothing. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.llm.hard_negatives import merge

#: Documents of a run, items searched together, children of a node of either tree, levels above the leaves.
RUN, GROUP, DOC_FAN, ITEM_FAN, LEVELS = 4096, 512, 8, 4, 3
#: Numbers in a dense slice of nodes; leaves each item scores first; bytes of item texts in a batch.
SLICE, FIRST, BATCH_BYTES = 1 << 22, 4, 4 << 20
#: Ids of documents without one.
LAST_ID = 2**63 - 1

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shares(tf: np.ndarray, length: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of a document of ``length`` terms that holds it ``tf`` times."""
    m = 10 + (90 * length * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Sparse:
    """Rows of (column, value), sorted by row and column."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> None:
        self.row, self.column, self.value, self.n = row, column, value, n
        self.start = np.searchsorted(row, np.arange(n + 1))

    def maxima(self, fan: int) -> Sparse:
        """One row for ``fan`` rows: the largest value of each column."""
        row = self.row // fan
        order = np.lexsort((self.column, row))
        row, column, value = row[order], self.column[order], self.value[order]
        first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(column) != 0)]) if len(row) else np.empty(0, np.int64)
        value = np.maximum.reduceat(value, first) if len(first) else value
        return Sparse(row[first], column[first], value, -(-self.n // fan))

    def dense(self, rows: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((len(rows), columns))
        count = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        out[np.repeat(np.arange(len(rows)), count), self.column[at]] = self.value[at]
        return out

    def tree(self, fan: int) -> list[Sparse]:
        levels = [self]
        for _ in range(LEVELS):
            levels.append(levels[-1].maxima(fan))
        return levels


class Items:
    """A tree over some items: places of their terms, coordinate maxima by level."""

    def __init__(self, places: np.ndarray, sets: list[np.ndarray], w: np.ndarray) -> None:
        rarest = [s[w[s].argmax()] for s in sets]
        order = np.argsort(rarest, kind="stable")
        self.places, sets = places[order], [np.sort(sets[i]) for i in order]
        self.terms = np.unique(np.concatenate(sets))
        count = np.array([len(s) for s in sets])
        column = np.searchsorted(self.terms, np.concatenate(sets))
        row = np.repeat(np.arange(len(sets)), count)
        self.levels = Sparse(row, column, np.ones(len(row), np.int64), len(sets)).tree(ITEM_FAN)


def _bounds(items: Sparse, docs: Sparse, alive: np.ndarray, columns: int) -> np.ndarray:
    """Bounds of all pairs of nodes that stand in a row and a column with a pair alive; zero elsewhere."""
    out = np.zeros(alive.shape)
    rows, nodes = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    step = max(1, SLICE // max(1, columns))
    for i in range(0, len(rows), step):
        left = items.dense(rows[i : i + step], columns)
        for j in range(0, len(nodes), step):
            out[np.ix_(rows[i : i + step], nodes[j : j + step])] = left @ docs.dense(nodes[j : j + step], columns).T
    return out


def _weakest(kth: np.ndarray) -> list[np.ndarray]:
    """The least kth score below each node of the item tree."""
    out = [kth]
    for _ in range(LEVELS):
        out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), ITEM_FAN)))
    return out


class Search:
    """The ``k`` best documents met so far for each of some items."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        none = np.empty(0, np.int64)
        self.best = (none, none, none)
        self.kth = np.ones(len(items.places), np.int64)  # scores above 0 only
        self.scored = self.pairs = 0

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        wanted = score >= self.kth[row]
        self.best = row, _, score = merge([self.best, (row[wanted], ids[wanted], score[wanted])], self.k)
        full = np.flatnonzero(np.r_[np.diff(row) != 0, True]) if len(row) else row
        count = np.diff(np.r_[-1, full])
        self.kth[row[full[count == self.k]]] = score[full[count == self.k]]

    def score(self, leaves: np.ndarray, docs: Sparse, ids: np.ndarray) -> None:
        """Exact scores of all pairs in the leaves (item, node of the lowest level) that are set."""
        item, node = np.nonzero(leaves)
        sets = np.zeros((len(self.items.places), len(self.items.terms)), bool) if len(item) else None
        if sets is None:
            return
        base = self.items.levels[0]
        sets[base.row, base.column] = True
        for at in range(0, len(item), 8192):
            i, d = np.repeat(item[at : at + 8192], DOC_FAN), (node[at : at + 8192, None] * DOC_FAN + np.arange(DOC_FAN)).ravel()
            i, d = i[d < docs.n], d[d < docs.n]
            count = docs.start[d + 1] - docs.start[d]
            i, d, count = i[count > 0], d[count > 0], count[count > 0]
            if not len(d):
                continue
            first = np.cumsum(count) - count
            entry = np.repeat(docs.start[d] - first, count) + np.arange(count.sum())
            part = np.where(sets[np.repeat(i, count), docs.column[entry]], docs.value[entry], 0)
            self.scored += len(d)
            self.add(i, ids[d], np.add.reduceat(part, first))

    def run(self, docs: Sparse, ids: np.ndarray) -> None:
        """Meet a run of documents whose columns are this group's terms."""
        tree, columns = docs.tree(DOC_FAN), len(self.items.terms)
        self.pairs += docs.n * len(self.items.places)
        leaves = np.ones((len(self.items.places), tree[1].n), bool)
        done = np.zeros_like(leaves)
        if (self.kth == 1).any():  # some items have no kth score yet: their most promising leaves come first
            fresh = np.zeros_like(leaves)
            fresh[self.kth == 1] = True
            bound = _bounds(self.items.levels[0], tree[1], fresh, columns)
            top = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
            np.put_along_axis(done, top, True, axis=1)
            done &= fresh & (bound > 0)
            self.score(done, docs, ids)
        weakest = _weakest(self.kth)
        alive = np.ones((self.items.levels[LEVELS].n, tree[LEVELS].n), bool)
        for level in range(LEVELS, 0, -1):
            bound = _bounds(self.items.levels[level], tree[level], alive, columns)
            alive &= bound >= weakest[level][:, None] * (1 - 1e-9)  # doubles: never above a true bound by rounding
            alive = np.repeat(alive, ITEM_FAN, axis=0)[: self.items.levels[level - 1].n]
            if level > 1:
                alive = np.repeat(alive, DOC_FAN, axis=1)[:, : tree[level - 1].n]
        bound = _bounds(self.items.levels[0], tree[1], alive, columns)
        self.score(alive & (bound >= self.kth[:, None] * (1 - 1e-9)) & ~done, docs, ids)


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text), and term and tf of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one batch of items
    empty = np.empty(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n, size, term, tf = [], [], [], []
            for text in b.column("text"):
                found = terms(text.as_py())
                met = np.fromiter((p for p in map(known.get, found) if p is not None), np.int32)
                ids, times = np.unique(met, return_counts=True) if len(met) else (empty, empty)
                n.append(len(found))
                size.append(len(ids))
                term.append(ids)
                tf.append(times)
            offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [empty]), pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    known_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id")
    return docs.select(known_id, F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def runs(batches: Iterator[pa.RecordBatch], w: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[Sparse, np.ndarray]]:
    """Documents in runs, in the order of their strongest term, as shares by term."""
    for b in batches:
        for at in range(0, b.num_rows, RUN):
            part = b.slice(at, RUN)
            count = part.column("term").value_lengths().to_numpy().astype(np.int64)
            term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            row = np.repeat(np.arange(len(count)), count)
            value = shares(tf, part.column("n").to_numpy()[row], w[term], n_docs, n_terms)
            strongest = np.full(len(count), -1)
            order = np.lexsort((value, row))
            last = np.cumsum(count) - 1
            strongest[count > 0] = term[order[last[count > 0]]]
            to = np.argsort(np.argsort(strongest, kind="stable"), kind="stable")  # a document's place in the run
            order = np.lexsort((term, to[row]))
            ids = np.empty(len(count), np.int64)
            ids[to] = part.column("doc_id").to_numpy()
            yield Sparse(to[row][order], term[order], value[order], len(count)), ids


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, *, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: of each item of (item_id, text) the ``k`` best documents of (doc_id, text)."""
    scratch = Scratch(spark, "ranked-search")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    asked = scratch.save(asked.filter(F.octet_length("text") > 0), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).scalar()
    n_batches = max(1, -(-spark.range(1).select(size).first()[0] // batch_bytes))
    found = None
    for at in range(n_batches):
        batch = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_batches)) == at).collect()  # batch_bytes of text
        rows = _search_batch(scratch, docs, [(r["item_id"], terms(bytes(r["text"]))) for r in batch], k)
        rows = rows.withColumn("batch", F.lit(at))
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("batch", "item").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), "score")


def _search_batch(scratch: Scratch, docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """item, item_id, doc_id and score: each task's best for each item."""
    schema, spark = "item int, item_id long, doc_id long, score long", scratch.spark
    vocabulary: dict[bytes, int] = {}
    sets = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in found}), np.int64) for _, found in items]
    ids = [i for i, _ in items]
    if not vocabulary:
        return spark.createDataFrame([], schema)
    table, seen = scratch.measured(
        counted(docs, vocabulary), "terms", docs=F.count_if(F.col("n") > 0), words=F.coalesce(F.sum("n"), F.lit(0))
    )
    n_docs, n_terms = seen["docs"], seen["words"]
    if not n_terms:
        return spark.createDataFrame([], schema)
    df = np.zeros(len(vocabulary), np.int64)
    met = table.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row a term
    df[met.column("term").to_numpy()] = met.column("df").to_numpy()
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    shared = spark.sparkContext.broadcast((sets, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, w = shared.value
        filled = [i for i, s in enumerate(sets) if len(s)]
        rarest = sorted(filled, key=lambda i: (int(sets[i][w[sets[i]].argmax()]), i))
        groups = [rarest[at : at + GROUP] for at in range(0, len(rarest), GROUP)]
        searches = [Search(Items(np.array(g), [sets[i] for i in g], w), k) for g in groups]
        for found, doc_ids in runs(batches, w, n_docs, n_terms):
            for one in searches:
                place = np.full(len(w), -1)
                place[one.items.terms] = np.arange(len(one.items.terms))
                column = place[found.column]
                mine = column >= 0
                one.run(Sparse(found.row[mine], column[mine], found.value[mine], found.n), doc_ids)
        for one in searches:
            row, doc_id, score = one.best
            item = one.items.places[row]
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item, pa.int32()), "item_id": pa.array([ids[i] for i in item], pa.int64()),
                "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64()),
            })

    return table.filter(F.size("term") > 0).select("doc_id", "n", "term", "tf").mapInArrow(run, schema)
