"""Exact Jaccard join of shingle sets by T-occurrence search.

Two texts link when the share of common five-word shingles reaches the threshold. The join is exact and never
lists the pairs of a group:

1. Texts with equal sets are one class. A count sketch over all texts, of fixed size, tells frequent shingles.
2. Of sets that link, the first shingles in any one order must meet (prefix filter); the order is rare before
   frequent, as the sketch has it, so shared passages hardly ever stand in a prefix. Postings that meet no
   other end there.
3. In every list that is left, pairs that cannot reach the threshold go: the differences of two sets are at
   least those of their counts by hash bucket. What remains is kept as a forest of possible links.
4. Groups of possible links are looked through once more with finer counts, one row a class, whose buckets follow the
   size of the set: what a passage in common had tied together comes apart.
5. What is left are small groups of classes. In each, DivideSkip finds the links: lists of a set's
   shingles are merged but for the longest, in which the candidates that the merged lists bring near the required
   overlap T are looked up. A count over positions does the work of the heap. Every candidate is verified: links
   are counted by class where they are found, in the one task where the two classes' parts meet, and of the
   pairs only a forest is written.

A group too large for a task is dealt into parts that meet two by two; a list likewise. Words, and texts
with fewer words than a shingle: see text.py. Texts without words link with nothing and are their own
component. A null doc_id has a set and may link; it is least only among nulls. Rows repeating a doc_id are rows
of their own and share its component if their texts link. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.llm.links import components
from semgraph.llm.text import WordHashes, shingles, words

WIDTH = 5
#: Counters of the sketch, and counters in a row of its table.
SKETCH, ROW = 1 << 20, 1 << 10
#: Buckets of the counts that bound differences.
BUCKETS = 64
#: Postings of a list, and shingles of a group, that one task compares at a time.
LIST_PART, GROUP_PART = 8_192, 2_000_000
#: Bits of the filter before texts are moved, at most.
MARKS = 1 << 28
#: Weight of a probe against a merge step in DivideSkip.
PROBE = 0.01
#: A look-up of a candidate in a list costs as much as so many steps of merging it.
LOOKUP = 20


def _sets(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    cache = WordHashes()
    for b in batches:
        yield b, [np.unique(shingles(cache.of(words(t.as_py())), WIDTH)) for t in b.column(at)]


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def facts_and_sketch(docs: DataFrame) -> DataFrame:
    """Of each text doc_id, text_hash, n (set size) and class (hash of the set); then each task's counters, ROW a row."""
    ddl = "doc_id long, text_hash long, n long, class long, at int, counts binary"
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("at", pa.int32()), ("counts", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH, np.int64)
        for b, sets in _sets(batches, 1):
            for s in sets:
                np.add.at(counters, (s >> np.uint64(44)).astype(np.int64), 1)
            rows = [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
        if counters.any():
            parts = counters.astype("<u4").reshape(-1, ROW)
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema
            )

    return texts_of(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, ddl)


def summed(sketches: DataFrame) -> np.ndarray:
    """All tasks' counters added up, in rows; the result has a fixed size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(ROW, np.int64))
        for b in batches:
            for at, counts in zip(b["at"], b["counts"], strict=True):
                total[at] += np.frombuffer(counts, "<u4")
        yield pd.DataFrame({"at": list(total), "counts": [v.astype("<i8").tobytes() for v in total.values()]})

    out = np.zeros(SKETCH, np.int64)
    for r in sketches.select("at", "counts").repartition("at").mapInPandas(run, "at int, counts binary").collect():
        out[r["at"] * ROW : (r["at"] + 1) * ROW] = np.frombuffer(r["counts"], "<i8")
    return out


def levels(counters: np.ndarray) -> np.ndarray:
    """How frequent a shingle is: 0 up to twice the mean of the counters, then one more for each doubling."""
    ordinary = max(1.0, 2 * float(counters.mean()))
    return np.floor(np.log2(np.maximum(counters, 1) / ordinary)).clip(0, 60).astype(np.int8) + (counters > ordinary).astype(np.int8)


def prefixes(docs: DataFrame, level: np.ndarray, share: tuple[int, int]) -> DataFrame:
    """class, n, counts by bucket, fine counts and prefix of every text with words; a task gives each class once."""
    ddl = "class long, n long, counts binary, fine binary, prefix array<long>"
    shared = docs.sparkSession.sparkContext.broadcast(level)  # SKETCH bytes
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, met = shared.value, set()
        for _, sets in _sets(batches, 1):
            new = {d: s for s in sets if len(s) and (d := _digest(s)) not in met}
            met.update(new)
            counts, fine, lists = [], [], []
            for s in new.values():
                fine.append(fine_counts(s).tobytes())
                counts.append(np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(int), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                n = len(s) - -(-num * len(s) // den) + 1
                order = np.argsort(level[(s >> np.uint64(44)).astype(np.int64)], kind="stable")[:n]
                lists.append(s[order].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.int64()), pa.array([len(s) for s in new.values()], pa.int64()), pa.array(counts, pa.binary()),
                 pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["class", "n", "counts", "fine", "prefix"],
            )

    return texts_of(docs).mapInArrow(run, ddl)


def lists_of_two(postings: DataFrame) -> DataFrame:
    """Postings (shingle, class) of lists of at least two classes, each once; ``part`` numbers LIST_PART of a list at a time."""
    ddl = "shingle long, class long, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))  # the last row, not yet known to be alone
        before = 0  # rows of its list before it
        for b in batches:
            token = np.concatenate([held[0], b.column(0).to_numpy(zero_copy_only=False)])
            owner = np.concatenate([held[1], b.column(1).to_numpy(zero_copy_only=False)])
            if not len(token):
                continue
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
            token, owner = token[once], owner[once]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            place = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
            place[: first[1] if len(first) > 1 else len(token)] += before
            joined = place > 0
            joined[:-1] |= place[1:] > 0
            out = np.flatnonzero(joined[:-1])
            held, before = (token[-1:], owner[-1:]), int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[out]), pa.array(owner[out]), pa.array((place[out] // LIST_PART).astype(np.int32))], names=["shingle", "class", "part"]
            )
        if len(held[0]) and before:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0]), pa.array(held[1]), pa.array([before // LIST_PART], pa.int32())], names=["shingle", "class", "part"]
            )

    return postings.repartition("shingle").sortWithinPartitions("shingle", "class").mapInArrow(run, ddl)


class Forest:
    """Union-find over any ids."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _possible(n: np.ndarray, m: int, apart: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether sets of sizes n and m that differ in at least ``apart`` shingles can reach the threshold."""
    num, den = share
    common = (n + m - apart) // 2
    return (den * common >= num * (n + m - common)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def possible_links(lists: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Forests of the pairs that may link: a, b. ``lists``: shingle, p, q, part, class, n, counts in parts p and q of a list."""

    def tie(forest: Forest, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, sides: np.ndarray) -> None:
        roots = [forest.find(i) for i in ids.tolist()]
        if len(set(roots)) == 1:
            return
        one_part = sides[0] == sides[-1]
        waiting = np.argsort(n, kind="stable")
        while len(waiting):
            reached = [waiting[0]]
            waiting = waiting[1:]
            while reached and len(waiting):
                i = reached.pop()
                apart = np.abs(counts[waiting] - counts[i]).sum(axis=1, dtype=np.int64)
                near = _possible(n[waiting], int(n[i]), apart, share)
                if not one_part:
                    near &= sides[waiting] != sides[i]
                for j in waiting[near].tolist():
                    forest.join(int(ids[i]), int(ids[j]))
                reached += waiting[near].tolist()
                waiting = waiting[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple] = []

        def close(rows: list[tuple]) -> None:
            token, ids, n, counts, sides = (np.concatenate(c) for c in zip(*rows, strict=True))
            edges = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]).any(axis=1), [True]]))
            pairs = edges[:-1][np.diff(edges) == 2]  # most lists: compared all at once
            apart = np.abs(counts[pairs] - counts[pairs + 1]).sum(axis=1, dtype=np.int64)
            num, den = share
            a, b = n[pairs], n[pairs + 1]
            common = (a + b - apart) // 2
            near = (den * common >= num * (a + b - common)) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
            for i in pairs[near].tolist():
                forest.join(int(ids[i]), int(ids[i + 1]))
            for lo, hi in zip(edges[:-1][np.diff(edges) > 2].tolist(), edges[1:][np.diff(edges) > 2].tolist(), strict=True):
                tie(forest, ids[lo:hi], n[lo:hi], counts[lo:hi], sides[lo:hi])

        for b in batches:
            if not b.num_rows:
                continue
            get = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            token = np.stack([get("shingle"), get("p").astype(np.int64), get("q").astype(np.int64)], 1)
            counts = np.frombuffer(b"".join(get("counts")), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
            rows = (token, get("class"), get("n"), counts, get("part"))
            last = int(np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]).any(axis=1)]))[-1])
            if held and (held[-1][0][-1] != token[0]).any():
                close(held)
                held = []
            if last:
                close([*held, tuple(c[:last] for c in rows)])
                held = []
            held.append(tuple(c[last:] for c in rows))
        if held:
            close(held)
        ends = [(x, forest.find(x)) for x in list(forest.parent)]
        ends = [(x, r) for x, r in ends if x != r]
        for at in range(0, len(ends), 100_000):
            part = ends[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])

    dealt = lists.repartition("shingle", "p", "q").sortWithinPartitions("shingle", "p", "q")
    return dealt.mapInArrow(run, "a long, b long")


def fine_buckets(n: int) -> int:
    """About eight shingles a bucket, so that sets that have little in common differ by more than links allow."""
    return max(16, 1 << max(0, (n - 1) // 8).bit_length())


def fine_counts(s: np.ndarray) -> np.ndarray:
    b = fine_buckets(len(s))
    return np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b).clip(0, 65535).astype("<u2")


def loosened(n: list[int], fine: list[np.ndarray], sides: list[int], share: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the pairs that the fine counts leave possible. Sizes that may link differ by one halving at most."""
    size, side = np.array(n), np.array(sides)
    two = len(set(sides)) > 1
    buckets = np.array([len(f) for f in fine])
    tables, at = {}, np.zeros(len(n), np.int64)
    for b in np.unique(buckets).tolist():
        rows = np.flatnonzero(buckets == b)
        at[rows] = np.arange(len(rows))
        whole = np.stack([fine[i] for i in rows]).astype(np.int32)
        tables[b] = (whole, whole[:, : b // 2] + whole[:, b // 2 :])

    def apart(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), np.int64)
        b, own = int(buckets[i]), at[i]
        for mine, theirs, other in ((0, 0, b), (0, 1, 2 * b), (1, 0, b // 2)):
            k = np.flatnonzero(buckets[others] == other)
            for lo in range(0, len(k), 512):
                part = k[lo : lo + 512]
                out[part] = np.abs(tables[other][theirs][at[others[part]]] - tables[b][mine][own]).sum(axis=1)
        return out

    num, den = share
    waiting, out = np.argsort(size, kind="stable"), []
    while len(waiting):
        reached, waiting = [int(waiting[0])], waiting[1:]
        while reached and len(waiting):
            i = reached.pop()
            lo, hi = np.searchsorted(size[waiting], [-(-num * size[i] // den), den * size[i] // num + 1])
            window = waiting[lo:hi]
            if two:
                window = window[side[window] != side[i]]
            near = window[_possible(size[window], int(size[i]), apart(i, window), share)] if len(window) else window
            out += [(i, int(j)) for j in near]
            reached += near.tolist()
            waiting = waiting[~np.isin(waiting, near)]
    return out


def _by_group(
    rows: DataFrame, members: DataFrame, most: int, value: str,
    links_of: Callable[[list[int], list[bytes], list[int], list[int]], tuple[list[tuple[int, int]], np.ndarray]],
) -> DataFrame:
    """Links within groups: rows (class, group, n, value, copies) of a group go to one task, or to parts that meet two by
    two where the sizes of its ``members`` sum up to more than ``most``. ``links_of`` gets sizes, values, parts and copies
    and returns a forest and how many links each has found. Out come the forest (a, b) and, as (a, a), counts of links."""
    parts = members.groupBy("group").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.join(parts, "group").withColumn("part", part).withColumn("other", other).select(
        "class", "group", "n", value, "copies", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) < 2 or now[1] != now[2] and len({side for _, _, side, _ in held.values()}) < 2:
                return  # of two parts one is empty: the other meets itself elsewhere
            ids = sorted(held)  # a class met in several rows is held once
            got, found = links_of(*map(list, zip(*(held[c] for c in ids), strict=True)))
            some = np.flatnonzero(found).tolist()
            if got or some:
                a, b = [ids[i] for i, _ in got] + [ids[i] for i in some], [ids[j] for _, j in got] + [ids[i] for i in some]
                counts = [0] * len(got) + found[some].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts, pa.int64())], names=["a", "b", "links"])

        for b in batches:
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            for g, p, q, cls, *of in zip(*(c[k] for k in ("group", "p", "q", "class", "n", value, "part", "copies")), strict=True):
                if (g, p, q) != now:
                    yield from links()
                    now, held = (g, p, q), {}
                held[cls] = of
        yield from links()

    return dealt.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q").mapInArrow(run, "a long, b long, links long")


def loosened_links(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Forests of what stays possible in each group by the fine counts. ``rows``: class, group, n, fine."""

    def links_of(n: list[int], raw: list[bytes], sides: list[int], copies: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        return loosened(n, [np.frombuffer(f, "<u2") for f in raw], sides, share), np.zeros(len(n), np.int64)

    return _by_group(rows.withColumn("copies", F.lit(1)), rows, 64 * GROUP_PART, "fine", links_of).select("a", "b")


def divide_skip(sets: list[np.ndarray], sides: list[int], share: tuple[int, int]) -> list[tuple[int, int]]:
    """A forest of the links among sets (sorted, without repeats): pairs of positions."""
    return counted_links(sets, sides, [1] * len(sets), share)[0]


def counted_links(
    sets: list[np.ndarray], sides: list[int], copies: list[int], share: tuple[int, int]
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest of the links among sets (sorted, without repeats) and for each set the copies of all sets it links with.

    Where sides differ at all, only pairs of different sides are looked at.
    """
    num, den = share
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    side, weight = np.array(sides)[order], np.array(copies, np.int64)[order]
    two = len(set(sides)) > 1
    size = n[order]
    tokens, index = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.lexsort((owner, index))
    postings = owner[by].astype(np.int64)  # of each token, ascending
    keys = index[by].astype(np.int64) * len(sets) + postings
    start = np.searchsorted(index[by], np.arange(len(tokens) + 1))
    length = np.diff(start)
    mine = np.split(index, np.cumsum(size)[:-1])
    root, found, out = np.arange(len(sets)), np.zeros(len(sets), np.int64), []

    def merged(lists: np.ndarray, ends: np.ndarray, x: int) -> np.ndarray:
        """How many of the lists each set before x stands in."""
        parts = [postings[a:b] for a, b in zip(start[lists].tolist(), ends.tolist(), strict=True)]
        return np.bincount(np.concatenate(parts) if parts else np.empty(0, np.int64), minlength=x)

    for x in range(1, len(sets)):
        own = mine[x]
        own = own[length[own] > 1]
        need = -(-num * int(size[x]) // den)  # overlap with the smallest partner allowed
        if len(own) < need:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        ends = np.searchsorted(keys, own * len(sets) + x)  # its own place in its lists: smaller sets stand before
        skipped = min(int(need / (PROBE * np.log2(int(length[own[-1]]) + 1) + 1)), need - 1)
        cut = len(own) - skipped
        seen = merged(own[:cut], ends[:cut], x)
        least = np.searchsorted(size[:x], -(-num * int(size[x]) // den))
        near = np.flatnonzero(seen[least:] >= need - skipped) + least
        if two:
            near = near[side[near] != side[x]]
        if not len(near):
            continue
        long = own[cut:]
        if int((ends[cut:] - start[long]).sum()) <= LOOKUP * len(long) * len(near):
            common = seen[near] + merged(long, ends[cut:], x)[near]
        else:
            probe = long[:, None] * len(sets) + near
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            common = seen[near] + (keys[at] == probe).sum(axis=0)
        linked = near[den * common >= num * (int(size[x]) + size[near] - common)]
        if not len(linked):
            continue
        found[x] += weight[linked].sum()
        found[linked] += weight[x]
        roots, first = np.unique(root[linked], return_index=True)
        out += [(int(order[x]), int(order[c])) for c in linked[first].tolist()]
        root[x] = roots[0]
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    back = np.zeros(len(sets), np.int64)
    back[order] = found
    return out, back


def marks(wanted: DataFrame) -> np.ndarray:
    """Bits set at the hashes ``mark``: 16 a row or more, at most MARKS; rows beyond share bits, which only lets more pass."""
    size = min(MARKS, 1 << max(16, (16 * wanted.count()).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[b["mark"].to_numpy().astype(np.int64) & (size - 1)] = True
        parts = bits.reshape(-1, 8 * ROW)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"at": some.astype(np.int32), "bits": [np.packbits(parts[i]).tobytes() for i in some]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, bits in zip(b["at"], b["bits"], strict=True):
                total[at] = total.get(at, 0) | np.frombuffer(bits, np.uint8)
        yield pd.DataFrame({"at": list(total), "bits": [v.tobytes() for v in total.values()]})

    out = np.zeros(size // 8, np.uint8)
    for r in wanted.mapInPandas(run, "at int, bits binary").repartition("at").mapInPandas(merged, "at int, bits binary").collect():
        out[r["at"] * ROW : (r["at"] + 1) * ROW] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (doc_id, text) whose ``mark`` has its bit set."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # MARKS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            place = b.column(2).to_numpy(zero_copy_only=False) & (8 * len(bits) - 1)
            yield b.filter(pa.array((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1)).select(["doc_id", "text"])

    return texts.mapInArrow(run, "doc_id long, text binary")


def exact_links(docs: DataFrame, members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links among the classes of each group: forests (a, b) and counts (a, a, links), as _by_group has them.

    ``members``: class, n, at (doc_id and text_hash of a row that has it), copies (rows that have it), group.
    """
    ddl = "class long, group long, n long, shingles binary, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, 1):
            digest = [_digest(s) for s in sets]
            keep = [i for i, (d, want) in enumerate(zip(digest, b.column(0).to_pylist(), strict=True)) if d == want]
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(2).take(take), pa.array([len(sets[i]) for i in keep], pa.int64()),
                 pa.array([sets[i].tobytes() for i in keep], pa.binary()), b.column(3).take(take)], names=["class", "group", "n", "shingles", "copies"],
            )

    # A row is named by its id and its text: ids may be null or stand for many texts.
    key, hashed = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text")
    # a bit for each wanted row first, so that the texts of others are not moved
    texts = marked(texts_of(docs).withColumn("mark", F.xxhash64("doc_id", hashed)), marks(members.select(F.xxhash64("at.doc_id", "at.text_hash").alias("mark"))))
    texts = texts.withColumn("key", key).withColumn("text_hash", hashed)
    wanted = members.withColumn("key", F.coalesce(F.col("at.doc_id").cast("string"), F.lit("null"))).select("key", "at.text_hash", "class", "group", "copies")
    found = texts.join(wanted.hint("merge"), ["key", "text_hash"]).select("class", "text", "group", "copies").mapInArrow(run, ddl)

    def links_of(n: list[int], raw: list[bytes], sides: list[int], copies: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        return counted_links([np.frombuffer(s, np.uint64) for s in raw], sides, copies, share)

    return _by_group(found, members, GROUP_PART, "shingles", links_of)


def similar(spark: SparkSession, docs: DataFrame, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and n_links (how many other rows
    the row links with, equal texts among them) of every row; text_hash and group_id (null without words) name the row
    and its component where ids are null or repeated."""
    scratch = Scratch(spark, "jaccard")
    facts = scratch.save(facts_and_sketch(docs), "facts")
    level = levels(summed(facts.filter("at IS NOT NULL")))
    texts = facts.filter("at IS NULL").select("doc_id", "text_hash", "n", "class")
    some = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("at")
    reps = scratch.save(texts.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), some, F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")

    first = scratch.save(prefixes(docs, level, share), "first")
    lists = scratch.save(lists_of_two(first.select(F.explode("prefix").alias("shingle"), "class")), "lists")
    one = first.select("class", "n", "counts").dropDuplicates(["class"])
    parts = lists.filter("part > 0").groupBy("shingle").agg((F.max("part") + 1).alias("parts"))
    dealt = lists.join(parts, "shingle", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.select("shingle", "class", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    forests = scratch.save(possible_links(dealt.join(one, "class"), share), "possible")
    named_group = lambda found: found.select(F.col("node").alias("class"), F.col("root").alias("group"))
    fine = first.select("class", "n", "fine").join(named_group(components(spark, forests)), "class").dropDuplicates(["class"])
    groups = components(spark, loosened_links(scratch.save(fine, "fine"), share))
    scratch.forget("first", "lists")

    members = scratch.save(reps.join(named_group(groups), "class"), "members")
    links = scratch.save(exact_links(docs, members, share), "links")
    joined = components(spark, links.select("a", "b")).select(F.col("node").alias("class"), "root")
    counts = links.filter("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    roots = reps.join(joined, "class", "left").join(counts, "class", "left").select(
        "class", "rep", F.coalesce("root", "class").alias("root"), n_links.alias("n_links")
    )
    roots = scratch.save(roots, "roots")
    least = scratch.save(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    named = scratch.save(roots.join(least, "root").select("class", "component_id", "n_links", F.col("root").alias("group_id")), "named")
    linked = texts.filter("n > 0").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "text_hash", "group_id")
    alone = texts.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(None).cast("long").alias("group_id"))
    return linked.unionByName(alone)
