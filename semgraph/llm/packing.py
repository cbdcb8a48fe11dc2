"""Packing documents into sequences of a fixed length by linear grouping.

Whole pieces of one sequence's length stand alone. Of the rest only the histogram of lengths matters for
planning, and it has fewer rows than a sequence has tokens, however many documents there are. Lengths above
a threshold are dealt into groups of equal cardinality and rounded up to the longest of their group; that
leaves few sizes, for which sets of sizes (configurations) are chosen by a knapsack over what is left, each
as often as the counts allow. Then actual lengths take the places of the rounded ones, longest first, which
gives back the rounding, and short pieces go to the sequence they fill best.

The plan is a table of intervals - pieces of length x with ranks r..s go to sequences q.. at offset o - whose
size depends on the sequence length only. Documents meet it in one broadcast join of that bounded table.
Ranks within a length are split over many salts, so a length that a third of all pieces share is no hot key.

Null or empty texts are one piece of the end id alone; a repeated row gets a place of its own.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

#: Pieces a salt should hold about; more pieces mean more salts.
PER_SALT = 50_000

class Encoder:
    """Text -> token ids as little-endian 32-bit bytes.

    ``vocabulary`` is the rank file of the vocabulary: it gives the ids of the tokenizer file (a test holds them
    against each other) in a fifth of the time. The file's added tokens, which no merge gives, are read from
    ``tokenizer``; without it their names are text like any other.
    """

    def __init__(self, vocabulary: str, pattern: str, tokenizer: str | None = None) -> None:
        import base64
        import json

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = []
        if tokenizer:
            with open(tokenizer, encoding="utf-8") as file:
                added = json.load(file)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in or need what stands around them are not supported")
        special = {t["content"]: t["id"] for t in added}
        self.encoding = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode(text, allowed_special="all"))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def cut(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, tokenizer: str | None = None
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document longer than ``capacity`` is cut into full pieces after a first one that holds the rest.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern, tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.of(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for piece, lo in enumerate([0, *range(first, n, capacity)]):
                    hi = lo + capacity if lo else first
                    part = ids[4 * lo : 4 * hi]
                    row = (doc, piece, lo, hi - lo, zlib.crc32(part), part)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, ddl)


# -- the plan: histogram in, intervals out ------------------------------------------------------------------------


def grouped(histogram: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Equal-cardinality groups of the lengths, longest first: (rounded size, [(length, count)...]).

    A length is split over groups where a border falls inside it; groups rounded to one size are one.
    """
    per = -(-sum(histogram.values()) // groups) if histogram else 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                if not out or out[-1][0] != length:
                    out.append((length, []))
                room = per
            took = min(left, room)
            out[-1][1].append((length, took))
            left, room = left - took, room - took
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sets of sizes and how often each is used, until all counts are used up.

    Each time the largest size left is taken with the fullest completion from the sizes left: a bounded
    knapsack over the capacity. The set is repeated as often as the counts allow, which uses up a size.
    """
    left = dict(enumerate(counts))
    out = []
    while left := {k: n for k, n in left.items() if n}:
        first = max(left, key=lambda k: sizes[k])
        use = {first: 1}
        room = capacity - sizes[first]
        # reach[v]: the size that completes a filling of v, found with the largest sizes first
        reach: dict[int, tuple[int, int]] = {0: (-1, 0)}
        table = np.zeros(room + 1, bool)
        table[0] = True
        for k in sorted(left, key=lambda k: -sizes[k]):
            spare = left[k] - (k == first)
            times = 0
            while times < spare and sizes[k] * (times + 1) <= room:
                times += 1
                shifted = np.zeros_like(table)
                shifted[sizes[k] :] = table[: room + 1 - sizes[k]]
                new = np.flatnonzero(shifted & ~table)
                if not len(new):
                    break
                for v in new.tolist():
                    reach[v] = (k, v - sizes[k])
                table |= shifted
            if table[room]:
                break
        fill = int(np.flatnonzero(table)[-1])
        while fill:
            k, fill = reach[fill]
            use[k] = use.get(k, 0) + 1
        use = {k: min(n, left[k]) for k, n in use.items()}
        times = min(left[k] // n for k, n in use.items())
        out.append((use, times))
        for k, n in use.items():
            left[k] -= n * times
    return out


def plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, first rank, count, first sequence, offset) and the number of sequences.

    Ranks of a length run from 0; the pieces of an interval go to consecutive sequences at one offset.
    """
    taken: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        out.append((length, taken[length], count, sequence, offset))
        taken[length] += count

    made = grouped({x: n for x, n in histogram.items() if x > small}, groups)
    stock = [list(reversed(runs)) for _, runs in made]  # actual lengths of each group, longest last
    counts = [sum(n for _, n in runs) for _, runs in made]
    bins: list[tuple[int, int, int]] = []  # (room left, first sequence, how many)
    sequences = 0
    for use, times in configurations([size for size, _ in made], counts, capacity):
        slots = [k for k, n in sorted(use.items()) for _ in range(n)]
        columns = []
        for k in slots:
            need, column = times, []
            while need:
                length, have = stock[k].pop()
                got = min(have, need)
                column.append((length, got))
                need -= got
                if have > got:
                    stock[k].append((length, have - got))
            columns.append(column)
        at = 0
        while at < times:
            step = min(c[0][1] for c in columns)
            offset = 0
            for column in columns:
                length, have = column[0]
                place(length, step, sequences + at, offset)
                offset += length
                if have > step:
                    column[0] = (length, have - step)
                else:
                    column.pop(0)
            bins.append((capacity - offset, sequences + at, step))
            at += step
        sequences += times

    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for room, first, count in bins:
        rooms[room].append((first, count))
    open_rooms = list(rooms)
    for length in sorted((x for x in histogram if x <= small), reverse=True):
        need = histogram[length]
        while need:
            fits = [r for r in open_rooms if r >= length]
            if not fits:
                rooms[capacity].append((sequences, -(-need // (capacity // length))))
                sequences += rooms[capacity][-1][1]
                open_rooms = [r for r in rooms if rooms[r]]
                continue
            room = min(fits)
            first, count = rooms[room].pop()
            got = min(need, count)
            place(length, got, first, capacity - room)
            rooms[room - length].append((first, got))
            if count > got:
                rooms[room].append((first + got, count - got))
            need -= got
            open_rooms = [r for r in rooms if rooms[r]]
    return out, sequences


def pack(
    spark: SparkSession, docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2,
    groups: int = 1024, small: int = 128, with_ids: bool = False, tokenizer: str | None = None,
) -> DataFrame:
    """Every piece with its sequence_id and offset; sequences are filled from 0 without gaps.

    ``groups``: how many equal-cardinality groups lengths above ``small`` are dealt into. ``tokenizer``: see Encoder.
    """
    scratch = Scratch(spark, "packing")
    salted = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 20)).cast("int").alias("_lot")
    pieces = scratch.save(cut(docs, vocabulary, pattern, capacity, end_id, with_ids, tokenizer).select("*", salted), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(1, -(-sum(histogram.values()) // PER_SALT))
    whole = histogram.pop(capacity, 0)
    intervals, sequences = plan(histogram, capacity, groups, small)
    if whole:
        intervals.append((capacity, 0, whole, sequences, 0))

    salt = (F.col("_lot") % salts).alias("_salt")
    rows = pieces.select("*", salt)
    counts = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_lot", "doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("_local", local - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    # bounded by the capacity: see plan()
    table = F.broadcast(spark.createDataFrame(
        intervals, "length long, _first long, _count long, _sequence long, offset long"
    ))
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    placed = ranked.join(table, (ranked["length"] == table["length"]) & inside).drop(table["length"])
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return placed.select(*keep, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def best_fit(lengths: list[int], capacity: int) -> int:
    """Sequences that plain best-fit decreasing needs; the yardstick of the tests."""
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            i = min(fits, key=rooms.__getitem__)
            rooms[i] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)
