"""SimHash fingerprints of texts, and the search for near ones by permuted block tables.

A text's terms are its runs of three words (the whole text when shorter), each weighted by 1 + ln(count). Every
term's 128-bit hash votes with its weight for or against each bit; the sign of the sum is the bit. Two
fingerprints agree on a bit with a chance of 1 - angle / pi between the weighted term vectors, so the share
of agreeing bits estimates their cosine: likeness is ``cos(pi * differing / 128)``, never below 0.

Empty and null texts have no terms and the all-zero fingerprint; bits with no majority are 0. Equal texts have
equal fingerprints. Very long texts take memory for 128 bits a term, in slices.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.llm.text import WordHashes, mixed, shingles, words

BITS = 128
WIDTH = 3
#: Terms whose bits are unpacked at a time.
SLICE = 8192
_SECOND = np.uint64(0xA0761D6478BD642F)


def fingerprint(hashes: np.ndarray) -> bytes:
    """Fingerprint of a text given by its word hashes."""
    terms, counts = np.unique(shingles(hashes, WIDTH), return_counts=True)
    if not len(terms):
        return bytes(BITS // 8)
    weights = (1 + np.log(counts)).astype(np.float32)
    wide = np.empty((len(terms), 2), "<u8")
    wide[:, 0], wide[:, 1] = terms, mixed(terms ^ _SECOND)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), SLICE):
        bits = np.unpackbits(wide[at : at + SLICE].view(np.uint8), axis=1)
        votes += weights[at : at + SLICE] @ bits.astype(np.float32)
    return np.packbits(2 * votes > float(weights.sum(dtype=np.float64))).tobytes()


def distance(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, math.cos(math.pi * distance(a, b) / BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text's fingerprint as hex."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            marks = [fingerprint(cache.of(words(t.as_py()))).hex() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks)], schema=schema)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).mapInArrow(run, "doc_id long, fingerprint string")


# -- permuted block tables ----------------------------------------------------------------------------------------


def block_tables(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Which blocks stand first in each table: ``radius`` differing bits leave ``blocks - radius`` blocks equal."""
    return list(itertools.combinations(range(blocks), blocks - radius))


def near(marks: DataFrame, radius: int = 3, blocks: int = 5, split: int = 20_000) -> DataFrame:
    """For each distinct fingerprint, how many other distinct ones lie within the radius: fingerprint, n_near.

    Every table sorts fingerprints by some of their blocks; two within the radius meet in a table at least, and
    are counted in the first of those in which they meet. A bucket larger than ``split`` is dealt into parts
    that are compared two by two, so no task holds more than two parts. Pairs are counted, not written.
    """
    if BITS % blocks:
        edges = [round(i * 32 / blocks) for i in range(blocks + 1)]  # in hex digits
    else:
        edges = [i * 32 // blocks for i in range(blocks + 1)]
    tables = block_tables(radius, blocks)
    mark = F.col("fingerprint")
    keys = F.array(*[
        F.concat(F.lit(f"{n}:"), *[F.substring(mark, edges[i] + 1, edges[i + 1] - edges[i]) for i in table])
        for n, table in enumerate(tables)
    ])
    distinct = marks.select("fingerprint").distinct()
    entries = distinct.select("fingerprint", F.explode(keys).alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = entries.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("n") / split).cast("int"))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = full.withColumn("part", part).withColumn("other", other).select(
        "fingerprint", "bucket", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part"
    )
    shifts = [(4 * (32 - edges[i + 1]), (1 << 4 * (edges[i + 1] - edges[i])) - 1) for i in range(blocks)]

    def bucket_counts(key: tuple, rows: list[tuple[bytes, int]]) -> list[tuple[str, int]]:
        table = int(key[0].split(":")[0])
        raw = np.frombuffer(b"".join(bytes.fromhex(m) for m, _ in rows), ">u8").reshape(-1, 2)
        side = np.array([p for _, p in rows])
        values = [int(m, 16) for m, _ in rows]
        earlier = tables[:table]
        got = np.zeros(len(rows), np.int64)
        for i in range(len(rows)):
            rest = np.flatnonzero(np.bitwise_count(raw[i + 1 :] ^ raw[i]).sum(axis=1, dtype=np.int64) <= radius) + i + 1
            for j in rest.tolist():
                if key[1] != key[2] and side[i] == side[j]:
                    continue  # both of one part: compared where the part meets itself
                x = values[i] ^ values[j]
                same = [not (x >> s & m) for s, m in shifts]
                if not any(all(same[k] for k in t) for t in earlier):
                    got[i] += 1
                    got[j] += 1
        return [(m, int(n)) for (m, _), n in zip(rows, got, strict=True) if n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, out = None, [], []
        for b in batches:
            for key, row in zip(zip(b["bucket"], b["a"], b["b"], strict=True), zip(b["fingerprint"], b["part"], strict=True), strict=True):
                if key != now:
                    if len(rows) > 1:
                        out += bucket_counts(now, rows)
                    now, rows = key, []
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=["fingerprint", "n"])
                out = []
        if len(rows) > 1 and (out := bucket_counts(now, rows)):
            yield pd.DataFrame(out, columns=["fingerprint", "n"])

    ordered = dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    counted = ordered.mapInPandas(run, "fingerprint string, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_near"))
    return distinct.join(counted, "fingerprint", "left").select("fingerprint", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


# -- every text next to its edited form ---------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of another text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next text, descending by doc_id.

    Texts are range-partitioned by doc_id once; a task reads its rows in order and looks one row ahead. The
    last row of each task waits for the first of the next: a few rows, joined afterwards. Rows of equal doc_id
    follow by their text; a null doc_id comes last; the very last row is followed by the first.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("task", pa.int32()), ("head", pa.string()), ("tail", pa.string()),
    ]
    schema = pa.schema(fields)
    ddl = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, task int, head string, tail string"
    )

    def result(cache: WordHashes, doc: int | None, text: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
        changed = edited(text, following)
        raw = changed.encode()
        other = fingerprint(cache.of(words(raw)))
        return (
            doc, len(text), hashlib.sha256(raw).hexdigest(), mark.hex(), other.hex(), likeness(mark, other),
            likeness(mark, next_mark),
        )

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = WordHashes(), TaskContext.get().partitionId()
        last = None
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                mark = fingerprint(cache.of(words(text.encode())))
                if last is None:
                    rows.append((None, None, None, mark.hex(), None, None, None, task, text, None))
                else:
                    rows.append((*result(cache, *last, text, mark), task, None, None))
                last = (doc, text, mark)
            yield batch(rows)
        if last is not None:
            doc, text, mark = last
            yield batch([(doc, None, None, mark.hex(), None, None, None, task, None, text)])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            rows = [
                result(cache, None if pd.isna(d) else int(d), t, bytes.fromhex(m), h, bytes.fromhex(n))
                for d, t, m, h, n in zip(b["doc_id"], b["tail"], b["fingerprint"], b["next_head"], b["next_mark"], strict=True)
            ]
            out = pd.DataFrame(rows, columns=[f for f, _ in fields[:7]])
            yield out.astype({"doc_id": "Int64"})

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    ranged = rows.withColumn("h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("h")).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), "h", order[1]
    ).select("doc_id", "text")
    done = Scratch(spark, "fingerprints").save(ranged.mapInArrow(run, ddl), "edited")
    columns = [f for f, _ in fields[:7]]
    heads = done.filter("head IS NOT NULL").select("task", "head", F.col("fingerprint").alias("mark"))
    # one row per task: heads in order, each found by the task before it
    order_of_tasks = Window.orderBy("task")
    first = F.first("task").over(order_of_tasks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = done.filter("head IS NOT NULL").select("task").withColumn("next", F.coalesce(F.lead("task").over(order_of_tasks), first))
    tails = done.filter("tail IS NOT NULL").select("task", "doc_id", "fingerprint", "tail")
    waiting = tails.join(links, "task").join(
        heads.select(F.col("task").alias("next"), F.col("head").alias("next_head"), F.col("mark").alias("next_mark")), "next"
    )
    ends = waiting.select("doc_id", "tail", "fingerprint", "next_head", "next_mark").mapInPandas(finish, ddl.split(", task")[0])
    return done.filter("head IS NULL AND tail IS NULL").select(*columns).unionByName(ends)


def agreeing_bits(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints in hex."""
    halves = [F.conv(F.substring(x, i, 16), 16, -10).cast("long") for x in (a, b) for i in (1, 17)]
    differing = F.bit_count(halves[0].bitwiseXOR(halves[2])) + F.bit_count(halves[1].bitwiseXOR(halves[3]))
    return 1 - differing / BITS
