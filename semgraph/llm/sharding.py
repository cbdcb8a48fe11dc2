"""Shards by a Feistel permutation of global row numbers.

Row ``r`` of ``n`` goes to place ``p = permute(r)``, a bijection of 0..n-1 that a seed fixes; its shard is
``p mod shards`` and its slot ``p div shards``. So shard sizes differ by one row at most, slots have no
gaps, and both can be computed from the row number alone, without a shuffle or a sort.

The network works on pairs (left, right) below ``a`` and ``b`` with ``a * b`` just above ``n``: each round
adds a hash of one half to the other, modulo its size, which can be undone and so is one-to-one. Fewer
than ``a`` of the pairs lie beyond ``n``; they are permuted again until they fall inside (cycle walking).

Row numbers come from the files: rows of a parquet table are numbered in the order of file path and place
in the file. Only one count per file is gathered. A frame that is no plain table is written first.

Null or repeated rows are rows like any other. An empty table gives no rows. Columns named like the
results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

ROUNDS = 6
#: Rows of a file that share a join key.
PART = 65_536
#: A row walks at most so often; that it needs more has a chance below n * (1/16)**16 for any n of 256 and more,
#: and for less there are no 16 pairs beyond n. A row that did would stop the job.
WALKS = 16
_PRIME = (1 << 31) - 1
_STEP = 1_103_515_245  # multiplier of the rounds, below the prime


def number_rows(
    spark: SparkSession, path: str, add: Callable[[DataFrame], DataFrame] = lambda df: df, column: str = "row_number"
) -> DataFrame:
    """The parquet table at ``path`` with a global row number from 0.

    ``add`` derives columns where the rows are read, before file offsets are joined: what is derived and not the
    text is then moved, where only that is asked for.
    """
    return _numbered(spark.read.parquet(path), column, add)


def number_frame(spark: SparkSession, df: DataFrame, column: str = "row_number") -> DataFrame:
    """Any frame, written to the shared folder once, with a global row number from 0."""
    return _numbered(Scratch(spark, "numbered").save(df.drop(column), "rows"), column)


def _numbered(table: DataFrame, column: str, add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    keep = [F.col(f"`{c}`") for c in table.columns if c.lower() not in (column.lower(), "_file", "_place", "_part", "_before")]
    counts = table.select(path.alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # each file's offset once for every PART rows of it, so that one large file is many join keys
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / PART)))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("_file", "_before", parts.alias("_part"))
    rows = add(table.select(*keep, path.alias("_file"), place.alias("_place"), F.floor(place / PART).alias("_part")))
    own = [F.col(f"`{c}`") for c in rows.columns if c not in ("_file", "_place", "_part")]
    return rows.join(before, ["_file", "_part"]).select(*own, (F.col("_before") + F.col("_place")).alias(column))


def sides(n: int) -> tuple[int, int]:
    """Sizes of the two halves: a * b is n or little more."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int) -> list[int]:
    return [(seed * 48_271 + (i + 1) * 69_621_013) % _PRIME for i in range(ROUNDS)]


def _scramble(half: Column, key: Column) -> Column:
    """A hash of one half, below the prime; no product exceeds 2**62."""
    x = (half + key) % _PRIME
    y = ((x * x) % _PRIME * _STEP + key) % _PRIME
    return (y * y) % _PRIME


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    wide = lambda value: F.lit(value).cast("long")
    keys = round_keys(seed)
    pairs = F.array(*[F.struct(wide(p).alias("p"), wide(q).alias("q")) for p, q in zip(keys[::2], keys[1::2], strict=True)])

    def two_rounds(s: Column, k: Column) -> Column:
        left = (s["l"] + _scramble(s["r"], k["p"])) % wide(a)
        return F.struct(left.alias("l"), ((s["r"] + _scramble(left, k["q"])) % wide(b)).alias("r"))

    # exact up to 2**53 rows: the quotient is a whole number
    start = F.struct((x % wide(a)).alias("l"), ((x - x % wide(a)) / wide(a)).cast("long").alias("r"))
    return F.aggregate(pairs, start, two_rounds, lambda s: s["r"] * wide(a) + s["l"])


def permute(number: Column, n: int, seed: int = 0) -> Column:
    """The place of a row number in the permutation of 0..n-1 that ``seed`` names."""
    a, b = sides(n)
    place = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), _network(number.cast("long"), a, b, seed),
        lambda p, _: F.when(p < n, p).otherwise(_network(p, a, b, seed)),
    )
    return F.transform(F.array(place), lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("walked too long"))))[0]


def shard(numbered: DataFrame, shards: int, seed: int = 0, number: str = "row_number") -> DataFrame:
    """Add shard and slot to a frame numbered from 0 without gaps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    n = numbered.count()
    place = numbered.withColumn("place", permute(F.col(number), n, seed))
    return (
        place.withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", ((F.col("place") - F.col("place") % shards) / shards).cast("long"))
    )


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null) and eight for its length."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard_table(spark: SparkSession, path: str, shards: int, seed: int = 0) -> DataFrame:
    """Law ``rows`` for a table of documents: its rows, each with size, text_crc32, law, shard and slot.

    ``grown_shard`` is null: with one more shard the law deals all rows anew. Equal texts are not kept together,
    for a text that holds a third of all rows could not be with sizes one apart.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = lambda docs: docs.withColumn("size", text_size(F.col("text"))).withColumn("text_crc32", F.crc32(text))
    rows = shard(number_rows(spark, path, facts), shards, seed)
    return rows.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
