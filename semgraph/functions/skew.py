"""Joins of a large side to one row per key, where a key may hold most of the large side.

Adaptive execution splits a hot key only if both sides come straight from a shuffle; a side that is an aggregate
on the key does not. Here hot keys are found by counting, and dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.terms import quoted

#: A key with this share of all rows is hot, so there are 64 hot keys at most; a hot key is dealt over SALTS tasks.
SHARE, SALTS = 1 / 64, 64
#: A key with fewer rows is no burden for a task.
LEAST = 100_000
#: Tables of more than LARGE rows are dealt so that a task has some TASK_ROWS of them, whatever the session says.
LARGE, TASK_ROWS = 1_000_000, 250_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks carry so many rows; None for few rows, which are left to the session.

    Never fewer tasks than the session has for a shuffle: a join would deal both its sides again.
    """
    if rows <= LARGE:
        return None
    return max(int(-(-rows // TASK_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by key in tasks of a bounded size. What sorts or groups them next does so here, not in the tasks of a scan,
    whose rows grow with the files."""
    tasks = tasks_for(df.sparkSession, rows)
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def split_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", *, share: float = SHARE, salts: int = SALTS,
    least: int = LEAST, hint: str | None = None,
) -> DataFrame:
    """``big.join(small, on, how)`` for inner, left, left_semi and left_anti, with the rows of hot keys spread.

    ``small`` has one row per key at most. Its rows of hot keys are repeated for every salt, all others are joined
    plainly. Rows of ``big`` with a NULL key match nothing and are dealt evenly. ``hint`` names the way to join where
    sizes of files mislead.
    """
    keys = [F.col(quoted(c)) for c in on]
    missing = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
    counts = big.where(~missing).groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where((F.col("_n") >= least) & (F.col("_n") >= total * share)).select(*on, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)  # 1 / share rows at most
    turn = (F.monotonically_increasing_id() % salts).cast("int")
    salted = big.join(hot, list(on), "left").withColumn("_salt", F.when(missing | F.col("_hot"), turn).otherwise(0)).drop("_hot")
    every = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    repeated = small.join(hot, list(on), "left").withColumn("_salt", every).drop("_hot")
    return salted.join(repeated.hint(hint) if hint else repeated, [*on, "_salt"], how).drop("_salt")
