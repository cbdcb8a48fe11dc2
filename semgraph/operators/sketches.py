"""Profiles that grow: mergeable sketches of columns, kept by part of a table and merged when asked.

A part's sketches are made in one pass and need not be made again while the part does not change. Different values come
from HyperLogLog sketches, quantiles of numbers from KLL sketches; counts, extremes and moments are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semgraph.functions.terms import quoted
from semgraph.operators.profile import kind_of

#: Two thirds of all estimates of different values lie within this share of the truth; quantiles lie within this rank.
DISTINCT_ERROR, RANK_ERROR = 0.02, 0.02
#: Logarithm of the registers of a HyperLogLog sketch (1.6 % standard error), size of a KLL sketch (1.3 % of rank).
REGISTERS, KLL = 12, 200


def sketches(df: DataFrame, part: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(part, column, ordinal, kind, rows, filled, different, spread, min, max, total, squares), one row a part and column.

    ``different`` and ``spread`` are binary sketches; what only numbers have is null for others. NULL and NaN are no values
    of a number. ``part`` is any column of few values, kept as text.
    """
    rows = []
    fields = [f for f in df.schema.fields if f.name != part and (columns is None or f.name in columns)]
    for ordinal, f in enumerate(fields):
        col, numeric = F.col(quoted(f.name)), kind_of(f.dataType) == "numeric"
        number = F.nanvl(col.cast("double"), F.lit(None).cast("double")) if numeric else F.lit(None).cast("double")
        held = number if numeric else col
        text = F.hex(col) if isinstance(f.dataType, T.BinaryType) else F.to_json(col) if isinstance(
            f.dataType, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string")
        text = F.when(held.isNotNull(), text)
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(ordinal).alias("ordinal"), F.lit(kind_of(f.dataType)).alias("kind"), F.count(F.lit(1)).alias("rows"),
            F.count(held).alias("filled"), F.hll_sketch_agg(text, F.lit(REGISTERS)).alias("different"),
            (F.kll_sketch_agg_double(number, F.lit(KLL)) if numeric else F.lit(None).cast("binary")).alias("spread"),
            F.min(number).alias("min"), F.max(number).alias("max"), F.sum(number).alias("total"), F.sum(number * number).alias("squares"),
        ))
    made = df.groupBy(F.col(quoted(part)).cast("string").alias("part")).agg(F.array(*rows).alias("_all"))
    return made.select("part", F.inline("_all"))


def merged(parts: DataFrame) -> DataFrame:
    """column, kind, rows, nulls, distinct (estimated), min, q1, median, q3 (estimated), max, mean and std of all parts together."""
    some = F.when(F.col("filled") > 0, F.col("spread"))  # a sketch of nothing has no quantiles
    one = parts.groupBy("column", "ordinal", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("different")).alias("distinct"),
        F.kll_merge_agg_double(some).alias("_k"), F.count(some).alias("_some"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("total").alias("_t"), F.sum("squares").alias("_q"),
    )
    at = lambda p: F.when(F.col("_some") > 0, F.kll_sketch_get_quantile_double("_k", F.lit(p)))
    mean = F.col("_t") / F.nullif("filled", F.lit(0))
    spread = F.sqrt(F.greatest((F.col("_q") - F.col("_t") * mean) / F.nullif(F.col("filled") - 1, F.lit(0)), F.lit(0.0)))
    return one.orderBy("ordinal").select(
        "column", "kind", "rows", (F.col("rows") - F.col("filled")).alias("nulls"), "distinct", "min", at(0.25).alias("q1"), at(0.5).alias("median"),
        at(0.75).alias("q3"), "max", mean.alias("mean"), spread.alias("std"),
    )


def save(found: DataFrame, folder: str) -> None:
    """Keep sketches; only the parts they are of are replaced."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    kept = spark.read.parquet(folder)
    return kept.withColumn("part", F.col("part").cast("string"))


def refresh(df: DataFrame, part: str, changed: Iterable[str], folder: str) -> DataFrame:
    """Sketch the changed parts again and merge them with all that are kept. Only rows of changed parts are read."""
    save(sketches(df.where(F.col(quoted(part)).cast("string").isin(*changed)), part), folder)
    return merged(load(df.sparkSession, folder))
