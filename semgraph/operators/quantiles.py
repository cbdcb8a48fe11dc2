"""Exact interpolated quantiles that never gather a column into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch


def exact_quantiles(values: DataFrame, group: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """(group, p, quantile) with linear interpolation between neighbours.

    Equal values are counted first, so a hot value is one row. The distinct values are range-partitioned
    and only partition totals are summed up in order; a sorted window runs inside the few partitions that
    hold a wanted rank, and each of those has the size of one range partition.
    """
    scratch = Scratch(values.sparkSession, "quantiles")
    counted = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    placed = scratch.save(
        counted.repartitionByRange(F.col(group), F.col(value)).withColumn("_part", F.spark_partition_id()), "placed"
    )
    totals = placed.groupBy(group, "_part").agg(F.sum("_n").alias("_rows"))
    running = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
    everything = totals.groupBy(group).agg(F.sum("_rows").alias("_all"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    position = F.col("p") * (F.col("_all") - 1)
    ends = F.explode(F.array(F.floor(position), F.ceil(position)))
    ranks = everything.select(group, "_all", asked.alias("p")).select(
        group, "p", position.alias("_position"), ends.alias("_rank")
    ).distinct()
    wanted = ranks.join(totals, group).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rows"))
    ).select(group, "_part", "p", "_position", "_rank", "_before")
    inside = placed.join(wanted.select(group, "_part").distinct(), [group, "_part"], "left_semi")
    ordered = Window.partitionBy(group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.sum("_n").over(ordered))
    at = inside.join(wanted, [group, "_part"]).where(
        (F.col("_rank") < F.col("_before") + F.col("_upto"))
        & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_n"))
    )
    low, high = F.min(value), F.max(value)
    part = F.max(F.col("_position") - F.floor("_position"))
    return at.groupBy(group, "p").agg((low + (high - low) * part).alias("quantile"))
