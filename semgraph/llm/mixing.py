"""Mixing sources to target weights by temperature.

A source with T tokens gets the weight T**t / sum of all T**t. At t = 1 weights are the sources' natural shares,
at t = 0 all are equal. The exponent is bisected (many points a job) to the largest that reaches a target
entropy, then raised as far as a limit on repetition asks: no source is read more than ``max_repeats`` times.
The entropy target yields to the limit.

Weights become rows by budget: a source is read in whole passes and then in part of one more, each pass in
an order of its own given by hashes. Orders are made of blocks of about ``per_block`` documents: block sums
give each block's place, and running sums stay inside blocks, so a source that holds a third of all rows is
dealt over many tasks. The mixed stream is cut into stretches of ``stretch`` tokens; each stretch takes
every source by its weight, and is permuted inside.

Tokens are words, runs of bytes other than space and controls 9 to 13. Rows without words cost nothing and go
with every whole pass, or once where their source has no words at all. A null source is a source. Repeated
rows are rows of their own. An empty table gives no rows. Names starting with ``_mx_`` are used here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch

#: Exponents tried in one job, and jobs: 17**10 steps of [0, 1].
POINTS, JOBS = 16, 10
_SPAN = 1 << 31


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: float
    entropy: float
    repeats: float


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """_mx_source (never null), _mx_total tokens and _mx_docs of every source."""
    return docs.groupBy("_mx_source").agg(F.sum("_mx_n").alias("_mx_total"), F.count(F.lit(1)).alias("_mx_docs"))


def temperature(totals: DataFrame, budget: float | None, entropy_share: float | None, max_repeats: float | None) -> Mix:
    """Exponent and budget for the sources of ``totals``.

    ``entropy_share``: target entropy as a share of the largest, the logarithm of the number of sources.
    Without a budget it is what reads the largest source exactly once.
    """
    sized = totals.filter("_mx_total > 0")
    first = sized.agg(F.count(F.lit(1)).alias("n"), F.max("_mx_total").alias("top"), F.min("_mx_total").alias("low"), F.sum("_mx_total").alias("all")).first()
    if not first["n"]:
        return Mix(1.0, 0.0, 0.0, 0.0)
    top, low, whole = float(first["top"]), float(first["low"]), float(first["all"])
    x = F.log(F.col("_mx_total") / top)

    def measures(ts: list[float]) -> list[tuple[float, float]]:
        """(sum of relative T**t, entropy) for each exponent, over all sources in one pass."""
        sums = [F.sum(F.exp(t * x)) for t in ts] + [F.sum(F.exp(t * x) * x) for t in ts]
        got = sized.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        z, e = got[: len(ts)], got[len(ts) :]
        return [(a, math.log(a) - t * b / a) for t, a, b in zip(ts, z, e, strict=True)]

    def repeats(t: float, z: float) -> float:
        spent = top * z if budget is None else limited
        return max(spent / (z * top), spent * (low / top) ** (t - 1) / (z * top))

    limited = budget or 0.0
    if budget is not None and max_repeats is not None:
        limited = min(budget, max_repeats * whole)

    def bisect(right: object) -> float:
        """The border in [0, 1] beyond which ``right(t, z, entropy)`` holds; it holds at 1."""
        lo, hi = 0.0, 1.0
        for _ in range(JOBS):
            ts = [lo + (hi - lo) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            met = [right(t, *m) for t, m in zip(ts, measures(ts), strict=True)]
            k = met.index(True) if True in met else POINTS
            lo, hi = (ts[k - 1] if k else lo), (ts[k] if k < POINTS else hi)
        return hi

    exponent = 1.0
    if entropy_share is not None:
        target = entropy_share * math.log(first["n"])
        if measures([1.0])[0][1] < target:
            exponent = bisect(lambda t, z, h: h <= target)
    if max_repeats is not None and repeats(exponent, measures([exponent])[0][0]) > max_repeats:
        exponent = bisect(lambda t, z, h: repeats(t, z) <= max_repeats * (1 + 1e-12))
    z, h = measures([exponent])[0]
    # T**t / sum of T**t = rel**t / z; the largest source has rel = 1
    spent = top * z if budget is None else limited
    return Mix(exponent, spent, h, repeats(exponent, z))


def mix(
    spark: SparkSession, docs: DataFrame, budget: float | None = None, budget_ratio: float | None = None,
    entropy_share: float | None = None, max_repeats: float | None = None, seed: int = 0,
    per_block: int = 4096, stretch: int = 1_000_000,
) -> DataFrame:
    """The rows of the mixture: the columns of ``docs``, and n_tokens, weight, copy, stretch and slot.

    ``budget_ratio`` gives the budget as a multiple of all tokens.
    """
    scratch = Scratch(spark, "mixing")
    added = ("n_tokens", "weight", "copy", "stretch", "slot")
    names = [c for c in docs.columns if c.lower() not in added and not c.startswith("_mx_")]
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    # what names a row in an order: its id and text
    row = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(*names, source.alias("_mx_source"), n_words(F.col("text")).alias("_mx_n"), row.alias("_mx_row"))
    totals = scratch.save(source_tokens(rows), "sources")
    if budget_ratio is not None:
        budget = budget_ratio * float(totals.agg(F.coalesce(F.sum("_mx_total"), F.lit(0))).first()[0])
    chosen = temperature(totals, budget, entropy_share, max_repeats)
    top = F.lit(float(totals.agg(F.max("_mx_total")).first()[0] or 1))
    relative = F.when(F.col("_mx_total") > 0, F.exp(chosen.exponent * F.log(F.col("_mx_total") / top))).otherwise(0.0)
    z = totals.agg(F.sum(relative)).first()[0] or 1.0
    weighted = totals.withColumn("weight", relative / z)
    share = chosen.budget * F.col("weight")
    # a pass is whole if its budget lacks less than a rounding
    passes = F.when(F.col("_mx_total") > 0, F.floor(share / F.col("_mx_total") + 1e-9)).otherwise(1)
    weighted = weighted.withColumn("_mx_full", passes.cast("long")).withColumn(
        "_mx_rest", F.greatest(share - F.col("_mx_full") * F.col("_mx_total"), F.lit(0.0))
    ).withColumn("_mx_blocks", F.ceil(F.col("_mx_docs") / per_block).cast("long"))
    weighted = scratch.save(weighted, "weights")

    last = F.col("_mx_full") - F.when(F.col("_mx_rest") > 0, 0).otherwise(1)
    copies = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    dealt = rows.join(weighted, "_mx_source").withColumn("copy", F.explode(copies))
    order = F.pmod(F.xxhash64(F.col("copy"), F.col("_mx_row")), F.lit(_SPAN))
    dealt = dealt.withColumn("_mx_order", order).withColumn("_mx_block", F.shiftright(F.col("_mx_order") * F.col("_mx_blocks"), 31))
    # sums by block are taken without the texts
    keys = ["_mx_source", "copy", "_mx_block"]
    sums = dealt.groupBy(*keys).agg(F.sum("_mx_n").alias("_mx_sum"))
    lower = Window.partitionBy("_mx_source", "copy").orderBy("_mx_block").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.save(sums.select(*keys, F.coalesce(F.sum("_mx_sum").over(lower), F.lit(0)).alias("_mx_before")), "blocks")
    inside = Window.partitionBy(*keys).orderBy("_mx_order", "_mx_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_mx_run", F.sum("_mx_n").over(inside)).join(before, keys)
    end = F.col("_mx_before") + F.col("_mx_run")
    placed = placed.filter((F.col("copy") < F.col("_mx_full")) | (end <= F.col("_mx_rest")))
    offset = F.col("copy") * F.col("_mx_total") + end - F.col("_mx_n")
    at = F.when(F.col("weight") > 0, F.floor(offset / (F.col("weight") * stretch))).otherwise(F.col("_mx_block")).cast("long")
    mixed = placed.withColumn("stretch", at)
    shuffled = Window.partitionBy("stretch").orderBy(F.xxhash64("_mx_order", "_mx_row"), "_mx_row", "copy")
    return mixed.withColumn("slot", F.row_number().over(shuffled).cast("long") - 1).select(
        *names, F.col("_mx_n").alias("n_tokens"), "weight", "copy", "stretch", "slot"
    )
