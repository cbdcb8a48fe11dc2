"""Schema snapshots, their differences, and what a mapping would miss."""

from __future__ import annotations

from collections.abc import Mapping as Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.plans.mapping import Mapping

SNAPSHOT = "table string, column string, ordinal int, type string, comment string"


def snapshot(
    spark: SparkSession, tables: Dict[str, DataFrame], comments: Dict[tuple[str, str], str] | None = None
) -> DataFrame:
    """One row per column of every table, as the tables are now."""
    rows = [
        (t, f.name, i, f.dataType.simpleString(), (comments or {}).get((t, f.name)) or f.metadata.get("comment"))
        for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, SNAPSHOT)


def key_frame(spark: SparkSession, keys: Dict[str, tuple], foreign: Dict[str, list] | None = None) -> DataFrame:
    """(table, keys) with primary and foreign keys spelled out, for comparing two states."""
    rows = [
        (t, f"pk({', '.join(keys.get(t, ()))}) " + "; ".join(
            sorted(f"fk({', '.join(c)}) -> {r}({', '.join(rc)})" for c, r, rc in (foreign or {}).get(t, ()))))
        for t in sorted(set(keys) | set(foreign or {}))
    ]
    return spark.createDataFrame(rows, "table string, keys string")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change, old type, new type, comment): added, removed, retyped; tables missing.

    Names match without case. A comment someone wrote survives a source that no longer carries it.
    """
    key = lambda df: df.select(
        F.lower("table").alias("_t"), F.lower("column").alias("_c"), "table", "column", "type", "comment"
    )
    a, b = key(old).alias("a"), key(new).alias("b")
    there = b.select("_t").distinct().withColumn("_there", F.lit(True))
    both = a.join(b, ["_t", "_c"], "full_outer").join(there, "_t", "left")
    change = (
        F.when(F.col("_there").isNull(), "missing table")
        .when(F.col("a.column").isNull(), "added").when(F.col("b.column").isNull(), "removed")
        .when(F.col("a.type") != F.col("b.type"), "retyped").otherwise("same")
    )
    return both.select(
        F.coalesce("b.table", "a.table").alias("table"), F.coalesce("b.column", "a.column").alias("column"),
        change.alias("change"), F.col("a.type").alias("old_type"), F.col("b.type").alias("new_type"),
        F.coalesce("b.comment", "a.comment").alias("comment"),
    )


def keys_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    joined = old.withColumnRenamed("keys", "old_keys").join(new.withColumnRenamed("keys", "new_keys"), "table", "full_outer")
    return joined.where(~F.col("old_keys").eqNullSafe(F.col("new_keys")))


def mapping_drift(
    mapping: Mapping, live: DataFrame, old: DataFrame | None = None, *, unreadable: Dict[str, str] | None = None,
    tables: set[str] | None = None,
) -> DataFrame:
    """(kind, table, column, message, mapping_ref, severity) for columns the mapping reads.

    ``unreadable`` names tables the catalogue could not answer for, with the reason; that is a warning,
    not a missing table. ``tables`` restricts the check.
    """
    spark = live.sparkSession
    reads = [r for r in mapping.columns_read() if tables is None or r[0].lower() in {t.lower() for t in tables}]
    read = spark.createDataFrame(reads, "table string, mapping_ref string, column string")
    refused = spark.createDataFrame(
        [(t.lower(), why) for t, why in (unreadable or {}).items()], "_t string, why string"
    )
    before = old if old is not None else spark.createDataFrame([], SNAPSHOT)
    keyed = lambda df, n: df.select(
        F.lower("table").alias("_t"), F.lower("column").alias("_c"), F.col("type").alias(n)
    )
    known = live.select(F.lower("table").alias("_t")).distinct().withColumn("_known", F.lit(True))
    want = read.withColumn("_t", F.lower("table")).withColumn("_c", F.lower("column"))
    found = (
        want.join(known, "_t", "left").join(refused, "_t", "left")
        .join(keyed(live, "new_type"), ["_t", "_c"], "left").join(keyed(before, "old_type"), ["_t", "_c"], "left")
    )
    kind = (
        F.when(F.col("why").isNotNull(), "unreadable").when(F.col("_known").isNull(), "missing-table")
        .when(F.col("new_type").isNull(), "missing-column")
        .when(F.col("old_type") != F.col("new_type"), "type-changed")
    )
    whole = F.col("kind").isin("unreadable", "missing-table")
    message = (
        F.when(F.col("kind") == "unreadable", F.concat(F.lit("not readable: "), "why"))
        .when(F.col("kind") == "missing-table", F.concat(F.lit("no table "), "table"))
        .when(F.col("kind") == "missing-column", F.concat(F.lit("no column "), "table", F.lit("."), "column"))
        .otherwise(F.concat("old_type", F.lit(" -> "), "new_type"))
    )
    issues = found.withColumn("kind", kind).where(F.col("kind").isNotNull())
    severity = F.when(F.col("kind").isin("unreadable", "type-changed"), "warning").otherwise("error")
    out = issues.select(
        "kind", "table", F.when(~whole, F.col("column")).alias("column"), message.alias("message"), "mapping_ref",
        severity.alias("severity"),
    )
    return out.dropDuplicates(["kind", "table", "column", "mapping_ref"])
