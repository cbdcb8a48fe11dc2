"""Reading tables, guarded queries and catalogue listings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping as Dict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.terms import quoted

Resolver = Callable[[str], DataFrame]

_NAME_PART = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


def safe_name(name: str) -> str:
    """A dotted name of one to three plain parts, backtick-quoted."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(_NAME_PART.fullmatch(p) for p in parts):
        raise ValueError(f"{name!r} is not a table name of one to three plain parts")
    return ".".join(quoted(p) for p in parts)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(safe_name(name))


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, column: str, lower: object, upper: object, partitions: int, **options
) -> DataFrame:
    """A database table read by many tasks, split on ranges of ``column``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper),
            numPartitions=str(partitions), **options,
        )
        .load()
    )


@dataclass(frozen=True)
class FolderTables:
    """Tables kept as ``<folder>/<name>.parquet``; ``moved`` names other places of some of them."""

    spark: SparkSession
    folder: str
    moved: Dict[str, str] = field(default_factory=dict)

    def location(self, name: str) -> str:
        safe_name(name)
        return self.moved.get(name, f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.location(name))


def folder_tables(spark: SparkSession, folder: str) -> FolderTables:
    return FolderTables(spark, folder)


@dataclass(frozen=True)
class CatalogTables:
    """Tables by their catalogue names."""

    spark: SparkSession

    def location(self, name: str) -> str | None:
        """Where a file table lies; None for views and tables of other systems."""
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {safe_name(name)}").where("col_name IN ('Location', 'Type')")
        found = {r["col_name"]: r["data_type"] for r in described.collect()}
        return found.get("Location") if found.get("Type") in ("MANAGED", "EXTERNAL") else None

    def __call__(self, name: str) -> DataFrame:
        return read_table(self.spark, name)


def register_views(resolve: Resolver, names: Iterable[str]) -> None:
    for name in names:
        resolve(name).createOrReplaceTempView(name)


def guard_select(sql: str) -> str:
    """One SELECT (or WITH) statement, nothing else."""
    text = sql.strip().removesuffix(";").strip()
    if not text:
        raise ValueError("the query is empty")
    if ";" in text:
        raise ValueError("the query must be one statement without ';'")
    if not re.match(r"(select|with)\b", text, re.IGNORECASE):
        raise ValueError("only SELECT statements are allowed")
    return text


def read_query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """A guarded SELECT; ``:name`` placeholders are bound from ``args``, never spliced."""
    return spark.sql(guard_select(sql), args=args) if args else spark.sql(guard_select(sql))


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    return df.limit(rows)


def catalog_columns(
    spark: SparkSession, database: str | None = None, keys: Dict[str, Iterable[str]] | None = None,
    references: Dict[tuple[str, str], str] | None = None,
) -> DataFrame:
    """One row per column of every catalogued table and view, with its place in the declared key and what it refers to.

    Spark's catalogue holds no keys, so they are declared: ``keys`` by table, ``references`` from (table, column) to a
    table. Only the catalogue is asked.
    """
    rows = []
    for table in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        full = table.name if table.isTemporary or not table.namespace else ".".join([*table.namespace, table.name])
        key = list((keys or {}).get(table.name, ()))
        for position, column in enumerate(spark.catalog.listColumns(full)):
            place = key.index(column.name) + 1 if column.name in key else None
            target = (references or {}).get((table.name, column.name))
            rows.append((full, table.description, column.name, position, column.dataType, column.description, place, target))
    return spark.createDataFrame(
        rows, "table string, table_comment string, column string, ordinal int, type string, comment string, key_place int, refers_to string"
    )


def catalog_tables(columns: DataFrame) -> DataFrame:
    return columns.groupBy("table").agg(
        F.count("*").alias("columns"), F.max("table_comment").alias("comment")
    )
