"""The list of queries, and the sample graph spelled once for Spark and once as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semgraph.operators import triples
from semgraph.plans import shop
from semgraph.sources.tables import Resolver, folder_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NS, BASE = shop.EX, shop.BASE
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def query(name: str, sql: str | None = None):
    """Register a callable (spark, folder) -> DataFrame, with its SQL where SQL can say it."""
    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def tables(spark: SparkSession, folder: str) -> Resolver:
    return folder_tables(spark, folder)


def shop_graph(spark: SparkSession, folder: str, *names: str, layout: str = "rows") -> DataFrame:
    """The sample graph, unwritten, or only the named facts (``type``, an attribute, a relation).

    Naming what a question needs keeps the plan small: nothing else is scanned or even planned.
    """
    wanted = {RDF_TYPE if n == "type" else NS + n for n in names}
    maps = shop.MAPPING.restricted(wanted) if names else None
    return triples.build(spark, shop.MAPPING, tables(spark, folder), maps=maps, layout=layout)


# -- the same graph in SQL -----------------------------------------------------------------------------------------

_KEYS = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"),
    "Event": ("events", "event_id"),
}
_DATA = {
    "Region": {"name": ("r_name", None)},
    "Nation": {"name": ("n_name", None)},
    "Customer": {"name": ("c_name", None), "balance": ("c_acctbal", "double"), "segment": ("c_mktsegment", None)},
    "Supplier": {"name": ("s_name", None), "balance": ("s_acctbal", "double")},
    "Part": {
        "name": ("p_name", None), "brand": ("p_brand", None), "partType": ("p_type", None),
        "size": ("p_size", "integer"), "price": ("p_retailprice", "double"),
    },
    "Order": {
        "status": ("o_orderstatus", None), "totalPrice": ("o_totalprice", "double"),
        "orderDate": ("o_orderdate", "dateTime"), "priority": ("o_orderpriority", None),
    },
    "Event": {"eventType": ("event_type", None), "at": ("ts", "dateTime"), "value": ("value", "double")},
}
_LINKS = [
    ("inRegion", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    ("inNation", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    ("inNation", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    ("placedBy", "orders", "Order", "o_orderkey", "Customer", "o_custkey"),
    ("contains", "lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    ("suppliedBy", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey"),
    ("performedBy", "events", "Event", "event_id", "Customer", "user_id"),
]
LINK_NAMES = ("inRegion", "inNation", "placedBy", "contains", "suppliedBy", "performedBy")


def iri_sql(cls: str, column: str) -> str:
    return f"('{BASE}{cls}/' || {column})"


def _row(table: str, subject: str, predicate: str, obj: str, kind: str, datatype: str | None = None) -> str:
    dt = f"'{XSD}{datatype}'" if datatype else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT {subject} AS subject, '{predicate}' AS predicate, {obj} AS object, '{kind}' AS object_type, "
        f"{dt} AS datatype, CAST(NULL AS VARCHAR) AS lang, false AS inferred, '{table}' AS source_table FROM {table}"
    )


def facts_sql(*wanted: str) -> str:
    """UNION ALL of the named facts: ``type``, an attribute, a relation; everything when none is named."""
    def on(name: str) -> bool:
        return not wanted or name in wanted

    parts = []
    for cls, (table, key) in _KEYS.items():
        if on("type") or on(f"type:{cls}"):
            parts.append(_row(table, iri_sql(cls, key), RDF_TYPE, f"'{NS}{cls}'", "iri"))
        for name, (column, datatype) in _DATA[cls].items():
            if on(name) or on(f"{cls}.{name}"):
                parts.append(
                    _row(table, iri_sql(cls, key), NS + name, f"CAST({column} AS VARCHAR)", "literal", datatype)
                )
    for name, table, src, src_key, dst, dst_key in _LINKS:
        if on(name) or on(f"{src}.{name}"):
            parts.append(_row(table, iri_sql(src, src_key), NS + name, iri_sql(dst, dst_key), "iri"))
    return "\nUNION ALL ".join(parts)


def with_facts(body: str, *wanted: str) -> str:
    """A statement over ``t``, the named facts."""
    return f"WITH t AS ({facts_sql(*wanted)})\n{body}"
