"""Attachments, keys, drift and incremental builds over the sample tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from semgraph.checks.registry import RDF_TYPE, facts_sql, iri_sql, query, shop_graph, tables
from semgraph.functions.scratch import Scratch
from semgraph.operators import attach, build, drift, keys, triples
from semgraph.plans import shop, statement
from semgraph.plans.mapping import Attribute, ClassMap, Mapping
from semgraph.sources.store import GraphStore
from semgraph.sources.tables import register_views

_cust = iri_sql("Customer", "c_custkey")


def _customers(spark, folder):
    typed = shop_graph(spark, folder, "type").where((F.col("predicate") == RDF_TYPE) & (F.col("object") == shop.CUSTOMER))
    return triples.entity_keys(typed.select("subject"), shop.MAPPING, shop.CUSTOMER)


# -- attachments -------------------------------------------------------------------------------------------------------

@query("virtual_attributes", f"""
SELECT {_cust} AS subject, CAST(c_custkey AS VARCHAR) AS c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS VARCHAR) AS "orderCount",
 (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS "nationName",
 (SELECT CAST(max(o_orderdate) AS VARCHAR) FROM orders WHERE o_custkey = c_custkey) AS "lastOrder" FROM customer""")
def virtual_attributes(spark, folder):
    register_views(tables(spark, folder), ["orders", "customer", "nation"])
    return attach.virtual(
        _customers(spark, folder), ["c_custkey"],
        {
            "orderCount": "SELECT count(*) AS n FROM orders WHERE o_custkey = :c_custkey",
            "nationName": "SELECT n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = :c_custkey",
            "lastOrder": "SELECT max(o_orderdate) AS d FROM orders WHERE o_custkey = :c_custkey",
        },
    )


@query("action_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 500")
def action_rows(spark, folder):
    register_views(tables(spark, folder), ["orders"])
    return attach.action(
        spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :c_custkey ORDER BY o_orderkey", {"c_custkey": 7}
    )


@query("action_all", f"SELECT {_cust} AS subject, CAST(c_custkey AS VARCHAR) AS c_custkey, o_orderkey, o_orderstatus "
                     "FROM customer JOIN orders ON o_custkey = c_custkey")
def action_all(spark, folder):
    register_views(tables(spark, folder), ["orders"])
    return attach.action_all(
        _customers(spark, folder), ["c_custkey"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = :c_custkey"
    )


@query("dataset_rows", f"""
SELECT subject, o_orderkey, o_totalprice, position FROM (
 SELECT {_cust} AS subject, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS position
 FROM customer JOIN orders ON o_custkey = c_custkey) WHERE position <= 5""")
def dataset_rows(spark, folder):
    found = attach.dataset(
        _customers(spark, folder), ["c_custkey"], tables(spark, folder)("orders"), ["o_custkey"], limit=5
    )
    return found.select("subject", "o_orderkey", "o_totalprice", "position")


# Buyers of the orders table seen as a graph of their own.
_BUYERS = Mapping("http://sales.example/", (ClassMap("http://sales.example/ns#Buyer", query="SELECT DISTINCT o_custkey, 'buyer ' || o_custkey AS name FROM orders",
                                                     key=("o_custkey",), attributes=(Attribute("http://sales.example/ns#name", "name"),)),))


@query("bridge", f"""
SELECT {_cust} AS subject, 'http://sales.example/Buyer/' || c_custkey AS target, c_custkey IN (SELECT o_custkey FROM orders) AS "exists",
 CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer ' || c_custkey END AS label FROM customer""")
def bridge(spark, folder):
    register_views(tables(spark, folder), ["orders"])
    target = triples.build(spark, _BUYERS, tables(spark, folder))
    return attach.bridge(
        _customers(spark, folder), shop.MAPPING, shop.CUSTOMER, target, _BUYERS, "http://sales.example/ns#Buyer"
    )


# -- keys ----------------------------------------------------------------------------------------------------------------

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _all(spark, folder, names=_TABLES):
    resolve = tables(spark, folder)
    return {t: resolve(t) for t in names}


_key_columns = {
    "region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"),
    "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey",), "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"),
}


@query("key_evidence", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS \"distinct\", "
    f"count(*) = count(DISTINCT {c}) AS \"unique\" FROM {t}" for t, cs in _key_columns.items() for c in cs))
def key_evidence(spark, folder):
    return keys.key_evidence(_all(spark, folder))


_refs = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
         ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
         ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
         ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


@query("reference_evidence", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{r}' AS ref_table, '{k}' AS ref_column, count(DISTINCT {c}) AS \"distinct\", "
    f"count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT {k} FROM {r})) AS contained, "
    f"round(count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT {k} FROM {r})) / count(DISTINCT {c}), 4) AS share FROM {t}"
    for t, c, r, k in _refs))
def reference_evidence(spark, folder):
    found = {t: c[0] for t, c in _key_columns.items() if t != "lineitem"}
    return keys.reference_evidence(_all(spark, folder), found)


_one_key = {t: c[0] for t, c in _key_columns.items() if t != "lineitem"}
_points = {t: [(c, r, k) for x, c, r, k in _refs if x == t] for t in _key_columns}


def _found_sql(t: str) -> str:
    key = f"CASE WHEN (SELECT count(*) = count(DISTINCT {_one_key[t]}) FROM {t}) THEN '{_one_key[t]}' END" if t in _one_key else "'" + ",".join(c for c, _, _ in _points[t]) + "'"
    held = [f"CASE WHEN NOT EXISTS (SELECT 1 FROM {t} WHERE {c} NOT IN (SELECT {k} FROM {r})) THEN '{c}->{r}' END" for c, r, k in sorted(_points[t])]
    return f"SELECT '{t}' AS \"table\", {key} AS key, concat_ws(';', {', '.join(held) or 'NULL'}) AS foreign_keys"


@query("keys_discovered", " UNION ALL ".join(map(_found_sql, _key_columns)))
def keys_discovered(spark, folder):
    found = keys.discover(_all(spark, folder))
    rows = [(t, ",".join(k.key), ";".join(f"{','.join(f.columns)}->{f.table}" for f in k.foreign)) for t, k in found.items()]
    return spark.createDataFrame(rows, "table string, key string, foreign_keys string")


@query("auto_graph")
def auto_graph(spark, folder):
    _, found = keys.auto_graph(spark, _all(spark, folder), namespace="http://auto.example/ns#", base_iri="http://auto.example/")
    return found.groupBy("predicate", "object_type").agg(F.count("*").alias("n"))


# -- schemas ------------------------------------------------------------------------------------------------------------------

def _changed(spark, folder):
    """Customer one release later: a column gone, one new, one of another type."""
    customer = tables(spark, folder)("customer")
    return customer.drop("c_mktsegment").withColumn("c_tier", F.lit("x")).withColumn("c_acctbal", F.col("c_acctbal").cast("string"))


@query("schema_diff")
def schema_diff(spark, folder):
    resolve = tables(spark, folder)
    old = drift.snapshot(spark, {"customer": resolve("customer"), "nation": resolve("nation")})
    new = drift.snapshot(spark, {"customer": _changed(spark, folder)})
    return drift.schema_diff(old, new)


@query("mapping_drift")
def mapping_drift(spark, folder):
    old = drift.snapshot(spark, _all(spark, folder, (*_TABLES, "events")))
    now = {**_all(spark, folder, (*_TABLES, "events")), "customer": _changed(spark, folder)}
    now.pop("supplier")
    return drift.mapping_drift(shop.MAPPING, drift.snapshot(spark, now), old)


# -- building --------------------------------------------------------------------------------------------------------------------

_PER_PREDICATE = "SELECT source_table, predicate, count(*) AS n FROM ({}) GROUP BY ALL"


def _counted(graph):
    return graph.groupBy("source_table", "predicate").agg(F.count("*").alias("n"))


@query("build_full", _PER_PREDICATE.format(facts_sql()))
def build_full(spark, folder):
    store = GraphStore(spark, Scratch(spark, "graph").folder)
    build.build(spark, shop.MAPPING, tables(spark, folder), store)
    return _counted(store.read())


def _rebuilt(spark, folder):
    """Build, let the customers change, build again."""
    scratch = Scratch(spark, "graph")
    store, resolve = GraphStore(spark, f"{scratch.folder}/store"), tables(spark, folder)
    build.build(spark, shop.MAPPING, resolve, store)
    resolve("customer").where("c_acctbal >= 0").write.parquet(f"{scratch.folder}/customer")
    later = replace(resolve, moved={"customer": f"{scratch.folder}/customer"})
    return store, build.build(spark, shop.MAPPING, later, store)


@query("build_incremental", _PER_PREDICATE.format(
    f"SELECT * FROM ({facts_sql()}) WHERE source_table <> 'customer' OR subject IN "
    f"(SELECT {iri_sql('Customer', 'c_custkey')} FROM customer WHERE c_acctbal >= 0)"))
def build_incremental(spark, folder):
    """Only the changed table's triples are read anew."""
    store, report = _rebuilt(spark, folder)
    if report.plan.changed != ("customer",):
        raise AssertionError(f"expected only customer to be read, not {report.plan.changed}")
    return _counted(store.read())


@query("build_report", f"""
WITH t AS ({facts_sql()}), c AS (SELECT count(*) AS n FROM t WHERE source_table = 'customer' AND subject IN
  (SELECT {iri_sql('Customer', 'c_custkey')} FROM customer WHERE c_acctbal >= 0)), o AS (SELECT count(*) AS n FROM t WHERE source_table <> 'customer')
SELECT 1 AS position, 'plan' AS step, 'incremental' AS state, 'signatures compared' AS detail, 1 AS rows
UNION ALL SELECT 2, 'drift', 'checked', 'columns the mapping reads', 0
UNION ALL SELECT 3, 'load', 'done', 'customer', n FROM c
UNION ALL SELECT 4, 'finalize', 'done', '7 table(s) left as they lie', c.n + o.n FROM c, o""")
def build_report(spark, folder):
    return _rebuilt(spark, folder)[1].steps


@query("published_view", _PER_PREDICATE.format(facts_sql()))
def published_view(spark, folder):
    """The whole graph as a view of the catalogue, read by name from a session of its own."""
    resolve = tables(spark, folder)
    name = "shop_triples_" + uuid.uuid4().hex[:12]
    statement.create_view(spark, name, shop.MAPPING, lambda t: resolve(t).schema, lambda t: f"parquet.`{resolve.location(t)}`")
    return _counted(spark.newSession().table(name))
