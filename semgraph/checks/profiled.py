"""Profiles of the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semgraph.checks.registry import query, tables
from semgraph.functions.scratch import Scratch
from semgraph.operators import sketches
from semgraph.operators.profile import peaks, profile
from semgraph.operators.quantiles import exact_quantiles

NUMERIC = {
    "customer": ("c_custkey", "c_nationkey", "c_acctbal"),
    "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
    "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "events": ("event_id", "user_id", "value"),
}
TEXT = {
    "customer": ("c_name", "c_mktsegment"), "part": ("p_name", "p_brand", "p_type"),
    "orders": ("o_orderstatus", "o_orderpriority"), "documents": ("lang", "source", "text"),
}
KEYS = {"customer": ("c_custkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")}


def _facts(spark, folder, table, columns, *wanted):
    df = tables(spark, folder)(table).select(*columns)
    return profile(df, table=table, exact=True, duplicates=False).column_facts.select(*wanted)


def _numeric_sql(table: str, column: str) -> str:
    r = lambda e: f"round({e}, 4) + 0.0"
    return f"""SELECT '{column}' AS "column", nn AS non_null, total - nn AS nulls, d AS "distinct",
 CAST(lo AS VARCHAR) AS min, CAST(hi AS VARCHAR) AS max, {r('m')} AS mean, {r('s')} AS std,
 {r('1.96 * s / sqrt(nn)')} AS mean_ci, {r('q1')} AS q1, {r('q2')} AS median, {r('q3')} AS q3,
 {r('z / nn')} AS zeros_rate, {r('h / nn')} AS heaped_rate,
 {r('CASE WHEN v <= 1e-12 THEN 0 ELSE c3 / pow(v, 1.5) END')} AS skew,
 {r('CASE WHEN v <= 1e-12 THEN 0 ELSE c4 / (v * v) - 3 END')} AS kurtosis,
 {r('CASE WHEN nn >= 3 THEN exp(-nn / 12.0 * CASE WHEN v <= 1e-12 THEN 0 ELSE pow(c3 / pow(v, 1.5), 2) + pow(c4 / (v * v) - 3, 2) / 4 END) END')} AS normal_p,
 (SELECT count(*) FROM {table} WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT count(*) AS total, count(x) AS nn, count(DISTINCT x) AS d, min(x0) AS lo, max(x0) AS hi, any_value(m) AS m, stddev_samp(x) AS s,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
  count(*) FILTER (WHERE x = 0) AS z, count(*) FILTER (WHERE x % 5 = 0) AS h,
  avg((x - m) * (x - m)) AS v, avg(pow(x - m, 3)) AS c3, avg(pow(x - m, 4)) AS c4
 FROM (SELECT {column} AS x0, CAST({column} AS DOUBLE) AS x, avg(CAST({column} AS DOUBLE)) OVER () AS m FROM {table}))"""


def _register_numeric(table: str, columns: tuple[str, ...]) -> None:
    sql = "\nUNION ALL ".join(_numeric_sql(table, c) for c in columns)

    @query(f"profile_numeric_{table}", sql)
    def run(spark, folder):
        return _facts(
            spark, folder, table, columns, "column", "non_null", "nulls", "distinct", "min", "max", "mean", "std",
            "mean_ci", "q1", "median", "q3", "zeros_rate", "heaped_rate", "skew", "kurtosis", "normal_p", "outliers",
        )


def _text_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", nn AS non_null, d AS "distinct", top,
 round(n / CASE WHEN d <= 50 THEN nn ELSE total END, 4) AS top_share, round(d / total, 4) AS unique_pct,
 CASE WHEN d <= 50 THEN (SELECT abs(round(-sum(c / nn * log2(c / nn)), 4)) FROM (SELECT count({column}) AS c FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})) END AS balance
FROM (SELECT count(*) AS total, count({column}) AS nn, count(DISTINCT {column}) AS d FROM {table}),
 (SELECT {column} AS top, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY n DESC, top LIMIT 1)"""


def _register_text(table: str, columns: tuple[str, ...]) -> None:
    sql = "\nUNION ALL ".join(_text_sql(table, c) for c in columns)

    @query(f"profile_text_{table}", sql)
    def run(spark, folder):
        return _facts(
            spark, folder, table, columns, "column", "non_null", "distinct", "top", "top_share", "unique_pct", "balance"
        )


for _table, _columns in NUMERIC.items():
    _register_numeric(_table, _columns)
for _table, _columns in TEXT.items():
    _register_text(_table, _columns)


def _histogram_sql(table: str, column: str) -> str:
    edge = lambda b: f"(lo + (hi - lo) * {b} / 10)"
    last = "CASE WHEN b = 9 THEN x <= " + edge("CAST(b + 1 AS DOUBLE)") + " ELSE x < " + edge("CAST(b + 1 AS DOUBLE)") + " END"
    return f"""SELECT '{column}' AS "column", b AS bin, round({edge('CAST(b AS DOUBLE)')}, 4) + 0.0 AS lo, round({edge('CAST(b + 1 AS DOUBLE)')}, 4) + 0.0 AS hi,
 (SELECT count(*) FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {table}) WHERE x >= {edge('CAST(b AS DOUBLE)')} AND {last}) AS n
FROM (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {table}), range(10) r(b)"""


@query("profile_histogram", "\nUNION ALL ".join(
    _histogram_sql(t, c) for t, c in (("orders", "o_totalprice"), ("orders", "o_custkey"))))
def profile_histogram(spark, folder):
    found = _facts(spark, folder, "orders", ("o_totalprice", "o_custkey"), "column", "histogram")
    rows = found.select("column", F.posexplode("histogram").alias("bin", "h"))
    return rows.select("column", F.col("bin").cast("bigint").alias("bin"), "h.lo", "h.hi", "h.n")


@query("profile_values", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def profile_values(spark, folder):
    found = _facts(spark, folder, "orders", ("o_orderstatus", "o_orderpriority"), "column", "values")
    return found.select("column", F.inline("values"))


@query("profile_peaks")
def profile_peaks(spark, folder):
    found = _facts(spark, folder, "orders", ("o_totalprice", "o_custkey", "o_orderkey"), "column", "histogram")
    return found.select("column", peaks(F.col("histogram")["n"]).alias("peaks"))


@query("profile_roles", """
SELECT 'c_custkey' AS "column", CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'row key' ELSE 'feature' END AS role,
  CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'numeric id' ELSE 'numeric' END AS kind FROM customer
UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) = 2 THEN 'binary' ELSE 'feature' END, 'categorical' FROM customer
UNION ALL SELECT 'c_acctbal', CASE WHEN count(DISTINCT c_acctbal) = count(*) THEN 'row key' WHEN count(DISTINCT c_acctbal) = 2 THEN 'binary' ELSE 'feature' END, 'numeric' FROM customer""")
def profile_roles(spark, folder):
    return _facts(spark, folder, "customer", ("c_custkey", "c_mktsegment", "c_acctbal"), "column", "role", "kind")


@query("profile_hints")
def profile_hints(spark, folder):
    found = _facts(spark, folder, "part", ("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"), "column", "hints")
    return found.select("column", F.array_join("hints", " ").alias("hints"))


def _register_table(table: str, key: tuple[str, ...]) -> None:
    keys = ", ".join(key)

    @query(f"profile_table_{table}", f"""
SELECT '{table}' AS "table", (SELECT count(*) FROM {table}) AS row_count, CAST(0 AS DOUBLE) AS missing_cells,
 (SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table})) AS duplicate_keys,
 (SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_rows,
 '{"|".join(key)}' AS row_key""")
    def run(spark, folder):
        df = tables(spark, folder)(table)
        facts = profile(df, table=table, key=key).table_facts
        return facts.select(
            "table", "row_count", "missing_cells", "duplicate_keys", "duplicate_rows",
            F.array_join("row_key", "|").alias("row_key"),
        )


for _table, _key in KEYS.items():
    _register_table(_table, _key)


_EDGE = "CASE WHEN l_returnflag = 'R' AND l_quantity = 1 THEN 0 ELSE l_quantity END"


@query("profile_distinct_edge", f"""
SELECT 'q' AS "column", count(DISTINCT v) AS "distinct", count(DISTINCT v) <= 50 AS listed,
 (SELECT round(-sum(p * log2(p)), 4) FROM (SELECT count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY {_EDGE})) AS entropy
FROM (SELECT {_EDGE} AS v FROM lineitem)""".replace("AS entropy", "* CASE WHEN count(DISTINCT v) <= 50 THEN 1 END AS entropy"))
def profile_distinct_edge(spark, folder):
    """A column with one value more than a list shows: counted all the same."""
    df = tables(spark, folder)("lineitem").select(F.expr(_EDGE).alias("q"))
    found = profile(df, table="lineitem", duplicates=False).column_facts
    return found.select("column", "distinct", F.col("values").isNotNull().alias("listed"), F.col("balance").alias("entropy"))


def _register_default(table: str, columns: tuple[str, ...]) -> None:
    @query(f"profile_default_{table}", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls, false AS sampled FROM {table}" for c in columns))
    def run(spark, folder):
        return profile(tables(spark, folder)(table), table=table).column_facts.select("column", "non_null", "nulls", "sampled")


_register_default("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
_register_default("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query("profile_sampled")
def profile_sampled(spark, folder):
    df = tables(spark, folder)("lineitem").select("l_quantity", "l_discount", "l_returnflag")
    found = profile(df, table="lineitem", fraction=0.1, duplicates=False)
    return found.column_facts.select("column", "non_null", "distinct", "mean", "median", "role", "kind")


@query("quantiles_exact", """
SELECT l_returnflag, p, quantile FROM (
 SELECT l_returnflag, 0.1 AS p, quantile_cont(l_extendedprice, 0.1) AS quantile FROM lineitem GROUP BY 1
 UNION ALL SELECT l_returnflag, 0.5, quantile_cont(l_extendedprice, 0.5) FROM lineitem GROUP BY 1
 UNION ALL SELECT l_returnflag, 0.9, quantile_cont(l_extendedprice, 0.9) FROM lineitem GROUP BY 1)""".replace(
    "p, quantile FROM (", "CAST(p AS DOUBLE) AS p, round(quantile, 4) AS quantile FROM ("))
def quantiles_exact(spark, folder):
    rows = tables(spark, folder)("lineitem").select("l_returnflag", "l_extendedprice")
    found = exact_quantiles(rows, "l_returnflag", "l_extendedprice", (0.1, 0.5, 0.9))
    return found.withColumn("quantile", F.round("quantile", 4))


# -- sketches ------------------------------------------------------------------------------------------------------

_LATER = "SELECT * FROM orders WHERE o_orderpriority <> '5-LOW' OR o_totalprice < 100000"
_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("sketches_refreshed", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, true AS distinct_near, true AS quantiles_near, "
    f"{f'CAST(min({c}) AS DOUBLE)' if c in ('o_orderkey', 'o_custkey', 'o_totalprice') else 'CAST(NULL AS DOUBLE)'} AS least FROM ({_LATER})"
    for c in _ORDER_COLUMNS))
def sketches_refreshed(spark, folder):
    """Sketch orders by priority, let one priority change, sketch that one again: all together tell of the new table what it holds,
    estimates within their stated errors."""
    place = Scratch(spark, "sketches").folder
    orders = tables(spark, folder)("orders").select(*_ORDER_COLUMNS, "o_orderpriority")
    sketches.save(sketches.sketches(orders, "o_orderpriority"), place)
    later = orders.where("o_orderpriority <> '5-LOW' OR o_totalprice < 100000")
    found = sketches.refresh(later, "o_orderpriority", ["5-LOW"], place)
    rows = found.collect()  # one a column
    exact = later.agg(*[F.countDistinct(r["column"]).alias(r["column"]) for r in rows]).first()
    ranks = later.agg(*[
        F.avg((F.col(r["column"]) <= F.lit(r[q])).cast("double")).alias(f"{r['column']}:{q}")
        for r in rows if r["kind"] == "numeric" for q in ("q1", "median", "q3")]).first()
    share = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    near = [
        (r["column"], r["rows"], r["nulls"], abs(r["distinct"] - exact[r["column"]]) <= 3 * sketches.DISTINCT_ERROR * exact[r["column"]],
         r["kind"] != "numeric" or all(abs(ranks[f"{r['column']}:{q}"] - p) <= 2 * sketches.RANK_ERROR for q, p in share.items()), r["min"])
        for r in rows
    ]
    return spark.createDataFrame(near, "column string, rows bigint, nulls bigint, distinct_near boolean, quantiles_near boolean, least double")
