"""Data-quality rules over the sample tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.checks.registry import query, tables
from semgraph.operators import dq
from semgraph.operators.dq import DqRule
from semgraph.operators.profile import profile

AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)
NOW = "TIMESTAMP '2024-01-20 12:00:00'"

# The sample tables hold neither gaps nor dangling keys; the same changes give both engines some.
GAPS_SQL = """SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN '  ' WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_mktsegment END AS note,
 CASE WHEN c_acctbal < 0 THEN c_nationkey + 1000 WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS nationkey,
 CASE WHEN c_acctbal < 0 THEN c_name ELSE lower(c_name) || '@mail.example' END AS contact,
 CASE WHEN c_acctbal < 0 THEN '10.0.0.300' ELSE '10.0.' || c_nationkey || '.7' END AS host,
 CASE WHEN c_acctbal < 0 THEN 'none' ELSE substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4)
   || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) END AS token FROM customer"""


def _gaps(spark, folder) -> DataFrame:
    tables(spark, folder)("customer").createOrReplaceTempView("customer")
    return spark.sql(GAPS_SQL)


def _table(spark, folder, name: str) -> DataFrame:
    return _gaps(spark, folder) if name == "gaps" else tables(spark, folder)(name)


def _from(name: str) -> str:
    return f"({GAPS_SQL})" if name == "gaps" else name


def _shown(results: DataFrame) -> DataFrame:
    return results.select("rule", "kind", "dimension", F.round("pass_rate", 9).alias("pass_rate"), "passed", "failed",
                          "total", "status")


def _status(rate: str, threshold: float) -> str:
    return (
        f"CASE WHEN {rate} IS NULL THEN 'error' WHEN {rate} >= {threshold} THEN 'passing' "
        f"WHEN {rate} >= {threshold} - 0.15 THEN 'warning' ELSE 'failing' END"
    )


def _result(rule: DqRule, table: str, rate: str, failed: str, total: str = "count(*)") -> str:
    return f"""SELECT '{rule.name}' AS rule, '{rule.kind}' AS kind, '{rule.quality}' AS dimension, round(rate, 9) AS pass_rate,
 total - failed AS passed, failed, total, {_status('rate', rule.threshold)} AS status
FROM (SELECT CAST({rate} AS DOUBLE) AS rate, CAST({failed} AS BIGINT) AS failed, {total} AS total FROM {_from(table)})"""


def _row_sql(rule: DqRule, table: str, good: str) -> str:
    return _result(
        rule, table, f"count(*) FILTER (WHERE {good}) / count(*)", f"count(*) - count(*) FILTER (WHERE {good})"
    )


RULES: dict[str, tuple[str, DqRule, str]] = {}


def _row_rule(table: str, rule: DqRule, good: str) -> None:
    """A rule over rows, with the condition a good row meets in SQL."""
    RULES[rule.name] = (table, rule, _row_sql(rule, table, good))


def _table_rule(table: str, rule: DqRule, rate: str, failed: str = "NULL") -> None:
    RULES[rule.name] = (table, rule, _result(rule, table, rate, failed))


_row_rule("gaps", DqRule("not_null", "not_null", "segment"), "segment IS NOT NULL")
_row_rule("gaps", DqRule("not_empty", "not_empty", "note"), "note IS NOT NULL AND trim(note) <> ''")
_table_rule("orders", DqRule("unique", "unique", "o_custkey"), "count(DISTINCT o_custkey) / count(o_custkey)",
            "count(o_custkey) - count(DISTINCT o_custkey)")
_table_rule("lineitem", DqRule("unique_pair", "unique", None, {"columns": ["l_orderkey", "l_linenumber"]}, 0.9),
            "count(DISTINCT (l_orderkey, l_linenumber)) / count(*)", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))")
_row_rule("gaps", DqRule("in_set", "in_set", "segment", {"values": ["AUTOMOBILE", "MACHINERY"]}),
          "segment IS NULL OR segment IN ('AUTOMOBILE', 'MACHINERY')")
_row_rule("gaps", DqRule("not_in_set", "not_in_set", "segment", {"values": ["HOUSEHOLD"]}, 0.7),
          "segment IS NULL OR segment NOT IN ('HOUSEHOLD')")
_row_rule("lineitem", DqRule("range", "range", "l_quantity", {"min": 5, "max": 45}),
          "l_quantity IS NULL OR l_quantity BETWEEN 5 AND 45")
_row_rule("lineitem", DqRule("not_in_range", "not_in_range", "l_discount", {"min": 0.03, "max": 0.04}, 0.8),
          "l_discount IS NULL OR l_discount < 0.03 OR l_discount > 0.04")
_row_rule("orders", DqRule("equal_to", "equal_to", "o_orderstatus", {"value": "O"}, 0.4),
          "o_orderstatus IS NULL OR o_orderstatus = 'O'")
_row_rule("gaps", DqRule("not_equal_to", "not_equal_to", "nationkey", {"value": 3}),
          "nationkey IS NULL OR nationkey <> 3")
_row_rule("gaps", DqRule("not_less_than", "not_less_than", "c_acctbal", {"limit": 0}), "c_acctbal IS NULL OR c_acctbal >= 0")
_row_rule("part", DqRule("not_greater_than", "not_greater_than", "p_size", {"limit": 40}), "p_size IS NULL OR p_size <= 40")
_row_rule("customer", DqRule("regex", "regex", "c_name", {"pattern": "[02468]$"}), "c_name IS NULL OR regexp_matches(c_name, '[02468]$')")
for _kind, _column in (("valid_email", "contact"), ("valid_uuid", "token"), ("valid_ipv4", "host")):
    _row_rule("gaps", DqRule(_kind, _kind, _column, threshold=0.9),
              f"{_column} IS NULL OR regexp_matches({_column}, '{dq.PATTERNS[_kind]}')")
for _kind, _column in (("valid_date", "o_orderdate"), ("valid_timestamp", "o_orderdate")):
    _row_rule("orders", DqRule(_kind, _kind, _column),
              f"regexp_matches(CAST({_column} AS VARCHAR), '{dq.PATTERNS[_kind]}')")
_row_rule("gaps", DqRule("string_case", "string_case", "contact", {"case": "lower"}), "contact IS NULL OR contact = lower(contact)")
_row_rule("documents", DqRule("length_between", "length_between", "text", {"min": 100, "max": 5000}, 0.6),
          "text IS NULL OR length(text) BETWEEN 100 AND 5000")
_row_rule("events", DqRule("not_in_future", "not_in_future", "ts", threshold=0.6), f"ts IS NULL OR ts <= {NOW}")
_row_rule("events", DqRule("older_than_days", "older_than_days", "ts", {"days": 7}, 0.5),
          f"ts IS NULL OR ts <= {NOW} - INTERVAL 168 HOUR")
_row_rule("shipped", DqRule("older_than_column", "older_than_column", "o_orderdate", {"column2": "l_shipdate", "days": 2}, 0.5),
          "o_orderdate IS NULL OR l_shipdate IS NULL OR o_orderdate <= l_shipdate - INTERVAL 2 DAY")
_row_rule("gaps", DqRule("referential", "referential", "nationkey", {"ref_table": "nation", "ref_column": "n_nationkey"}, 0.97),
          "nationkey IS NULL OR nationkey IN (SELECT n_nationkey FROM nation)")
_row_rule("gaps", DqRule("referential_filtered", "referential", "nationkey",
                         {"ref_table": "nation", "ref_column": "n_nationkey", "filter": "segment = 'AUTOMOBILE'"}, 0.97),
          "NOT coalesce(segment = 'AUTOMOBILE', true) OR nationkey IS NULL OR nationkey IN (SELECT n_nationkey FROM nation)")
_table_rule("events", DqRule("freshness", "freshness", "ts", {"hours": 24}),
            f"CASE WHEN max(ts) >= {NOW} - INTERVAL 24 HOUR THEN 1.0 ELSE 0.0 END")
_table_rule("orders", DqRule("row_count", "row_count", None, {"min": 1000, "max": 10_000_000_000}),
            "CASE WHEN count(*) BETWEEN 1000 AND 10000000000 THEN 1.0 ELSE 0.0 END")
_table_rule("orders", DqRule("aggregate", "aggregate", None, {"aggr": "avg", "column": "o_totalprice", "op": ">", "limit": 1000.0}),
            "CASE WHEN avg(o_totalprice) > 1000 THEN 1.0 ELSE 0.0 END")
_table_rule("orders", DqRule("aggregate_distinct", "aggregate", None,
                             {"aggr": "count_distinct", "column": "o_orderpriority", "op": "=", "limit": 5}),
            "CASE WHEN count(DISTINCT o_orderpriority) = 5 THEN 1.0 ELSE 0.0 END")
_row_rule("lineitem", DqRule("custom", "custom", None, {"predicate": "l_extendedprice * (1 - l_discount) > 10000"}, 0.8),
          "l_extendedprice * (1 - l_discount) > 10000")
_row_rule("lineitem", DqRule("custom_filtered", "custom", None,
                             {"predicate": "l_tax < 0.05", "filter": "l_returnflag = 'R'"}, 0.8),
          "NOT (l_returnflag = 'R') OR l_tax < 0.05")

_SHIPPED = "(SELECT o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _input(spark, folder, name: str) -> DataFrame:
    if name != "shipped":
        return _table(spark, folder, name)
    resolve = tables(spark, folder)
    orders = resolve("orders").select("o_orderkey", "o_orderdate")
    lines = resolve("lineitem").select("l_orderkey", "l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", "l_shipdate")


def _register_rule(table: str, rule: DqRule, sql: str) -> None:
    @query(f"dq_{rule.name}", sql.replace("FROM shipped)", f"FROM {_SHIPPED})"))
    def run(spark, folder):
        return _shown(dq.evaluate(_input(spark, folder, table), [rule], tables(spark, folder), AS_OF))


for _table_name, _rule, _sql in list(RULES.values()):
    _register_rule(_table_name, _rule, _sql)


# -- many rules at once -----------------------------------------------------------------------------------------

_of = lambda table: [r for t, r, _ in RULES.values() if t == table]
_sqls = lambda table: " UNION ALL ".join(f"({s})" for t, _, s in RULES.values() if t == table)


@query("dq_run", _sqls("gaps"))
def dq_run(spark, folder):
    return _shown(dq.evaluate(_gaps(spark, folder), _of("gaps"), tables(spark, folder), AS_OF))


@query("dq_run_isolated", _sqls("lineitem") + """ UNION ALL
SELECT 'no_such_column', 'custom', 'validity', NULL, NULL, NULL, NULL, 'error'
UNION ALL SELECT 'fails_on_data', 'custom', 'validity', NULL, NULL, NULL, NULL, 'error'""")
def dq_run_isolated(spark, folder):
    broken = [
        DqRule("no_such_column", "custom", None, {"predicate": "l_colour = 'red'"}),
        DqRule("fails_on_data", "custom", None, {"predicate": "CAST(l_returnflag AS INT) > 0"}),
    ]
    return _shown(dq.run(tables(spark, folder)("lineitem"), _of("lineitem") + broken, tables(spark, folder), AS_OF))


@query("dq_score", f"SELECT round(avg(pass_rate), 4) AS score FROM ({_sqls('gaps')})")
def dq_score(spark, folder):
    return dq.score(dq.evaluate(_gaps(spark, folder), _of("gaps"), tables(spark, folder), AS_OF))


def _rule(name: str) -> DqRule:
    return RULES[name][1]


@query("dq_failing_range", "SELECT * FROM lineitem WHERE NOT (l_quantity BETWEEN 5 AND 45)")
def dq_failing_range(spark, folder):
    return dq.failing_rows(tables(spark, folder)("lineitem"), _rule("range"), limit=None)


@query("dq_failing_unique", "SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN "
                            "(SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dq_failing_unique(spark, folder):
    return dq.failing_rows(tables(spark, folder)("lineitem"), _rule("unique_pair"), limit=None)


@query("dq_failing_referential", f"SELECT * FROM ({GAPS_SQL}) WHERE nationkey IS NOT NULL AND nationkey NOT IN (SELECT n_nationkey FROM nation)")
def dq_failing_referential(spark, folder):
    return dq.failing_rows(_gaps(spark, folder), _rule("referential"), tables(spark, folder), limit=None)


_unsure = DqRule("unsure", "range", "l_quantity", {"min": 5, "max": 45, "filter": "nullif(l_returnflag, 'N') = 'R'"})
_unsure_sql = "count(*) FILTER (NOT coalesce(NOT (nullif(l_returnflag, 'N') = 'R') OR l_quantity BETWEEN 5 AND 45, false))"


@query("dq_null_filter", f"SELECT way, {_unsure_sql} AS n FROM lineitem, (VALUES ('counted'), ('flagged'), ('listed')) w(way) GROUP BY way")
def dq_null_filter(spark, folder):
    """A filter that is NULL leaves no way out: counts, flags and rows agree on it."""
    df = tables(spark, folder)("lineitem")
    counted = dq.evaluate(df, [_unsure]).select(F.lit("counted").alias("way"), F.col("failed").alias("n"))
    flagged = dq.flag_rows(df, [_unsure]).agg(F.count_if(F.size("failed_rules") > 0).alias("n"))
    listed = dq.failing_rows(df, _unsure).agg(F.count("*").alias("n"))
    return counted.union(flagged.select(F.lit("flagged"), "n")).union(listed.select(F.lit("listed"), "n"))


@query("dq_failing_sample", "SELECT * FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND NOT l_tax < 0.05 ORDER BY ALL LIMIT 20)")
def dq_failing_sample(spark, folder):
    return dq.failing_rows(tables(spark, folder)("lineitem"), _rule("custom_filtered"), limit=20)


_flags = [_rule(n) for n in ("not_null", "not_empty", "in_set", "not_less_than", "valid_email", "referential")]
_flag_sql = f"""
SELECT c_custkey, concat_ws('|', CASE WHEN segment IS NULL THEN 'not_null' END,
 CASE WHEN note IS NULL OR trim(note) = '' THEN 'not_empty' END,
 CASE WHEN segment NOT IN ('AUTOMOBILE', 'MACHINERY') THEN 'in_set' END,
 CASE WHEN c_acctbal < 0 THEN 'not_less_than' END,
 CASE WHEN NOT regexp_matches(contact, '{dq.PATTERNS['valid_email']}') THEN 'valid_email' END,
 CASE WHEN nationkey NOT IN (SELECT n_nationkey FROM nation) THEN 'referential' END) AS failed_rules
FROM ({GAPS_SQL})"""


@query("dq_flag", _flag_sql)
def dq_flag(spark, folder):
    flagged = dq.flag_rows(_gaps(spark, folder), _flags, tables(spark, folder))
    return flagged.select("c_custkey", F.array_join("failed_rules", "|").alias("failed_rules"))


@query("dq_flag_unique", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'unique_pair' ELSE '' END AS failed_rules
FROM lineitem""")
def dq_flag_unique(spark, folder):
    lines = tables(spark, folder)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    flagged = dq.flag_rows(lines, [_rule("unique_pair")])
    return flagged.withColumn("failed_rules", F.array_join("failed_rules", "|"))


@query("dq_split", f"SELECT failed_rules = '' AS good, count(*) AS n FROM ({_flag_sql}) GROUP BY 1")
def dq_split(spark, folder):
    good, bad = dq.split_rows(dq.flag_rows(_gaps(spark, folder), _flags, tables(spark, folder)))
    count = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("good"), "n")
    return count(good, True).unionByName(count(bad, False))


# -- history: every day of the events table as one run over it ------------------------------------------------

_RUNS_SQL = """SELECT 'events' AS "table", strftime(ts, '%Y-%m-%d') AS run_id, date_trunc('day', ts) AS ran_at, event_type AS rule,
 CASE WHEN event_type = 'view' THEN 'value' ELSE 'event_type' END AS "column", round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM events GROUP BY ALL"""


def _history(spark, folder) -> DataFrame:
    events = tables(spark, folder)("events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    rate = F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6)
    daily = events.groupBy(day.alias("ran_at"), F.col("event_type").alias("rule")).agg(rate.alias("pass_rate"))
    return daily.select(
        F.lit("events").alias("table"), F.date_format("ran_at", "yyyy-MM-dd").alias("run_id"), "ran_at", "rule",
        F.when(F.col("rule") == "view", "value").otherwise("event_type").alias("column"), "pass_rate",
        dq.status_of(F.col("pass_rate"), F.lit(0.8)).alias("status"),
    )


@query("dq_latest", f"""SELECT rule, run_id, pass_rate FROM ({_RUNS_SQL}) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ran_at DESC) = 1""")
def dq_latest(spark, folder):
    return dq.latest(_history(spark, folder)).select("rule", "run_id", "pass_rate")


@query("dq_rule_history", f"""SELECT rule, run_id, pass_rate, position FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ran_at DESC) AS position
 FROM ({_RUNS_SQL})) WHERE position <= 14""")
def dq_rule_history(spark, folder):
    return dq.rule_history(_history(spark, folder)).select("rule", "run_id", "pass_rate", "position")


@query("dq_run_history", f"""SELECT run_id, score, position FROM (SELECT *, row_number() OVER (ORDER BY run_id DESC) AS position
 FROM (SELECT run_id, round(avg(pass_rate), 4) AS score FROM ({_RUNS_SQL}) GROUP BY 1)) WHERE position <= 14""")
def dq_run_history(spark, folder):
    return dq.run_history(_history(spark, folder)).select("run_id", "score", "position")


@query("dq_column_scores", f"""
WITH l AS (SELECT * FROM ({_RUNS_SQL}) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ran_at DESC) = 1)
SELECT c AS "column", coalesce((SELECT round(avg(pass_rate), 4) FROM l WHERE l."column" = c), 1.0) AS score,
 CASE WHEN c IN (SELECT "column" FROM l) THEN 'rules' ELSE 'profile' END AS source
FROM (VALUES ('event_id'), ('user_id'), ('event_type'), ('value')) v(c)""")
def dq_column_scores(spark, folder):
    events = tables(spark, folder)("events").select("event_id", "user_id", "event_type", "value")
    facts = profile(events, table="events", duplicates=False).column_facts
    return dq.column_scores(dq.latest(_history(spark, folder)), facts)


def _catalog(spark):
    rules = [DqRule(n, "custom", None, {"predicate": "value > 20"}, 0.8) for n in ("view", "signup", "purchase", "click")]
    rules.append(DqRule("error", "not_null", "event_type", threshold=0.8, enabled=False))
    return dq.rule_frame(spark, {"events": rules})


@query("dq_overview", f"""
WITH h AS ({_RUNS_SQL}), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ran_at DESC) = 1)
SELECT 'events' AS "table", CAST(5 AS BIGINT) AS rules, CAST(4 AS BIGINT) AS enabled, CAST(4 AS BIGINT) AS custom_rules,
 count(*) FILTER (WHERE pass_rate >= 0.8) AS passing, count(*) FILTER (WHERE pass_rate >= 0.65 AND pass_rate < 0.8) AS warning,
 count(*) FILTER (WHERE pass_rate < 0.65) AS failing,
 (SELECT round(avg(pass_rate), 4) FROM h WHERE run_id = (SELECT max(run_id) FROM h)) AS score
FROM l WHERE rule <> 'error'""")
def dq_overview(spark, folder):
    out = dq.overview(_catalog(spark), _history(spark, folder))
    return out.select("table", "rules", "enabled", F.col("by_kind")["custom"].alias("custom_rules"), "passing", "warning",
                      "failing", "score")


_unique = "(SELECT count(*) = count(DISTINCT {0}) FROM customer)"
_suggest_sql = " UNION ALL ".join(
    [f"SELECT '{c} key is unique' AS name, 'unique' AS kind, '{c}' AS \"column\", CAST(1.0 AS DOUBLE) AS threshold WHERE {_unique.format(c)}"
     for c in ("c_custkey", "c_acctbal")]
    + [f"SELECT CASE WHEN {_unique.format(c)} THEN '{c} key is filled' ELSE '{c} is filled' END, 'not_null', '{c}', CASE WHEN {_unique.format(c)} THEN 1.0 ELSE 0.99 END" for c in ("c_custkey", "c_acctbal")]
    + [f"SELECT '{c} stays near its range', 'range', '{c}', 0.99 WHERE NOT {_unique.format(c)}" for c in ("c_custkey", "c_acctbal")]
    + ["SELECT 'c_mktsegment is filled', 'not_null', 'c_mktsegment', 0.99",
       "SELECT 'c_mktsegment keeps to its values', 'in_set', 'c_mktsegment', 0.99 WHERE (SELECT count(DISTINCT c_mktsegment) <= 12 FROM customer)"])


@query("dq_suggest", _suggest_sql)
def dq_suggest(spark, folder):
    df = tables(spark, folder)("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    facts = profile(df, table="customer", exact=True, duplicates=False).column_facts
    return dq.suggest(facts, 0).select("name", "kind", "column", "threshold")
