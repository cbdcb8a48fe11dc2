"""Profiles and data-quality rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from semgraph.operators import dq
from semgraph.operators.dq import DqRule
from semgraph.operators.profile import load_profile, peaks, profile, save_profile
from semgraph.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def facts(hr):
    return profile(hr.tables["employees"], table="employees", key=("empno",))


def test_profile_golden(facts):
    columns = {r["column"]: r for r in facts.column_facts.collect()}
    sal = columns["sal"]
    assert (sal["nulls"], sal["distinct"], sal["mean"], sal["std"]) == (1, 3, 850.0, 377.4917)
    assert (sal["q1"], sal["median"], sal["q3"], sal["outliers"]) == (650.0, 800.0, 1025.0, 0)
    assert len(sal["histogram"]) == 10 and sum(b["n"] for b in sal["histogram"]) == 3 and sal["unique_pct"] == 0.75
    name = columns["ename"]
    assert (name["distinct"], name["balance"], name["top_share"], len(name["values"])) == (4, 2.0, 0.25, 4)
    assert columns["empno"]["role"] == "row key" and columns["hired"]["kind"] == "date"
    table = facts.table_facts.first()
    assert (table["duplicate_rows"], table["duplicate_keys"], table["row_key"]) == (0, 0, ["empno"])
    assert table["missing_cells"] == round(5 / 24, 6)


def test_peaks(spark):
    lists = spark.createDataFrame([([29] * 10,), ([1, 5, 2, 7, 1],), ([1, 2, 3, 4],), ([3],)], "c array<int>")
    assert [r[0] for r in lists.select(peaks(F.col("c"))).collect()] == [0, 2, 1, 1]


def test_profile_saved_and_read_back(spark, facts, tmp_path):
    save_profile(facts, str(tmp_path), "employees")
    save_profile(facts, str(tmp_path), "employees")
    back = load_profile(spark, str(tmp_path), "employees")
    assert back.column_facts.count() == 6 and back.table_facts.first()["row_count"] == 4


def test_exact_quantiles_match_the_builtin(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.rand(7) * 100).alias("x"))
    df = df.cache()
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, "g", "x", (0.0, 0.25, 0.9, 1.0)).collect()}
    for p in (0.0, 0.25, 0.9, 1.0):
        for r in df.groupBy("g").agg(F.percentile("x", p).alias("v")).collect():
            assert got[r["g"], p] == pytest.approx(r["v"], abs=1e-9)


RULES = [
    DqRule("a", "not_null", "sal"), DqRule("b", "unique", "empno"), DqRule("c", "in_set", "deptno", {"values": [10, 20]}),
    DqRule("d", "range", "sal", {"min": 600, "max": 2000}), DqRule("e", "regex", "ename", {"pattern": "^[A-Z]+$"}),
    DqRule("f", "referential", "deptno", {"ref_table": "departments", "ref_column": "deptno"}, 0.9),
    DqRule("g", "row_count", None, {"min": 1, "max": 10}), DqRule("h", "freshness", "hired", {"hours": 24}),
]


def test_dq_golden(hr):
    got = {r["rule"]: r for r in dq.evaluate(hr.tables["employees"], RULES, hr.tables.__getitem__).collect()}
    assert {k: r["pass_rate"] for k, r in got.items()} == {
        "a": 0.75, "b": 1.0, "c": 0.75, "d": 0.75, "e": 1.0, "f": 0.75, "g": 1.0, "h": 0.0}
    assert (got["a"]["status"], got["f"]["status"], got["b"]["status"]) == ("failing", "warning", "passing")


def test_dq_isolates_broken_rules(hr):
    broken = [DqRule("x", "custom", None, {"predicate": "nothing > 1"}), DqRule("y", "custom", None, {"predicate": "1 / (empno - 1) > 0"})]
    got = {r["rule"]: r for r in dq.run(hr.tables["employees"], RULES[:3] + broken, hr.tables.__getitem__).collect()}
    assert got["x"]["status"] == got["y"]["status"] == "error" and got["y"]["error"]
    assert got["a"]["pass_rate"] == 0.75
    with pytest.raises(dq.RuleError):
        dq.run(hr.tables["employees"], [DqRule("z", "not_null", "sal", enabled=False)])


def test_dq_rows(hr):
    employees = hr.tables["employees"]
    flagged = {r["empno"]: r["failed_rules"] for r in dq.flag_rows(employees, RULES, hr.tables.__getitem__).collect()}
    assert flagged == {1: [], 2: ["a"], 3: [], 4: ["c", "d", "f"]}
    good, bad = dq.split_rows(dq.flag_rows(employees, RULES, hr.tables.__getitem__))
    assert (good.count(), bad.count()) == (2, 2)
    assert dq.failing_rows(employees, RULES[5], hr.tables.__getitem__).first()["empno"] == 4
    twice = employees.union(employees.where("empno = 1"))
    assert dq.failing_rows(twice, RULES[1]).count() == 2
    with pytest.raises(dq.RuleError):
        dq.failing_rows(employees, RULES[6])
    # A check that is NULL counts as failing and shows up among the failing rows.
    unknown = DqRule("n", "custom", None, {"predicate": "sal > 0"})
    assert dq.evaluate(employees, [unknown]).first()["failed"] == dq.failing_rows(employees, unknown).count() == 1


def test_dq_validation():
    columns = ["empno", "sal"]
    assert dq.validate(DqRule("a", "not_null", "SAL"), columns).column == "sal"
    for bad in (
        DqRule("", "not_null", "sal"), DqRule("a", "magic", "sal"), DqRule("a", "not_null"), DqRule("a", "not_null", "x"),
        DqRule("a", "in_set", "sal"), DqRule("a", "range", "sal"), DqRule("a", "unique"), DqRule("a", "not_null", "sal", threshold=0),
        DqRule("a", "custom", None, {"predicate": "1=1; drop"}), DqRule("a", "not_null", "sal", dimension="beauty"),
        DqRule("a", "aggregate", None, {"aggr": "sum", "op": ">", "limit": 1}),
    ):
        with pytest.raises(dq.RuleError):
            dq.validate(bad, columns)


def test_dq_pinned_time(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 10),), (None,)], "d date")
    now = dt.datetime(2024, 1, 9)
    rate = lambda r: dq.evaluate(df, [r], as_of=now).first()["failed"]
    assert rate(DqRule("a", "not_in_future", "d")) == 1
    assert rate(DqRule("a", "older_than_days", "d", {"days": 7})) == 1
    fresh = DqRule("a", "freshness", "d", {"hours": 24})
    assert dq.evaluate(df, [fresh], as_of=now).first()["pass_rate"] == 1.0
    empty = dq.evaluate(df.where("d IS NULL"), [fresh], as_of=now).first()
    assert empty["pass_rate"] == 0.0


def test_dq_suggestions(facts):
    rules = {(r.kind, r.column): r for r in dq.parsed_rules(dq.suggest(facts.column_facts, 4))}
    assert rules["range", "sal"].params == {"min": 425.0, "max": 1325.0}
    assert rules["range", "deptno"].params == {"min": 1.1, "max": 107.9}
    assert rules["row_count", None].params == {"min": 3, "max": 5}
    assert rules["unique", "empno"].threshold == 1.0 and ("in_set", "ename") not in rules
    left = dq.suggest(facts.column_facts, 4, existing=[("range", "SAL")])
    assert ("range", "sal") not in {(r["kind"], r["column"]) for r in left.collect()}


def test_dq_history(spark, hr, facts):
    results = dq.run(hr.tables["employees"], RULES, hr.tables.__getitem__)
    days = [dq.stamp(results, "employees", f"r{d:02d}", dt.datetime(2024, 1, d)) for d in range(1, 17)]
    history = days[0]
    for d in days[1:]:
        history = history.unionByName(d)
    history = history.cache()
    newest = dq.latest(history)
    assert newest.count() == 8 and {r["run_id"] for r in newest.collect()} == {"r16"}
    assert dq.rule_history(history).groupBy("rule").count().where("count = 14").count() == 8
    assert dq.run_history(history).count() == 14
    scores = {r["column"]: (r["score"], r["source"]) for r in dq.column_scores(newest, facts.column_facts).collect()}
    assert scores["sal"] == (0.75, "rules") and scores["manager"] == (0.5, "profile")
    assert dq.summary(newest).first()["failing"] == 4
    over = dq.overview(dq.rule_frame(spark, {"employees": RULES}), history).first()
    assert over["rules"] == 8 and over["by_kind"]["range"] == 1 and over["by_dimension"]["validity"] == 3
