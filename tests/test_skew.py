"""Joins with a key that holds nearly all rows, and results that no cap cuts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import BASE, EX
from semgraph.functions import skew
from semgraph.functions.skew import split_join
from semgraph.functions.terms import RDF_TYPE
from semgraph.operators import attach, cohorts, communities, dq, graph, rules
from semgraph.operators.cohorts import Cohort, Criterion
from semgraph.operators.dq import DqRule
from semgraph.operators.profile import profile
from semgraph.operators.rules import Atom, Rule


def lopsided(spark):
    """9,000 of 10,000 rows on one key, 200 without a key."""
    key = F.when(F.col("id") < 9000, 1).when(F.col("id") >= 9800, None).otherwise(F.col("id") % 50 + 2)
    return spark.range(10_000).select("id", key.cast("int").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_a_join(spark, how):
    big = lopsided(spark)
    small = spark.range(0, 60, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v")).union(
        spark.createDataFrame([(1, 7)], "k int, v long"))
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert rows(split_join(big, small, ["k"], how, least=100)) == rows(big.join(small, ["k"], how))


def test_a_hot_key_is_dealt_over_tasks(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = lopsided(spark)
        small = big.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
        share = lambda df: max(len(rows) for rows in df.rdd.glom().collect()) / 10_000
        assert share(big.join(small, ["k"], "left")) >= 0.9
        assert share(split_join(big, small, ["k"], "left", least=100)) < 0.45
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_profiles_are_whole(spark):
    df = spark.range(3000).select("id", (F.col("id") % 51).alias("v"), *[(F.col("id") % 3).alias(f"c{i}") for i in range(61)])
    found = profile(df, table="t")
    rows = {r["column"]: r for r in found.column_facts.collect()}
    assert rows["v"]["distinct"] == 51 and rows["v"]["values"] is None and rows["id"]["role"] == "row key"
    assert all(len(rows[f"c{i}"]["values"]) == 3 for i in range(61)) and not rows["v"]["sampled"]
    assert found.table_facts.first()["duplicate_rows"] == 0
    part = profile(df.select("id", "v"), table="t", fraction=0.5)
    assert part.table_facts.first()["sampled"] and part.table_facts.first()["duplicate_rows"] is None
    assert {r["role"] for r in part.column_facts.collect()} == {"feature"}


def test_true_share(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "b boolean")
    assert profile(df, table="t").column_facts.first()["true_share"] == 0.6667


def people(spark, names):
    rows = [(f"http://x/{i}", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", EX + "T", "iri") for i in names]
    rows += [(f"http://x/{i}", "http://www.w3.org/2000/01/rdf-schema#label", n, "literal") for i, n in names.items()]
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, "subject string, predicate string, object string, object_type string").select(
        "*", none.alias("datatype"), none.alias("lang"), F.lit(False).alias("inferred"), none.alias("source_table"))


def test_values_are_resolved_among_all_hits(spark):
    found = people(spark, {**{f"n{i}": f"acme {i:02d}" for i in range(30)}, "acme": "the firm acme"})
    got = graph.resolve_values(found, ["acme", "ACME 07"]).collect()
    assert {r["value"]: (r["iri"], r["how"]) for r in got} == {"acme": ("http://x/acme", "local name"), "ACME 07": ("http://x/n7", "label")}
    assert {r["value"]: r["near"] for r in got}["acme"] == 31


def test_limits_are_the_callers(spark):
    df = spark.range(700).select("id", F.lit(None).cast("int").alias("x"))
    assert dq.failing_rows(df, DqRule("r", "not_null", "x")).count() == 700
    assert [r["id"] for r in dq.failing_rows(df, DqRule("r", "not_null", "x"), limit=300).collect()] == list(range(300))
    spark.range(700).createOrReplaceTempView("seven_hundred")
    assert attach.action(spark, "SELECT id FROM seven_hundred WHERE id >= :low", {"low": 0}).count() == 700
    many = people(spark, {f"n{i}": str(i) for i in range(1200)})
    cohort = Cohort("all", EX + "T", (Criterion("attribute", "http://www.w3.org/2000/01/rdf-schema#label", "exists"),))
    assert cohorts.evaluate(many, cohort).count() == 1200
    assert graph.aggregate(many, EX + "T", group_by="http://www.w3.org/2000/01/rdf-schema#label").count() == 1200


def test_words_are_no_numbers(spark):
    found = people(spark, {"a": "NaN", "b": "150", "c": "Infinity", "d": "50"})
    rich = Cohort("rich", EX + "T", (Criterion("attribute", "http://www.w3.org/2000/01/rdf-schema#label", "gt", 100),))
    assert [r["subject"] for r in cohorts.evaluate(found, rich, label=False).collect()] == ["http://x/b"]


def test_null_filters_and_invalid_rules(spark):
    df = spark.createDataFrame([(1, 9, None), (2, 9, "y"), (3, 1, None), (4, 9, "n")], "id int, v int, f string")
    rule = DqRule("r", "range", "v", {"min": 0, "max": 5, "filter": "f = 'y'"})
    assert dq.evaluate(df, [rule]).first()["failed"] == 2
    assert {r["id"] for r in dq.failing_rows(df, rule).collect()} == {1, 2}
    assert {r["id"] for r in dq.flag_rows(df, [rule]).collect() if r["failed_rules"]} == {1, 2}
    bad = [DqRule("column", "not_null", "nope"), DqRule("threshold", "not_null", "v", {}, 7.0), rule]
    assert {r["rule"]: r["status"] == "error" for r in dq.evaluate(df, bad).collect()} == {"column": True, "threshold": True, "r": False}


def test_communities_do_not_follow_partitions(spark):
    pairs = [(f"n{a}", f"n{b}") for a in range(40) for b in range(a) if a // 8 == b // 8 or (a * b) % 31 == 5]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, communities.communities(edges.repartition(int(n)), "label_propagation").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    assert seen[0] == seen[1] and BASE


def test_tasks_of_an_aggregate_follow_its_links(spark, hr, monkeypatch):
    """Links of a large graph are dealt over a number of tasks that grows with them; the result stays."""
    ask = lambda: graph.aggregate(
        hr.graph, EX + "Employee", measure=EX + "salary", group_by=[EX + "worksIn", EX + "name"], label=False, dedupe=True)
    plain = sorted(map(tuple, ask().collect()), key=str)
    monkeypatch.setattr(skew, "LARGE", 4)
    monkeypatch.setattr(skew, "TASK_ROWS", 1)
    links = hr.graph.where(F.col("predicate").isin(EX + "worksIn", EX + "name")).count()
    many = ask()
    assert links > 4 and f", {links}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect()), key=str) == plain


def test_neighbours_of_a_few_leave_the_graph_where_it_is(spark, hr, tmp_path, monkeypatch):
    """A few entities are sent to the graph: only their links are shuffled. Instances of a class stay its neighbours."""
    hr.graph.write.parquet(str(tmp_path / "graph"))
    stored, plans, save = spark.read.parquet(str(tmp_path / "graph")), {}, graph.Scratch.save
    monkeypatch.setattr(graph.Scratch, "save", lambda self, df, name="step", *a, **k: (
        plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), save(self, df, name, *a, **k))[1])
    asked = spark.createDataFrame([(f"{BASE}Department/10",), (EX + "Department",)], "iri string")
    found = {tuple(r) for r in graph.neighbours(stored, asked).collect()}
    assert found == {
        (f"{BASE}Department/10", "incoming", EX + "worksIn", f"{BASE}Employee/1", "SMITH"),
        *((EX + "Department", "incoming", RDF_TYPE, f"{BASE}Department/{k}", n) for k, n in ((10, "SALES"), (20, "RESEARCH")))}
    assert plans["links"].count("rightHint=(strategy=broadcast)") == 2
    named = graph.labels(stored)._jdf.queryExecution().executedPlan().toString()
    assert named.count("partial_min_by") == 1 and named.index("partial_min_by") < named.index("Exchange")  # above the shuffle


def test_new_facts_of_rules_are_sorted_behind_a_shuffle(spark, hr, monkeypatch):
    """Facts are counted and dealt by number; none is sorted or grouped in the tasks of a scan."""
    is_, has = lambda c, x: Atom("class", EX + c, (x,)), lambda p, x, y: Atom("property", EX + p, (x, y))
    chain = [Rule("boss", (has("reportsTo", "?a", "?b"),), (is_("Boss", "?b"),)),
             Rule("led", (has("reportsTo", "?a", "?b"), is_("Boss", "?b")), (is_("Led", "?a"),))]
    plain = rules.infer(hr.graph, chain)
    asked, plans, save = set(map(tuple, plain.triples.collect())), [], rules.Scratch.save
    monkeypatch.setattr(rules.Scratch, "save", lambda self, df, *a, **k: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df, *a, **k))[1])
    monkeypatch.setattr(skew, "LARGE", 1)
    monkeypatch.setattr(skew, "TASK_ROWS", 0.25)
    many = rules.infer(hr.graph, chain)
    assert set(map(tuple, many.triples.collect())) == asked and len(asked) == 3
    assert len(plans) == 3 and all("REPARTITION_BY_NUM" in p for p in plans)
    assert all(p.index("partial_min(") < p.index("REPARTITION_BY_NUM") for p in plans[1:])
