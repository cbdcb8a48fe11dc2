"""Numbers of nodes, and tables of rounds that must not go through the driver."""

from __future__ import annotations

from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch, scratch_root, tidy
from semgraph.operators import analytics, reach
from semgraph.operators.components import connected_components
from semgraph.operators.nodes import hashed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_of_rounds_are_not_broadcast(spark):
    scratch = Scratch(spark, "few", few=100)
    large = scratch.save(spark.range(101).select("id", F.col("id").alias("a")), "large")
    small = scratch.save(spark.range(100).select("id", F.col("id").alias("b")), "small")
    other = spark.range(50).select("id")
    assert "BroadcastHashJoin" not in plan(large.join(large.select("id"), "id"))
    assert "BroadcastHashJoin" in plan(large.join(small, "id"))
    assert "BroadcastHashJoin" not in plan(other.join(large, "id", "left_anti"))


def test_known_paths_are_not_broadcast(spark):
    paths = spark.range(50).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert "BroadcastHashJoin" not in plan(paths.join(reach._known(paths.unionByName(paths)), ["a", "b"], "left_anti"))


def test_nodes_that_share_a_hash_are_told_apart(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)] + [("n0", "n1")], "src string, dst string")
    for bits in (64, 2):
        g = hashed(edges, "test", bits=bits)
        assert g.nodes.select("id").distinct().count() == 12 and g.links.count() == 12


def test_links_stated_twice_count_once(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "x"), ("y", "z")]
    edges = spark.createDataFrame(rows * 2, "src string, dst string")
    assert {r["node"]: r["degree"] for r in analytics.degree(edges).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1, "x": 2, "y": 1, "z": 1}
    assert {r["node"]: r["triangles"] for r in analytics.clustering(edges).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0, "x": 0, "y": 0, "z": 0}
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "y", "z": "y"}
    kpis = analytics.kpis(edges).first()
    assert (kpis["nodes"], kpis["edges"], kpis["components"]) == (7, 7, 3)


def test_long_paths_are_components(spark):
    edges = spark.range(300).where("id % 100 <> 99").select(F.format_string("n%03d", "id").alias("src"), F.format_string("n%03d", F.col("id") + 1).alias("dst"))
    found = connected_components(edges).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in found} == {"n000": 100, "n100": 100, "n200": 100}


def _left(spark, job: str) -> set[str]:
    """Names of the tables that the last run of a job has left."""
    last = max(Path(scratch_root(spark)).glob(f"{job}-*"), key=lambda p: p.stat().st_mtime_ns)
    return {p.name.split("-", 1)[1] for p in last.iterdir()}


LINKS = [(f"n{a}", f"n{b}") for a in range(30) for b in range(30) if (a * b) % 7 == 3 or b == a + 1] + [("n0", "n0"), ("x", "y")]


def test_clustering_moves_no_wedge_that_is_known_to_be_open(spark):
    edges = spark.createDataFrame(LINKS, "src string, dst string")
    near: dict[str, set[str]] = {}
    for a, b in LINKS:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {n: sum(b in near[a] for a, b in combinations(sorted(near[n] - {n}), 2)) for n in near}
    assert {r["node"]: r["triangles"] for r in analytics.clustering(edges).collect()} == want
    assert _left(spark, "clustering") == {"nodes", "degrees", "credit"}


def test_kpis_keep_one_copy_of_the_links(spark):
    edges = spark.createDataFrame(LINKS * 2, "src string, dst string")
    row = analytics.kpis(edges).first()
    assert (row["nodes"], row["edges"], row["components"]) == (len({n for p in LINKS for n in p}), len(set(LINKS)), 2)
    n = row["nodes"]
    assert row["density"] == pytest.approx(2 * len({tuple(sorted(p)) for p in LINKS}) / (n * (n - 1)), abs=1e-6)
    assert "links" not in _left(spark, "kpis")


def test_best_ranked_nodes_come_with_all_that_tie(spark):
    """The only one of highest rank, and four that share the second place."""
    edges = spark.createDataFrame([(f"a{i}", "hub") for i in range(4)], "src string, dst string")
    assert sorted(r["node"] for r in analytics.best_ranked(edges, 1).collect()) == ["hub"]
    got = {r["node"]: (r["degree"], r["pagerank"]) for r in analytics.best_ranked(edges, 2).collect()}
    ranks = {r["node"]: r["pagerank"] for r in analytics.pagerank(edges).collect()}
    want = {r["node"]: (r["centrality"], pytest.approx(ranks[r["node"]])) for r in analytics.degree(edges).collect()}
    assert len(got) == 5 and got == want and _left(spark, "best")


def test_steps_leave_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with tidy(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
