"""Graph measures against values worked out by hand or by brute force."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.operators import analytics, communities, sketches
from semgraph.operators.components import connected_components

CLIQUES = (
    [(f"a{i}", f"a{j}") for i, j in itertools.combinations(range(5), 2)]
    + [(f"b{i}", f"b{j}") for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0")]
    + [(f"p{i}", f"p{i + 1}") for i in range(6)]
)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(CLIQUES, "src string, dst string").cache()


def brute_paths():
    near: dict[str, set[str]] = {}
    for a, b in CLIQUES:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes, between, close = sorted(near), dict.fromkeys(near, 0.0), {}
    for s in nodes:
        dist, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        give = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist.get(v) == dist[w] - 1:
                    give[v] += ways[v] / ways[w] * (1 + give[w])
            if w != s:
                between[w] += give[w]
        total = sum(dist.values())
        close[s] = (len(dist) - 1) / total * (len(dist) - 1) / (len(nodes) - 1)
    scale = 1 / ((len(nodes) - 1) * (len(nodes) - 2))
    return {n: (between[n] * scale, close[n]) for n in nodes}


def test_components_and_kpis(edges):
    parts = connected_components(edges)
    assert {r["component"]: r["count"] for r in parts.groupBy("component").count().collect()} == {"a0": 10, "p0": 7}
    row = analytics.kpis(edges, parts).first()
    assert (row["nodes"], row["edges"], row["components"], row["avg_degree"]) == (17, 27, 2, 3.1765)
    assert row["density"] == pytest.approx(27 / (17 * 8), abs=1e-6)


def test_long_path_is_one_component(spark):
    path = spark.range(300).select(F.format_string("n%03d", "id").alias("src"), F.format_string("n%03d", F.col("id") + 1).alias("dst"))
    assert connected_components(path).select("component").distinct().count() == 1


def test_exact_path_centralities(edges):
    want = brute_paths()
    for r in analytics.path_centralities(edges, None).collect():
        assert (r["betweenness"], r["closeness"]) == pytest.approx(want[r["node"]], abs=1e-9)
    assert analytics.path_centralities(edges, pivots=5).count() == 17


def test_pagerank_against_power_iteration(edges):
    nodes = sorted({n for e in CLIQUES for n in e})
    out = {n: [b for a, b in CLIQUES if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(200):
        loose = sum(rank[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * loose / len(nodes))
        for n in nodes:
            for b in out[n]:
                new[b] += 0.85 * rank[n] / len(out[n])
        rank = new
    got = {r["node"]: r["pagerank"] for r in analytics.pagerank(edges).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    for n in nodes:
        assert got[n] == pytest.approx(rank[n], abs=1e-4)


def test_clustering_and_degree(edges):
    got = {r["node"]: (r["triangles"], r["clustering"]) for r in analytics.clustering(edges).collect()}
    assert got["a1"] == (6, 1.0) and got["a0"] == (6, 0.6) and got["p3"] == (0, 0.0)
    assert analytics.degree(edges).where("node = 'a0'").first()["centrality"] == 5 / 16
    loop = edges.sparkSession.createDataFrame([("x", "x"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r["node"]: r["degree"] for r in analytics.degree(loop).collect()} == {"x": 3, "y": 1}


def test_histograms(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "a double, b double")
    rows = {r["metric"]: r for r in analytics.histograms(df, ["a", "b"]).collect()}
    assert rows["a"]["median"] == 50.0 and rows["a"]["p90"] == pytest.approx(90.0) and sum(rows["a"]["bins"]) == 101
    assert rows["b"]["bins"][0] == 101


@pytest.mark.parametrize("algorithm,least", [("louvain", 0.55), ("greedy_modularity", 0.5), ("label_propagation", 0.4)])
def test_communities(edges, algorithm, least):
    found = communities.communities(edges, algorithm)
    rows = sorted((r["node"], r["community"]) for r in found.collect())
    assert len(rows) == 17 and communities.modularity(edges, found) >= least
    if algorithm == "label_propagation":
        assert rows == sorted((r["node"], r["community"]) for r in communities.communities(edges, algorithm).collect())
    sizes = [r["count"] for r in found.groupBy("community").count().orderBy("community").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_leaves_are_folded_into_their_hosts(spark):
    """A pair keeps its smaller node, a node with a loop is no leaf, and no weight is lost; one numbering serves all."""
    pairs = [(1, 2), (1, 3), (1, 4), (4, 5), (4, 6), (5, 6), (8, 9), (6, 7)]
    rows = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs] + [(7, 7, 2.0)]
    folded, leaves = communities._folded(spark.createDataFrame(rows, "u long, v long, w double"), Scratch(spark, "test"))
    assert {tuple(r) for r in leaves.collect()} == {(2, 1), (3, 1), (9, 8)}
    got = {(r["u"], r["v"]): r["w"] for r in folded.collect()}
    assert got[1, 1] == 4.0 and got[8, 8] == got[7, 7] == 2.0 and sum(got.values()) == sum(w for *_, w in rows)


def test_greedy_merging_of_stars_settles(spark, monkeypatch):
    """Hubs take all that gain by it in a round, not one member each; leaves stay with what they hang on."""
    rounds, measured = [], Scratch.measured
    monkeypatch.setattr(Scratch, "measured", lambda self, df, name, **k: (rounds.append(name), measured(self, df, name, **k))[1])
    links = [(f"c{h}_{c}", f"z{h}") for h in range(3) for c in range(50)] + [("z0", "z1"), ("z1", "z2"), ("y", "x")]
    links += [(f"d{h}_{c}_{o}", f"c{h}_{c}") for h in range(3) for c in range(50) for o in range(2)]
    df = spark.createDataFrame(links, "src string, dst string")
    found = communities.communities(df, "greedy_modularity")
    rows = {r["node"]: r for r in found.collect()}
    assert len(rows) == 455 and all(r["converged"] for r in rows.values())
    assert all(rows[a]["community"] == rows[b]["community"] for a, b in links if a[0] in "dy")
    assert communities.modularity(df, found) > 0.6 and rounds.count("choice") <= 8


def test_health_and_layers(hr):
    rows = {r["type"].rsplit("#")[-1]: (r["instances"], r["relation_predicates"], r["flag"]) for r in analytics.health(hr.graph).collect()}
    assert rows == {"Employee": (4, 3, None), "Department": (2, 0, "flat")}
    edges = analytics.entity_edges(hr.graph)
    member = communities.communities(edges, "label_propagation")
    layer = communities.replace_membership(hr.graph.where("inferred"), member, "http://d/")
    again = communities.replace_membership(layer, member, "http://d/")
    assert layer.count() == again.count() == member.count()
    assert communities.summary(member, analytics.degree(edges), hr.graph).agg(F.sum("size")).first()[0] == member.count()


def test_communities_in_parts_are_split(spark):
    """Community 0 holds two stars that meet only through node 9 of another one."""
    links = [(0, 1), (0, 2), (4, 5), (4, 6), (2, 9), (4, 9), (9, 8)]
    df = spark.createDataFrame(links, "u long, v long")
    labels = spark.createDataFrame([(k, 0) for k in (0, 1, 2, 4, 5, 6)] + [(8, 1), (9, 1), (7, 0)], "id long, label long")
    got = {r["id"]: r["label"] for r in communities._connected(df, labels, Scratch(spark, "test")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 6: 4, 8: 8, 9: 8, 7: 7}


# -- sketches -----------------------------------------------------------------------------------------------------

def test_sketches_of_parts_merge_to_those_of_the_whole(spark, tmp_path):
    import math
    import random

    pick = random.Random(5)
    rows = [(k % 4, k, round(pick.gauss(100, 15), 3) if k % 10 else None, f"word {k % 900}", float("nan") if k % 7 else float(k)) for k in range(8000)]
    df = spark.createDataFrame(rows, "part int, id long, x double, word string, odd double")
    folder = str(tmp_path / "kept")
    sketches.save(sketches.sketches(df.where("part < 2"), "part"), folder)
    got = {r["column"]: r for r in sketches.refresh(df, "part", ["2", "3"], folder).collect()}
    whole = {r["column"]: r for r in sketches.merged(sketches.sketches(df.withColumn("part", F.lit(0)), "part")).collect()}
    values = {"id": [r[1] for r in rows], "x": [r[2] for r in rows if r[2] is not None], "odd": [r[4] for r in rows if not math.isnan(r[4])]}
    for name, v in values.items():
        r, n = got[name], len(v)
        mean = sum(v) / n
        assert (r["rows"], r["nulls"], r["min"], r["max"]) == (8000, 8000 - n, min(v), max(v))
        assert r["mean"] == pytest.approx(mean) and r["std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in v) / (n - 1)))
        assert abs(r["distinct"] - len(set(v))) <= 3 * sketches.DISTINCT_ERROR * len(set(v))
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            for found in (r, whole[name]):
                assert abs(sum(x <= found[q] for x in v) / n - p) <= 2 * sketches.RANK_ERROR
    assert abs(got["word"]["distinct"] - 900) <= 54 and abs(whole["word"]["distinct"] - 900) <= 54 and got["word"]["median"] is None
    fewer = {r["column"]: r["rows"] for r in sketches.refresh(df.where("part <> 3 OR id < 4000"), "part", ["3"], folder).collect()}
    assert set(fewer.values()) == {7000}
    none = sketches.merged(sketches.sketches(df.where("false"), "part"))
    assert none.isEmpty()
