"""The corpus pipeline, stage by stage, and the registered queries."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from semgraph.llm import jaccard

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


def corpus():
    r = random.Random(1)
    text = lambda n: " ".join(r.choices([f"w{i}" for i in range(500)], k=n))
    passage = "\n".join(text(20) for _ in range(4))
    docs = []
    for i in range(240):
        body = "\n".join(text(12) for _ in range(6))
        docs.append([i, body + (" moron pathetic" if i % 8 == 0 else ""), "en", f"s{0 if i % 2 else i % 5}"])
    for i in (11, 13, 15):
        docs[i][1] = f"{text(9)}\n{passage}\n{text(9)}"
    docs += [[240 + i, text(4 + i) + " " + docs[17][1].replace("\n", " "), "en", "s0"] for i in range(3)]
    docs += [[250, docs[19][1], "en", "s1"], [250, docs[19][1], "en", "s1"], [251, None, None, None], [252, "", "en", "s1"], [None, text(50), "en", "s2"]]
    return [(*d, len(d[1] or "")) for d in docs]


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(corpus(), schema)
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    ids = {k: {r["doc_id"] for r in v} for k, v in kept.items()}
    assert not ids["toxicity"] & set(range(0, 240, 8)) and len(kept["toxicity"]) == 248 - 30
    lines = {r["doc_id"]: r for r in kept["line_dedup"]}
    assert lines[11]["text"].count("\n") == 5 and lines[13]["text"].count("\n") == 1 == lines[15]["text"].count("\n")
    assert lines[13]["n_chars"] == len(lines[13]["text"]) and 250 not in lines and lines[251]["text"] is None
    assert ids["ngram_jaccard"] == ids["line_dedup"] - {240, 241, 242} and 17 in ids["ngram_jaccard"]
    assert ids["mixing"] == ids["ngram_jaccard"] == ids["packing"] and len(kept["mixing"]) >= len(kept["ngram_jaccard"])


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty()


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] + [n for n in entry.queries() if n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


@needs_data
def test_formatting_equals_its_sql(spark):
    name = "op2_chat_formatting"
    assert compare(spark, duck(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)[0] == "ok"


@needs_data
def test_shards_equal_their_sql(spark):
    from semgraph.llm import queries

    got = queries.QUERIES["op6_sharding"](spark, FOLDER).select("doc_id", "size", "law", "shard", "slot")
    want = duck(FOLDER).sql(queries._sharding_sql(24, 6)).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    words = " ".join(f"w{i}" for i in range(60))
    near = words.replace("w59", "other")
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, words)] * 3 + [(5, near), (7, words), (5, other), (None, other + " "), (None, "only null " * 9), (None, "only null " * 9), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(5, near), (5, other), (None, "only null " * 9), (9, ""), (9, ""), (None, None)], key=str)


def test_ids_that_say_nothing_do_not_multiply_texts(spark, monkeypatch):
    """Ids null, or one id for all: each class is met with the text of one row."""
    texts = [" ".join(f"t{i // 2}w{k}" for k in range(30)) + (" end" if i % 2 else "") for i in range(300)]
    handed = []
    by_group = jaccard._by_group
    monkeypatch.setattr(jaccard, "_by_group", lambda rows, members, most, value, links: (
        handed.append(rows.count()) if value == "shingles" else None, by_group(rows, members, most, value, links))[1])
    for doc_id in (None, 4):
        df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
        got = jaccard.similar(spark, df).collect()
        assert len(got) == 300 and len({r["group_id"] for r in got}) == 150 and {r["n_links"] for r in got} == {1}
    assert handed == [300, 300]
