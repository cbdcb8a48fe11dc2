"""Nearest neighbours, chat formatting, packing and sharding."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from semgraph.llm import chat, graph_search, packing, sharding

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


# -- nearest neighbours -------------------------------------------------------------------------------------------

VECTORS = "id long, vector array<float>"


def exact(ids, x, q, k):
    score = (x * x[q]).sum(axis=1)
    return [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]


def test_recall_over_shards(spark):
    random_ = np.random.default_rng(0)
    centres = random_.normal(size=(20, 24))
    x = (centres[random_.integers(0, 20, 3000)] + random_.normal(size=(3000, 24))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    index = graph_search.index(spark, df, 10, per_shard=1000)
    assert index.count() == 3
    rows = graph_search.search(index, df.filter("id % 20 = 0"), 10, per_block=64).collect()
    ids, wide, hit = np.arange(3000), x.astype(float), 0
    for q in range(0, 3000, 20):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        want = exact(ids, wide, q, 10)
        assert [r for r, _, _ in got] == list(range(1, 11)) and [s for _, _, s in got] == sorted((s for _, _, s in got), reverse=True)
        assert all(s == pytest.approx(float((wide[v] * wide[q]).sum()), abs=1e-9) for _, v, s in got)
        hit += len({v for _, v, _ in got} & {v for v, _ in want})
    assert hit / 1500 >= 0.9


def test_vectors_equal_bad_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]),
                                                   (104, [inf, 1.0]), (105, [None, 1.0]), (None, [1.0, 1.0]), (106, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = graph_search.neighbours(spark, df, df.filter("id IN (0, 7, 100, 101, 103, 106)"), k=5).collect()
    by = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert by == {0: [(i, 1.0) for i in (1, 2, 3, 4, 5)], 7: [(i, 1.0) for i in (0, 1, 2, 3, 4)], 100: [(i, 0.5) for i in range(5)]}
    assert graph_search.neighbours(spark, df.limit(0), df.limit(0), k=5).isEmpty()


# -- chat ---------------------------------------------------------------------------------------------------------

def test_chats_read_back(spark):
    trial = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", trial), (1, 1, "assistant", trial), (2, 1, "assistant", "b <|endoftext|>\n"), (2, 0, "system", ""), (2, 2, "assistant", None),
        (3, 5, None, "x\\\\ ### ### </turn></turn>"), (None, 0, "user", "é 😀"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, None, "assistant", "first"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    formatted = chat.format_chats(df, BPE)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, BPE).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        learnt = "".join(text for _, _, role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    control = {50257, 50258, 50259}
    for r in formatted.collect():
        assert r["ids"][0] == 50257 and r["ids"][-1] == 50259 and sum(i in control for i in r["ids"]) == 3
    assert chat.read_back(chat.format_chats(df.limit(0), BPE), BPE).isEmpty()


def test_escapes_break_control_strings():
    random.seed(1)
    for _ in range(2000):
        text = "".join(random.choices(["\\", "### ", "</turn>", "<", "/", "#", " ", "a", "turn>", "\n"], k=random.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(s in safe for s in chat.GUARDED)


def test_tied_turns_follow_by_text(spark):
    rows = [(1, 0, "user", t) for t in ("zeta", "alpha", None, "mid", "alpha")] + [(1, 0, "assistant", "first by role")]
    rows += [(2, None, "user", "b"), (2, None, "user", "a"), (2, 1, "assistant", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df, BPE), BPE).collect()}
    for conv in (1, 2):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        said = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# -- packing ------------------------------------------------------------------------------------------------------

def unpacked(rows):
    """Sequences in order, after checking that they have no gaps."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return by


def test_packing_keeps_every_id(spark):
    random.seed(2)
    texts = [" ".join(random.choices(["alpha", "é", "béta\n\n", "12", "<|endoftext|>", "  x"], k=random.randint(0, 900))) for _ in range(150)]
    texts += [None, "", "word " * 20_000] + ["the same text"] * 300
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(spark, df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    unpacked(got)
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    pieces = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        if i == 0:
            assert len(mine) % 2 == 0
            mine = mine[::2]
        assert [x for r in mine for x in np.frombuffer(r["ids"], "<u4").tolist()] == want
        assert all(r["length"] == 1024 for r in mine[1:]) and [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
    assert packing.pack(spark, df.limit(0), RANKS, public_tokenizers.PATTERN).isEmpty()


def test_packing_query_takes_the_tokenizers_ids(spark, tmp_path):
    from semgraph.llm import queries

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|>  y", "<|endoftext", "pl<|endoftext|>ain  ", "", "word <|endoftext|> " * 700]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(BPE)
    want = []
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for piece, part in enumerate(np.split(ids, range(first, len(ids), 1024))):
            want.append((i, piece, len(part), zlib.crc32(part.tobytes())))
    got = queries.op3_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want


@pytest.mark.parametrize("n,low,high", [(4000, 1, 1023), (2500, 500, 700), (3000, 1, 200), (1500, 300, 1000), (1, 9, 9)])
def test_plan_is_near_best_fit(n, low, high):
    random.seed(n)
    lengths = [random.randint(low, high) for _ in range(n)]
    histogram = {}
    for x in lengths:
        histogram[x] = histogram.get(x, 0) + 1
    intervals, sequences = packing.plan(histogram, 1024, 1024, 128)
    filled, ranks = {}, {}
    for length, first, count, sequence, offset in intervals:
        ranks.setdefault(length, []).append((first, count))
        for i in range(count):
            filled.setdefault(sequence + i, []).append((offset, length))
    for x, parts in ranks.items():
        at = 0
        for first, count in sorted(parts):
            assert first == at
            at += count
        assert at == histogram[x]
    for row in filled.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) == sequences <= packing.best_fit(lengths, 1024) * 1.005 + 1


def test_few_groups_round_and_still_fit():
    random.seed(5)
    histogram = {x: random.randint(1, 9) for x in range(1, 1024)}
    intervals, sequences = packing.plan(histogram, 1024, 16, 128)
    assert sum(c for _, _, c, _, _ in intervals) == sum(histogram.values())
    assert sequences <= -(-sum(x * n for x, n in histogram.items()) // 1024) * 1.15


# -- sharding -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101, 1000, 4097])
def test_permutation_is_one_to_one(spark, n):
    rows = spark.range(n).select("id", sharding.permute(F.col("id"), n, seed=n).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    if n > 100:
        assert sum(r["p"] == r["id"] for r in rows) < n / 20


def test_shards_of_files_and_frames(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "é" * i) for i in range(500)] + [(3, "same")] * 40 + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("place", F.lit(1))
    path = str(tmp_path / "docs")
    df.repartition(5).write.parquet(path)
    found = sharding.shard_table(spark, path, 24, seed=3)
    got = found.collect()
    assert len(got) == 541 and got == sharding.shard_table(spark, path, 24, seed=3).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert set(slots) == set(range(24)) and {len(s) for s in slots.values()} == {22, 23}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    numbered = sharding.number_frame(spark, df.filter("doc_id < 90"))
    assert sorted(r["row_number"] for r in numbered.collect()) == list(range(numbered.count()))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert sharding.shard_table(spark, str(tmp_path / "none"), 24).isEmpty()


def test_large_files_are_many_join_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 64)
    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "ids"))
    assert sorted(r["row_number"] for r in sharding.number_rows(spark, str(tmp_path / "ids")).collect()) == list(range(1000))
