"""Hard negatives, language ID and ranked search, against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semgraph.llm import hard_negatives, language_id, ranked_search

# -- hard negatives -----------------------------------------------------------------------------------------------

VECTORS = "id long, label int, vector array<double>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (40, 33, 65), (64, 64, 64), (3, 90, 41)])
def test_strassen_is_exact(shape):
    random_, (m, k, n) = np.random.default_rng(1), shape
    a, b = random_.integers(-(2**27), 2**27, (m, k)), random_.integers(-(2**27), 2**27, (k, n))
    want = [[sum(int(a[i, t]) * int(b[t, j]) for t in range(k)) for j in range(n)] for i in range(m)]
    for leaf in (1, 4, 32):
        assert hard_negatives.strassen(a, b, leaf).tolist() == want


def test_heaps_merge_in_any_order():
    random_ = np.random.default_rng(2)
    scores, ids = random_.integers(0, 6, (7, 50)), random_.permutation(50)
    whole = hard_negatives.heap(scores, scores != 3, ids, 4)
    parts = [hard_negatives.heap(scores[:, at : at + 9], scores[:, at : at + 9] != 3, ids[at : at + 9], 4) for at in range(0, 50, 9)]
    for order in (parts, parts[::-1]):
        assert [x.tolist() for x in hard_negatives.merge(order, 4)] == [x.tolist() for x in whole]


def plain_mine(rows, is_anchor, k=5):
    """(anchor, positive, rank, negative, positive score, negative score), all pairs."""
    wide = max((len(v) for _, _, v in rows), default=0)
    known = {}
    for i, label, v in sorted((i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows):
        known.setdefault(i, (label, v + [0] * (wide - len(v))))
    out = set()
    for a in filter(is_anchor, known):
        score = {i: sum(x * y for x, y in zip(known[a][1], v, strict=True)) for i, (_, v) in known.items()}
        ranked = sorted((i for i in known if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if known[i][0] == known[a][0]][:k]:
            fit = [i for i in ranked if known[i][0] != known[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:k], 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).withColumn("block", F.lit(1))
    got = hard_negatives.mine(spark, df, F.col("id") % 10 == 0, **more)
    return sorted(tuple(r) for r in got.collect())


def test_negatives_as_by_brute_force(spark):
    random_ = np.random.default_rng(3)
    rows = [(i, int(random_.integers(0, 4)), (random_.integers(-3, 9, 5) / 4 + 0.001).tolist()) for i in range(300)]
    rows += [(1000 + i, 7, [1.0, 2.0, 0.5, 0.25, 1.0]) for i in range(150)]  # a third alike, all ties
    want = sorted(plain_mine(rows, lambda i: i % 10 == 0))
    assert len(want) > 500 and mined(spark, rows) == want
    assert mined(spark, rows, block_rows=64) == want  # many blocks


def test_rows_that_take_no_part_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.875]), (3, 2, [1.0]), (4, 3, [1.0, 0.75, -4.0]), (5, 2, []),
            (4, 9, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (10, 8, [1.0, 1.0]), (20, 1, [-1.0, -1.0])]
    bad = [(None, 1, [1.0, 1.0]), (6, None, [1.0, 1.0]), (7, 2, None), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (11, 2, [None, 1.0]),
           (12, 2, [1e30, 1.0])]
    want = sorted(plain_mine(good, lambda i: i % 10 == 0))
    assert want and mined(spark, good + bad) == want
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == []


# -- language ID --------------------------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, lang string"


def plain_pooled(net, window):
    """Largest answers of the filters of one window, place by place."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    out = []
    for width in language_id.WIDTHS:
        places = range(len(window) - width + 1)
        answers = [sum(w["bytes"][window[p + j]] @ w[f"filter{width}"][j] for j in range(width)) for p in places]
        out.append(np.max(answers, axis=0))
    return np.concatenate(out)


def plain_probabilities(net, window):
    hidden = np.maximum(plain_pooled(net, window) + net.weights["shift"], 0)
    z = hidden @ net.weights["out"].astype(float) + net.weights["prior"]
    return np.exp(z) / np.exp(z).sum()


def test_network_and_gradient_as_by_loops():
    net = language_id.Network.fresh(["a", "b", "c"], seed=1)
    random_ = np.random.default_rng(4)
    x, y, weight = random_.integers(0, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([1.0, 2, 1, 1, 3])
    assert net.probabilities(x) == pytest.approx(np.array([plain_probabilities(net, w) for w in x]), abs=1e-5)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    _, gradient = net.gradient(x, y, weight)
    for name, values in net.weights.items():
        for at in [tuple(random_.integers(0, s) for s in values.shape) for _ in range(6)] + ([(int(x[0, 3]), 2)] if name == "bytes" else []):
            kept, sides = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = kept + step
                sides.append(net.gradient(x, y, weight)[0])
            values[at] = kept
            assert gradient[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5)
    assert language_id.Network.loaded(net.saved()).langs == ["a", "b", "c"]


def test_whole_texts_in_windows():
    net = language_id.Network.fresh(["a", "b"], seed=2)
    texts = [b"", b"x", b"Ab" * 40, b"q" * (3 * language_id.WINDOW), bytes(range(32, 127)) * 50]
    lang, score = language_id.judge(net, pa.array([b"sliced off", *texts], pa.binary())[1:], np.array([bool(t) for t in texts]))
    for text, name, value in zip(texts, lang, score, strict=True):
        if not text:
            assert (name, value) == ("und", 0.0)
            continue
        parts = [text[at : at + language_id.WINDOW].lower() for at in range(0, len(text), language_id.WINDOW)]
        p = sum(plain_probabilities(net, part.ljust(language_id.WINDOW, b"\0")) * len(part) for part in parts) / len(text)
        assert name == "ab"[int(p.argmax())] and value == pytest.approx(float(p.max()), abs=1e-5)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_languages_learned_and_odd_texts(spark):
    random_, rows = np.random.default_rng(6), []
    parts = {"xx": ["ba", "do", "mi"], "yy": ["str", "gro", "\u00fc"], "zz": ["\u4e2d", "\u6587 ", "\u5b57"]}
    for i in range(600):
        lang = ["xx", "yy", "zz"][i % 3]
        words = ["".join(random_.choice(parts[lang], 3)) for _ in range(int(random_.integers(2, 60)))]
        rows.append((i, " ".join(words), lang))
    odd = [(700, None, "xx"), (701, "", "xx"), (702, "12 345 !?", "yy"), (None, "bado mido", "xx"), (703, "bado mido", None),
           (704, "BADO midomi " * 20_000, None), (705, "badomi", "xx"), (705, "badomi", "xx")]
    same = [(800, "gro gro strgro", "yy")] * 300  # a third alike, one id
    df = spark.createDataFrame(rows + odd + same, TEXTS).withColumn("score", F.lit("clash")).withColumn("_h", F.lit(1))
    got = language_id.identify(df, per_class=100).collect()
    assert len(got) == len(rows + odd + same)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (700, 701, 702))
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) and 0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (703, 704, 705, 800)] == ["xx", "xx", "xx", "yy"]
    mine = [i for i in range(600) if held(i)]
    assert np.mean([by[i]["lang_pred"] == rows[i][2] for i in mine]) > 0.97
    again = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df.repartition(7), per_class=100).collect()}
    assert again[703] == "xx" and all(again[i] == by[i]["lang_pred"] for i in mine)


def test_nothing_to_learn_and_no_leak(spark):
    none = language_id.identify(spark.createDataFrame([(1, "abc", None)], TEXTS)).collect()
    assert [tuple(r)[2:] for r in none] == [("und", 0.0)]
    assert language_id.identify(spark.createDataFrame([], TEXTS)).collect() == []
    out = next(i for i in range(100) if held(i))
    rows = [(i, "abc " * 5, "xx") for i in range(30) if not held(i)] + [(out, "qqq", "secret")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, TEXTS)).collect()}
    assert set(got.values()) == {"xx"}
    kept = language_id.predict(spark.createDataFrame(rows[:2], TEXTS), None).columns
    assert kept == ["doc_id", "text", "lang", "lang_pred", "score"]


# -- ranked search ------------------------------------------------------------------------------------------------

_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(_TERM.findall((t or "").translate(_CAPITALS)))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df, out = Counter(t for _, c in counts for t in c), []
    for item_id, text in set(items):
        scores = []
        for doc_id, c in counts:
            m = 10 + (90 * c.total() * n_docs) // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(_TERM.findall((text or "").translate(_CAPITALS))) if c[t]
            )
            scores += [(-score, doc_id is None, doc_id)] if score > 0 else []
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return out


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("term", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1.0))
    return [tuple(r) for r in ranked_search.search(spark, d, i, **more).collect()]


def texts(seed, n, most):
    random_ = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    for _ in range(n):
        yield " ".join(words[int(400 * random_.random() ** 3)] for _ in range(int(random_.integers(0, most))))


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_as_by_brute_force(spark):
    docs = list(enumerate(texts(7, 900, 60))) + [(5000 + i, "w3 w5 w5 w399 w17") for i in range(450)]  # a third alike: ties
    items = list(enumerate(texts(8, 60, 25)))
    want = by_key(plain_search(docs, items))
    assert len(want) > 500 and by_key(searched(spark, docs, items)) == want
    assert by_key(searched(spark, docs, items, batch_bytes=1000)) == want  # several passes


def test_search_leaves_batches_out():
    random_ = np.random.default_rng(9)
    docs, w = 4000, random_.integers(1, 9000, 300)
    row = np.repeat(np.arange(docs), 12)
    topic = (np.arange(docs) // 40)[row]
    column = np.where(random_.random(len(row)) < 0.7, (topic * 3 + random_.integers(0, 3, len(row))) % 300, random_.integers(0, 300, len(row)))
    key = np.unique(row * 300 + column)
    row, column = key // 300, key % 300
    value = w[column] * random_.integers(1, 1000, len(row))
    sets = [np.unique(np.r_[np.arange(3) + 3 * t, random_.integers(0, 300, 2)]) for t in range(100)]
    one = ranked_search.Search(ranked_search.Items(np.arange(100), sets, w), 10)
    assert len(one.items.terms) == 300
    for at in range(0, docs, 777):  # run by run
        mine = (row >= at) & (row < at + 777)
        one.run(ranked_search.Sparse(row[mine] - at, column[mine], value[mine], min(777, docs - at)), np.arange(at, min(docs, at + 777)))
    assert one.scored < one.pairs / 4
    dense = np.zeros((docs, 300), np.int64)
    dense[row, column] = value
    found, ids, score = one.best
    for i, place in enumerate(one.items.places):
        total = dense[:, sets[place]].sum(axis=1)
        want = [(int(total[d]), int(d)) for d in np.lexsort((np.arange(docs), -total))[:10] if total[d] > 0]
        assert list(zip(score[found == i].tolist(), ids[found == i].tolist(), strict=True)) == want


def test_search_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,- "), (4, "Gr\u00fcn GR\u00dcN gr\u00fcn \u4e2d\u6587,x"), (None, "x y"), (5, "x y"), (5, "x y"), (6, "\u00c4b 9a\x7fz"),
            (7, "z " * 50_000), (8, "x\u00a0y")]
    items = [(0, "GR\u00dcN \u4e2d\u6587"), (1, None), (2, ""), (3, "?!"), (None, "x"), (4, "z Z z"), (5, "x y"), (5, "x y"), (5, "\u00c4b"), (6, "x\u00a0y"), (7, "absent")]
    want = by_key(plain_search(docs, items))
    assert by_key(searched(spark, docs, items)) == want and want
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, docs[:3], items) == []
