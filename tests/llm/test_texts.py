"""Toxicity, language model, mixing, the Jaccard join, lines and fingerprints."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semgraph.llm import fingerprints, jaccard, language_model, lines, links, mixing, toxicity

DOCS = "doc_id long, text string"


def prose(n, words=400, seed=0):
    r = random.Random(seed)
    return " ".join(f"w{min(int(r.expovariate(0.01)), words)}" for _ in range(n))


# -- toxicity -----------------------------------------------------------------------------------------------------

def labelled(n=900):
    """Insults make a text toxic; one group is mentioned mostly in toxic texts."""
    r, docs, labels = random.Random(3), [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = prose(40, seed=i) + (" you moron, pathetic" if toxic else "") + (" muslim" if r.random() < (0.5 if toxic else 0.02) else "")
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return docs, labels


def test_classifier(spark):
    docs, labels = labelled()
    extra = [(None, "moron"), (5001, None), (5002, ""), (5003, "x " * 30_000), (5004, "!!!")]
    df = spark.createDataFrame(docs + extra, DOCS).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    got = toxicity.classify(df, marks).collect()
    assert len(got) == len(docs) + 5
    truth = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] in truth:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum(right) / len(right) > 0.97


def test_swapping_groups_takes_their_weight():
    docs, labels = labelled()
    x, pairs = [], []
    for _, text in docs:
        present = toxicity.Cleaned().distinct(text.encode())
        x.append(np.array([k for w in sorted(present) for k in toxicity.buckets(w)]))
        pairs += [(np.array(toxicity.buckets(a)), np.array(toxicity.buckets(b))) for a, b in toxicity.swaps(present, toxicity.IDENTITY)]
    y = np.array([t for _, t in labels], float)
    weight = {f: sum(toxicity.fit(x, y, np.ones(len(y)), pairs, fairness=f)[0][toxicity.buckets("muslim")]) for f in (0.0, 30.0)}
    assert weight[0.0] > 0.5 and abs(weight[30.0]) < weight[0.0] / 4


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.01 for r in toxicity.classify(df, marks).collect())
    assert toxicity.classify(df.limit(0), marks).isEmpty()


# -- language model -----------------------------------------------------------------------------------------------

def plain_log10(model, ids, end):
    """Natural logarithm of a text's probability by loops over its tokens, those outside the vocabulary given as such."""
    lm, k = language_model, language_model._K
    mix = lambda x: int(lm.mixed(np.array([x], np.uint64))[0])
    of = [int(c) for c in model.classes[: model.size]]
    cls = lambda w: of[w] if w < model.size else lm.CLASSES
    used, total, past = sorted({*of, lm.CLASSES}), 0.0, [cls(end)] * 3
    for w in [int(w) for w in ids]:
        far, mid, near = past
        values = [0, near, mid * k + near, (far * k + mid) * k + near, mid, far, far * k + near]
        rows = [mix(v + (kind << 32)) % (lm.CLASS_ROWS - 1) + 1 if kind else 0 for kind, v in enumerate(values)]
        x = {c: sum(model.by_class[r, c] for r in rows) for c in used}
        own = cls(w)
        total += x[own] - np.log(sum(np.exp(v) for v in x.values()))
        if w < model.size:
            y = {v: model.prior[v] + model.by_word[mix(near * lm.VOCABULARY + v + (1 << 40)) % lm.WORD_ROWS] for v in range(model.size) if of[v] == own}
            total += y[w] - np.log(sum(np.exp(v) for v in y.values()))
        past = [mid, near, own]
    return total


def test_model_scores_and_gradient_as_by_loops(spark, monkeypatch):
    lm, r, size = language_model, np.random.default_rng(8), 30
    classes = np.zeros(lm.VOCABULARY, int)
    classes[:size] = r.integers(0, 5, size)
    model = lm.Model(classes, size, np.log(r.integers(1, 90, size)), 0.3 * r.normal(size=(lm.CLASS_ROWS, lm._K)), 0.3 * r.normal(size=lm.WORD_ROWS))
    texts = [np.where(r.random(n) < 0.1, lm.VOCABULARY, r.integers(0, size, n)).tolist() + [size - 1] for n in (0, 1, 2, 7, 40, 40)]
    rows = [(i, len(t), -1.5 * t.count(lm.VOCABULARY), np.array(t, "<u2").tobytes()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, outside double, ids binary")
    got = {x["doc_id"]: x["score"] for x in lm.score(df, model, size - 1).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_log10(model, t, size - 1) / np.log(10) - 1.5 * t.count(lm.VOCABULARY), abs=1e-6)
    loss = lambda: -sum(plain_log10(model, t, size - 1) for t in texts)
    g = lm.gradient(lm.context_counts(df, classes, size - 1), model)
    split = lm.CLASS_ROWS * lm._K
    wanted = [*r.choice(np.flatnonzero(g[:split]), 6), *(split + r.choice(np.flatnonzero(g[split:]), 6))]
    for at in wanted:
        weights, place = (model.by_class.ravel(), at) if at < split else (model.by_word, at - split)
        kept, sides = weights[place], []
        for step in (1e-5, -1e-5):
            weights[place] = kept + step
            sides.append(loss())
        weights[place] = kept
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-4)


def test_long_texts_are_cut_without_loss():
    texts = [np.arange(n) % 7 for n in (3, 25, 0, 10)]
    ids = [t.astype("<u2").tobytes() for t in texts]
    whole = [x for t in texts for x in zip([9, 9, *t.tolist()], [9, *t.tolist()], t.tolist(), strict=False)]
    seen, rows = [], []
    for flat, real, known, row in language_model._chunks(ids, 9, 2, most=4):
        at = np.flatnonzero(real)
        seen += list(zip(flat[at - 2].tolist(), flat[at - 1].tolist(), flat[at].tolist(), strict=True))
        rows += row.tolist()
        assert known[real].all() and (flat[~known] == 9).all()
    assert seen == whole and rows == [i for i, t in enumerate(texts) for _ in t]


def test_model_beats_unigrams_and_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_WORDS", 60)
    r = random.Random(1)
    tongues = [[f"{p}{i}" for i in range(60)] for p in "abcd"]
    texts = [" ".join(r.choices(r.choice(tongues), k=60)) for _ in range(300)] + [None, "", "NEW words A1", "a1 " * 5000]
    docs = list(enumerate(texts)) + [(None, "a1 a2"), (3, texts[3])]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash"))
    got = language_model.model_scores(spark, df).collect()
    assert len(got) == len(docs)
    counts = Counter()
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in docs:
        if not held(i):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    text = dict(docs)
    gain = tokens = 0.0
    for row in got:
        w = split(text[row["doc_id"]])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["train_tokens"] == n
        assert (row["n_tokens"], row["n_known"], row["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), held(row["doc_id"]))
        if row["held_out"] and row["doc_id"] < 300:
            gain, tokens = gain + row["score"] - row["base_score"], tokens + len(w)
    assert gain / tokens > 0.3  # four tongues: at best log10(4)


def test_rare_words_have_contexts(spark, monkeypatch):
    """Words without numbers of their own are learnt after their contexts too, not only counted."""
    monkeypatch.setattr(language_model, "OWN", 41)
    r = random.Random(1)
    tongues = [[f"{p}{i}" for i in range(60)] for p in "abcd"]
    often = [w for t in tongues for w in t[:10]]
    texts = [" ".join(r.choices(r.choice(tongues), [4] * 10 + [1] * 50, k=60)) for _ in range(300)]
    seen, table = {}, language_model.context_counts
    monkeypatch.setattr(language_model, "context_counts", lambda df, classes, end: (
        seen.update(end=end, ids={x for row in df.select("ids").collect() for x in np.frombuffer(row["ids"], "<u2").tolist()}), table(df, classes, end))[1])
    got = language_model.model_scores(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(often) + 1 == 41 and language_model.VOCABULARY not in seen["ids"] and len(seen["ids"]) > 230
    held = [row for row in got if row["held_out"]]
    assert sum(row["score"] - row["base_score"] for row in held) / sum(row["n_tokens"] for row in held) > 0.3


def test_softmaxes_are_distributions():
    size = 50
    r = np.random.default_rng(0)
    classes = np.zeros(language_model.VOCABULARY, int)
    classes[:size] = r.integers(0, 5, size)
    m = language_model.Model(classes, size, np.log(r.integers(1, 90, size)), r.normal(size=(language_model.CLASS_ROWS, language_model._K)),
                             r.normal(size=language_model.WORD_ROWS))
    inside = np.exp(m.word_logs())
    c = np.exp(m.class_logs())
    assert np.allclose(c.sum(axis=1), 1)
    for k in np.unique(classes[:size]):
        assert np.allclose(inside[:, classes[:size] == k].sum(axis=1), 1)


# -- mixing -------------------------------------------------------------------------------------------------------

def sources(spark):
    rows = [(i, prose(30 + i % 50, seed=i), "big") for i in range(600)] + [(1000 + i, prose(40, seed=i), "mid") for i in range(120)]
    rows += [(2000 + i, prose(40, seed=9 + i), None) for i in range(30)] + [(3000, "", "big"), (3001, None, "void"), (3002, "a b", "mid"), (3002, "a b", "mid")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))


def test_mixture_meets_entropy_and_budget(spark):
    df = sources(spark)
    got = mixing.mix(spark, df, budget_ratio=1.0, entropy_share=0.8, max_repeats=4.0, per_block=16, stretch=2000).collect()
    total = Counter()
    for r in df.collect():
        total[r["source"]] += len((r["text"] or "").split())
    weight = {r["source"]: r["weight"] for r in got if r["source"] != "void"}
    w = np.array(list(weight.values()))
    assert w.sum() == pytest.approx(1) and -(w * np.log(w)).sum() == pytest.approx(0.8 * math.log(3), abs=1e-6)
    budget = sum(total.values())
    spent = Counter()
    for r in got:
        spent[r["source"]] += r["n_tokens"]
    for s, share in weight.items():
        assert budget * share - 80 <= spent[s] <= budget * share + 1e-6
    copies = Counter((r["source"], r["doc_id"]) for r in got)
    for s in weight:
        per = [n for (x, _), n in copies.items() if x == s and _ != 3002]
        assert max(per) - min(per) <= 1
    by = {}
    for r in got:
        by.setdefault(r["stretch"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    full = [k for k in by if 0 < k < max(by)]
    for s, share in weight.items():
        tokens = [sum(r["n_tokens"] for r in got if r["stretch"] == k and r["source"] == s) for k in full]
        assert all(abs(t - 2000 * share) <= 90 for t in tokens)


def test_repeats_are_limited_and_nothing_is_lost(spark):
    df = sources(spark)
    got = mixing.mix(spark, df, entropy_share=0.99, max_repeats=2.0).collect()
    copies = Counter((r["source"], r["doc_id"]) for r in got)
    assert {r["doc_id"] for r in df.collect()} == {d for _, d in copies}
    assert max(n for (_, d), n in copies.items() if d != 3002) == 2 and max(n for (s, d), n in copies.items() if s == "big") == 1
    assert mixing.mix(spark, df.limit(0)).isEmpty()


# -- Jaccard join -------------------------------------------------------------------------------------------------

def shingle_sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def near_texts():
    r = random.Random(8)
    docs, passage = [], prose(60, seed=99)
    for i in range(60):
        docs.append(prose(r.randint(1, 90), seed=i))
    for i in range(40):  # chains of edits: neighbours link, ends may not
        words = docs[i].split() if i < 20 else docs[-1].split()
        for _ in range(max(1, len(words) // 60)):
            words[r.randrange(len(words))] = f"e{i}"
        docs.append(" ".join(words))
    docs += [passage + " " + prose(80, seed=200 + i) for i in range(20)] + [docs[0]] * 5 + ["", None, "One two", "one TWO", "a " * 4000]
    return list(enumerate(docs))


def brute(docs):
    sets = shingle_sets(docs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("part", [8_192, 3])
def test_join_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "LIST_PART", part)
    if part == 3:
        monkeypatch.setattr(jaccard, "GROUP_PART", 150)
    docs = near_texts()
    df = spark.createDataFrame(docs, DOCS).withColumn("class", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(spark, df).collect()}
    assert got == brute(docs)


def test_join_of_nothing_and_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (None, None)], DOCS)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.similar(spark, df).collect())
    assert got == [(0, 0, 0), (0, 2, 4), (4, 2, 4), (4, 2, 4)]
    assert jaccard.similar(spark, df.limit(0)).isEmpty()


def test_divide_skip_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(30):
        core = r.integers(0, 400, 60)
        sets = [np.unique(np.concatenate([core[r.random(60) < 0.95], r.integers(0, 400, r.integers(0, 8))])).astype(np.uint64) for _ in range(25)]
        forest = jaccard.Forest()
        for a, b in jaccard.divide_skip(sets, [0] * 25, (80, 100)):
            forest.join(a, b)
        want = jaccard.Forest()
        for a in range(25):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    want.join(a, b)
        assert [forest.find(i) for i in range(25)] == [want.find(i) for i in range(25)]


@pytest.mark.parametrize("part", [2_000_000, 150])
def test_join_counts_every_link(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "GROUP_PART", part)
    docs = near_texts()
    copy = prose(160, seed=500).split()
    for i in range(12):  # all link with all, some of them twice in the table
        docs += [(1000 + 10 * i + k, " ".join([*copy[: 5 * i], f"x{i}", *copy[5 * i + 1 :]])) for k in range(1 + i % 2)]
    sets = shingle_sets(docs)
    want = {a: sum(a != b and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in jaccard.similar(spark, spark.createDataFrame(docs, DOCS)).collect()}
    assert got == want and max(want.values()) >= 17


@pytest.mark.parametrize("lookup", [0, 20, 10**9])
def test_counted_links_against_brute_force(monkeypatch, lookup):
    monkeypatch.setattr(jaccard, "LOOKUP", lookup)
    r = np.random.default_rng(5)
    for k in range(20):
        core = r.integers(0, 400, 60)
        sets = [np.unique(np.concatenate([core[r.random(60) < 0.95], r.integers(0, 400, r.integers(0, 8))])).astype(np.uint64) for _ in range(25)]
        sides, copies, want = r.integers(0, 1 + k % 2, 25), r.integers(1, 4, 25), [0] * 25
        for a in range(25):
            for b in range(25):
                common = len(np.intersect1d(sets[a], sets[b]))
                if a != b and (k % 2 == 0 or sides[a] != sides[b]) and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    want[a] += copies[b]
        assert jaccard.counted_links(sets, sides.tolist(), copies.tolist(), (80, 100))[1].tolist() == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(500, 500 + i) for i in range(1, 60)] + [(None, 3)]
    got = {r["node"]: r["root"] for r in links.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{500 + i: 500 for i in range(60)}}
    assert links.components(spark, spark.createDataFrame([], "a long, b long")).isEmpty()


# -- lines --------------------------------------------------------------------------------------------------------

def cut(line):
    """A line's pieces, word by word: sentences, and runs of 16 words of longer ones; white space stays behind its word."""
    out = [""]
    for word in re.findall(r"\s*\S+\s*", line):
        out[-1] += word
        solid = word.rstrip()
        if (solid[-1] in ".!?") or len(out[-1].split()) == lines.RUN:
            out.append("")
    return [p for p in out if p] or [line]


def expected_lines(docs):
    solid = {}
    for i, t in docs:
        rows = [(p, k, n, len(cut(x)) == 1) for k, x in enumerate((t or "").split("\n")) for n, p in enumerate(cut(x))]
        solid[i] = [(p.rstrip(), k, n, w) for p, k, n, w in rows if p.strip()]
    seen = {}
    for i, rows in solid.items():
        for a in range(len(rows) - 2):
            three = rows[a : a + 3]
            if all(w for *_, w in three) or sum(len(p) for p, *_ in three) >= lines.LEAST:
                seen.setdefault(tuple(p for p, *_ in three), []).append((i, a))
    gone = {}
    for at in seen.values():
        first = min(at)
        for i, a in at:
            if (i, a) != first:
                low = max(a, first[1] + 3) if i == first[0] else a
                gone.setdefault(i, set()).update(range(low, a + 3))
    out = {}
    for i, t in docs:
        lost = {solid[i][k][1:3] for k in gone.get(i, ())}
        kept = [[p for n, p in enumerate(cut(x)) if (k, n) not in lost] for k, x in enumerate((t or "").split("\n"))]
        out[i] = None if t is None else "\n".join("".join(ps) for ps in kept if ps)
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(6)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "line 3  "]
    docs = [(i, "\n".join(r.choices(pool, k=r.randint(0, 14)))) for i in range(80)] + [(80, None), (81, ""), (82, "a\na\na\na\na"), (83, "z\n" * 5000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("gone", F.lit(2))
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(spark, df).collect()}
    want = expected_lines(docs)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[82]["text"] == "a\na\na" and got[82]["n_removed"] == 2 and got[80]["n_lines"] == 0
    assert lines.drop_repeated_lines(spark, df.limit(0)).isEmpty()


def test_rows_repeating_an_id_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "x\na\nb\nc\ny")], DOCS)
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in lines.drop_repeated_lines(spark, df).collect())
    assert got == [(0, "a\nb\nc"), (1, ""), (1, ""), (2, "x\ny")]


def test_lines_cut_into_pieces_equal_brute_force(spark):
    """Long lines, with and without sentences, that share parts at any place."""
    r = random.Random(16)
    word = lambda: r.choice([f"w{i}" for i in range(40)]) + r.choice(["", "", "", "", ",", ".", "!", "?"])
    parts = [" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(25)] + ["No. Yes. No. Yes.", "plain " * 50, "\tx  y ", "", " "]
    docs = [(i, "".join(r.choice(parts) + r.choice([" ", " ", "\n", "  \n"]) for _ in range(r.randint(0, 9)))) for i in range(150)]
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(spark, spark.createDataFrame(docs, DOCS)).collect()}
    assert {i: r["text"] for i, r in got.items()} == expected_lines(docs)
    assert sum(r["n_removed"] for r in got.values()) > 300


def test_passages_on_one_line_go_from_all_but_the_first(spark):
    r = random.Random(61)
    free = lambda n: " ".join(f"f{r.randrange(10**9)}" for _ in range(n))
    bare, spoken = free(80), f"{free(12)}. {free(30)}! {free(11)}."
    docs = [(i, bare) for i in range(3)] + [(3 + i, f"{free(9)}\n{bare}\n{free(30)}") for i in range(3)]
    docs += [(10 + i, f"{free(20)}. {spoken} {free(14)}.") for i in range(3)] + [(20, "Yes. No. Yes."), (21, "Yes. No. Yes.")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark, spark.createDataFrame(docs, DOCS)).collect()}
    want = dict(docs)
    assert got == {i: ("" if i in (1, 2) else want[i].replace(bare + "\n", "") if 3 <= i < 6 else want[i].replace(spoken + " ", "") if i in (11, 12) else want[i]) for i in want}


def test_a_passage_that_a_third_of_rows_share(spark):
    docs = [(i, f"own {i}. " + "one two three four five six. seven eight nine ten eleven twelve. and more words than sixty characters." if i % 3 == 0
             else f"text {i} alone") for i in range(6000)]
    got = lines.drop_repeated_lines(spark, spark.createDataFrame(docs, DOCS)).filter("n_removed > 0")
    assert got.count() == 1999 and got.filter("text = concat('own ', doc_id, '. ')").count() == 1999


# -- fingerprints -------------------------------------------------------------------------------------------------

def test_edited_texts(spark):
    texts = [prose(random.Random(i).randint(0, 200), seed=i) for i in range(60)] + [None, "", "é" * 9, "wörd " * 9000]
    docs = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, DOCS).withColumn("head", F.lit("clash")).repartition(7)
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(spark, df).collect()}
    down = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(down):
        t, after = t or "", down[(k + 1) % len(down)][1] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + after[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    by_id = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert by_id == {i: r["fingerprint"] for i, r in got.items()}
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5 > 0.3 > sum(r["near_next"] for r in long) / len(long)
    alone = fingerprints.compare_edited(spark, spark.createDataFrame([(1, "a b c d")], DOCS)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.compare_edited(spark, df.limit(0)).isEmpty()


@pytest.mark.parametrize("split", [20_000, 7])
def test_block_tables_find_all_near_fingerprints(spark, split):
    r = random.Random(2)
    marks = [r.getrandbits(128) for _ in range(30)]
    for m in list(marks):
        for _ in range(4):
            for _ in range(r.randint(0, 5)):
                m ^= 1 << r.randrange(128)
            marks.append(m)
    names = sorted({f"{m:032x}" for m in marks})
    df = spark.createDataFrame([(n,) for n in names + names[:10]], "fingerprint string")
    got = {r["fingerprint"]: r["n_near"] for r in fingerprints.near(df, radius=3, split=split).collect()}
    want = {a: sum(a != b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3 for b in names) for a in names}
    assert got == want
