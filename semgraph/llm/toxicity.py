"""Toxicity by a counterfactually regularised linear classifier.

Features are hashed: every distinct word of a text, and its first four and five letters. Training minimises
the logistic loss on labelled texts plus, for every identity term in a text, the squared change of the score
when that term is swapped for another of its group. Terms that merely stand near insults in the training
texts so lose their weight, and neutral mentions are not flagged. Only features whose share differs between
the labels beyond chance take part.

The classifier is fitted on a bounded sample of labelled rows: ``per_class`` of each label, those with the
smallest hash of doc_id, weighted back to the label counts. Scoring reads every whole text and shuffles
nothing. Only the text enters a score. Null and empty texts score the prior; a null doc_id is scored, not
learnt from; labels other than 0 and 1 are left out; a document labelled twice counts twice. Without labels
of both kinds the score is the share of toxic labels, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that each memory of a Python worker holds; it is emptied beyond them, results do not change.
REMEMBERED = 100_000
#: Texts scored and handed back at a time.
SLICE = 1_000
BUCKETS = 1 << 18
#: Identity terms that may be swapped for one another, by group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("elderly", "young", "disabled", "deaf", "blind"),
)


def clean(word: bytes) -> str:
    """Letters and digits of a word, in small letters."""
    return "".join(filter(str.isalnum, word.decode("utf-8", "replace").lower()))


def buckets(word: str) -> list[int]:
    """Places of a word's features; none for a word without letters and digits."""
    names = [f"w{word}"] + [f"p{word[:n]}" for n in (4, 5) if len(word) > n]
    return [xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names] if word else []


class Cleaned(dict):
    """Word as it stands -> its letters."""

    def __missing__(self, word: bytes) -> str:
        value = self[word] = clean(word)
        return value

    def distinct(self, text: bytes | None) -> set[str]:
        if len(self) > REMEMBERED:
            self.clear()
        return set(map(self.__getitem__, set((text or b"").split()))) - {""}


class Places(dict):
    """Word -> its features as packed 32-bit numbers, remembered."""

    def __missing__(self, word: str) -> bytes:
        value = self[word] = np.array(buckets(word), "<i4").tobytes()
        return value

    def of(self, words: list[str]) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, words))


def swaps(present: set[str], groups: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """Each identity term of a text with every other term of its group."""
    return [(t, other) for g in groups for t in g if t in present for other in g if other != t]


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, per_class: int) -> DataFrame:
    """text, label and weight of the sample."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for label in (0, 1):
        n = counts.get(label, 0)
        picked = usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        parts.append(picked.withColumn("weight", F.lit(float(n) / max(1, min(n, per_class)))))
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.join(sample, "doc_id").select("text", "label", "weight")


def telling(x: list[np.ndarray], y: np.ndarray, least: int, z: float) -> np.ndarray:
    """Features whose share differs between the labels by ``z`` standard errors, met in ``least`` texts or more."""
    met = np.zeros((2, BUCKETS), np.int64)
    for features, label in zip(x, y, strict=True):
        met[int(label), np.unique(features)] += 1
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = (met[0] + met[1]) / sum(n)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (np.abs(met[1] / n[1] - met[0] / n[0]) > z * error) & (met[0] + met[1] >= least)


def fit(
    x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
    fairness: float, least: int = 4, z: float = 4.0, l2: float = 1e-4, epochs: int = 40, batch: int = 256, rate: float = 0.3,
) -> tuple[np.ndarray, float]:
    """Feature weights and prior, by adaptive gradient steps on the telling features.

    ``pairs`` are the features a swap takes away and brings.
    """
    w, square = np.zeros(BUCKETS), np.ones(BUCKETS) * 1e-4
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    if share in (0.0, 1.0):
        return w, (-20.0 if share == 0 else 20.0)
    bias, bias_square = float(np.log(share / (1 - share))), 1e-4
    weight = weight / weight.mean()
    kept = telling(x, y, least, z)
    x = [v[kept[v]] for v in x]
    pairs = [p for p in ((lost[kept[lost]], gained[kept[gained]]) for lost, gained in pairs) if len(p[0]) or len(p[1])]
    random = np.random.default_rng(4)
    for _ in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), batch):
            chosen = order[at : at + batch]
            index = np.concatenate([x[i] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(x[i]) for i in chosen])
            margin = bias + np.bincount(row, w[index], len(chosen))
            error = weight[chosen] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[chosen]) / len(chosen)
            gradient = np.bincount(index, error[row], BUCKETS) + l2 * w
            if pairs and fairness:
                some = random.integers(0, len(pairs), 64)
                for lost, gained in (pairs[k] for k in some):
                    change = 2 * fairness * (w[lost].sum() - w[gained].sum()) / len(some)
                    np.add.at(gradient, lost, change)
                    np.add.at(gradient, gained, -change)
            square += gradient * gradient
            w -= rate * gradient / np.sqrt(square)
            total = float(error.sum())
            bias_square += total * total
            bias -= rate * total / np.sqrt(bias_square)
    return w, bias


def train(rows: DataFrame, fairness: float = 1.0, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> tuple[np.ndarray, float]:
    """Features are made where the texts are; one task fits the bounded sample and returns the weights."""
    groups = tuple(tuple(clean(t.encode()) for t in g) for g in identity)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cleaned, places = Cleaned(), Places()
        for b in batches:
            x, pairs = [], []
            for text in b["text"]:
                present = cleaned.distinct(bytes(text))
                x.append(places.of(sorted(present)))
                pairs.append("\n".join(f"{a} {c}" for a, c in swaps(present, groups)))
            yield pd.DataFrame({"x": x, "pairs": pairs, "label": b["label"], "weight": b["weight"]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, weight, pairs = [], [], [], []
        for b in batches:
            x += b["x"].tolist()
            y += b["label"].tolist()
            weight += b["weight"].tolist()
            pairs += [p for v in b["pairs"] if v for p in v.split("\n")]
        order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))  # the same whatever order rows come in
        x, y, weight = [np.frombuffer(x[i], "<i4") for i in order], np.array([y[i] for i in order], float), np.array([weight[i] for i in order])
        swapped = [tuple(np.array(buckets(t)) for t in p.split(" ")) for p in sorted(pairs)]
        w, bias = fit(x, y, weight, swapped, fairness)
        yield pd.DataFrame({"w": [w.astype("<f4").tobytes()], "bias": [bias]})

    made = rows.mapInPandas(features, "x binary, pairs string, label int, weight double")
    got = made.repartition(1).mapInPandas(fitted, "w binary, bias double").first()
    if got is None:
        return np.zeros(BUCKETS, np.float32), -20.0
    return np.frombuffer(got["w"], "<f4"), float(got["bias"])


def score(docs: DataFrame, weights: np.ndarray, bias: float, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the text, 0 to 1."""
    used = np.flatnonzero(weights)
    sparse = dict(zip(used.tolist(), weights[used].tolist(), strict=True))  # at most BUCKETS entries

    class Worth(dict):
        def __missing__(self, word: str) -> float:
            value = self[word] = sum(sparse.get(k, 0.0) for k in buckets(word))
            return value

    cleaned, worth = Cleaned(), Worth()

    def of(text: bytes | None) -> float:
        if len(worth) > REMEMBERED:
            worth.clear()
        margin = bias + float(np.sum(np.sort([worth[x] for x in cleaned.distinct(text)])))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    names = [c for c in docs.columns if c != column]
    schema = docs.select(*names).schema.add(column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            text = b.column(b.schema.get_field_index("_tx_text"))
            scores = pa.array([of(t.as_py()) for t in text], pa.float64())
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, scores], names=[*names, column])

    return docs.select(*names, F.col("text").cast("binary").alias("_tx_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 8_000, fairness: float = 1.0) -> DataFrame:
    """The documents with held_out, score and predicted, learnt from the labelled rows that are not held out."""
    weights, bias = train(training_rows(docs, labels, folds, per_class), fairness)
    scored = score(docs, weights, bias)
    return scored.withColumn("held_out", held_out(F.col("doc_id"), folds)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
