"""Language ID by a byte convolutional network.

A text is cut into windows of a fixed number of bytes, the last filled up with zero bytes. Bytes are embedded, filters of
several widths run over a window, each filter's largest answer is kept (max pooling), and a softmax over the learned
languages follows. A text's language is the one with the largest mean probability over its windows, weighted by their
bytes; that mean is the score. Every byte of every text is read.

The network is trained in numpy on a bounded sample: of each of the ``classes`` most frequent languages the ``per_class``
rows of least hash of doc_id, each giving ``per_text`` windows spread over the whole text and one short piece. Texts,
languages and ids enter training only from rows that are not held out; a prediction sees the text alone. One task fits
the sample; texts are read where they lie and nothing is shuffled for scoring.

Null texts and texts without a letter are ``und`` with score 0, as all are if nothing was learned; a null language or id
is predicted, not learned from. Repeated rows are predicted alike. Ties go to the first language in order of names.
``lang_pred`` and ``score`` replace columns of these names; an empty table gives an empty table.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semgraph.functions.terms import quoted

#: Bytes of a window, filter widths, filters of each width, numbers that stand for a byte.
WINDOW, WIDTHS, FILTERS, EMBEDDED = 96, (2, 3, 4), 16, 8
#: Windows scored at once: 2,048 take some 15 MB a width.
AT_ONCE = 2048
UNKNOWN = "und"
_SMALL = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class Network:
    """Parameters by name; ``langs`` in order of the softmax."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]) -> None:
        self.langs, self.weights = langs, weights
        self._tables: dict[int, list[np.ndarray]] | None = None

    @staticmethod
    def fresh(langs: list[str], seed: int = 12) -> Network:
        random = np.random.default_rng(seed)
        weights = {"bytes": random.normal(0, 1, (256, EMBEDDED))}
        for width in WIDTHS:
            weights[f"filter{width}"] = random.normal(0, (width * EMBEDDED) ** -0.5, (width, EMBEDDED, FILTERS))
        pooled = FILTERS * len(WIDTHS)
        weights |= {"shift": np.zeros(pooled), "out": random.normal(0, pooled**-0.5, (pooled, len(langs))), "prior": np.zeros(len(langs))}
        return Network(langs, {k: v.astype(np.float32) for k, v in weights.items()})

    def tables(self, width: int) -> list[np.ndarray]:
        """A filter's share of its answer by place and byte: the embedding multiplied out."""
        return [self.weights["bytes"] @ self.weights[f"filter{width}"][j] for j in range(width)]

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answers of all filters in each window, and where they stand if asked for."""
        best, where = [], []
        for width in WIDTHS:
            span = x.shape[1] - width + 1
            tables = self._tables[width] if self._tables else self.tables(width)
            answer = np.take(tables[0], x[:, :span], axis=0)
            for j in range(1, width):
                answer += np.take(tables[j], x[:, j : j + span], axis=0)
            if places:
                at = answer.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0])
            else:
                best.append(answer.max(axis=1))
        return np.concatenate(best, axis=1), where

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.weights["shift"], 0)
        z = hidden @ self.weights["out"] + self.weights["prior"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        self._tables = self._tables or {w: self.tables(w) for w in WIDTHS}
        return self.softmax(self.pooled(x)[0])

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean cross-entropy of a batch and its gradient by parameter."""
        self._tables = None
        pooled, where = self.pooled(x, places=True)
        p = self.softmax(pooled)
        rows, share = np.arange(len(x)), weight / weight.sum()
        loss = -float((share * np.log(np.maximum(p[rows, y], 1e-12))).sum())
        p[rows, y] -= 1
        p *= share[:, None].astype(p.dtype)
        hidden = np.maximum(pooled + self.weights["shift"], 0)
        up = (p @ self.weights["out"].T) * (hidden > 0)
        out = {"out": hidden.T @ p, "prior": p.sum(axis=0), "shift": up.sum(axis=0), "bytes": np.zeros((256, EMBEDDED))}
        for k, width in enumerate(WIDTHS):
            mine = up[:, k * FILTERS : (k + 1) * FILTERS]
            out[f"filter{width}"] = np.zeros((width, EMBEDDED, FILTERS))
            for j in range(width):
                met = x[rows[:, None], where[k] + j].astype(np.int64)  # only the byte below a largest answer learns
                table = np.bincount((met * FILTERS + np.arange(FILTERS)).ravel(), mine.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                out[f"filter{width}"][j] = self.weights["bytes"].T @ table
                out["bytes"] += table @ self.weights[f"filter{width}"][j].T
        return loss, out

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, langs=np.array(self.langs), **self.weights)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as stored:
            return Network([str(x) for x in stored["langs"]], {k: stored[k] for k in stored.files if k != "langs"})


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.004) -> Network:
    """Adaptive moment steps over shuffled batches, languages weighted alike, with a rate that falls to nothing."""
    net, random = Network.fresh(langs), np.random.default_rng(5)
    weight = (1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y]
    mean = {k: np.zeros(v.shape) for k, v in net.weights.items()}
    square = {k: np.zeros(v.shape) for k, v in net.weights.items()}
    steps, step = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), batch):
            chosen, step = order[at : at + batch], step + 1
            _, gradient = net.gradient(x[chosen], y[chosen], weight[chosen])
            for k, g in gradient.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                net.weights[k] -= (rate * (1 - step / (steps + 1)) * move).astype(np.float32)
    net._tables = None
    return net


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows from ``starts`` on, ASCII capitals made small; bytes from ``ends`` on are zero."""
    at = starts[:, None] + np.arange(WINDOW)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(at < ends[:, None], _SMALL[data[np.minimum(at, len(data) - 1)]], 0)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, *, per_class: int = 1_500, classes: int = 256, per_text: int = 3) -> Network | None:
    """The network for (doc_id, text, lang), from rows that are not held out; None where there is nothing to learn."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    met = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted(r["lang"] for r in met.orderBy(F.desc("n"), "lang").limit(classes).collect())
    if not langs:
        return None
    picked = _least_hashes(known.filter(F.col("lang").isin(langs)), per_class)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(lang, w) for lang, text in zip(b["lang"], b["text"], strict=True) for w in pieces(bytes(text), per_text)]
            yield pd.DataFrame(found, columns=["lang", "piece"])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((lang, bytes(piece)) for b in batches for lang, piece in zip(b["lang"], b["piece"], strict=True))
        data = np.frombuffer(b"".join(piece for _, piece in rows), np.uint8)
        ends = np.cumsum([len(piece) for _, piece in rows])
        x = cut(data, ends - [len(piece) for _, piece in rows], ends).astype(np.uint8)
        yield pd.DataFrame({"net": [fit(x, np.searchsorted(langs, [lang for lang, _ in rows]), langs).saved()]})

    sample = picked.select("lang", F.col("text").cast("binary").alias("text")).mapInPandas(windows, "lang string, piece binary")
    return Network.loaded(bytes(sample.repartition(1).mapInPandas(fitted, "net binary").first()["net"]))


def _least_hashes(known: DataFrame, per_class: int, bins: int = 1 << 12) -> DataFrame:
    """At most ``per_class`` rows of each language, those of least hash of doc_id.

    Counts in bins of the hash say in which bin the last row wanted lies. Only rows up to that bin are ranked, and each
    task ranks ``per_class`` of its own at most before they meet, however many rows share an id.
    """
    h = F.xxhash64("doc_id")
    binned = known.select("lang", "text", h.alias("_h"), F.shiftrightunsigned(h, 64 - (bins - 1).bit_length()).alias("_bin"))
    last: dict[str, tuple[int, int]] = {}
    counts = binned.groupBy("lang", "_bin").agg(F.count(F.lit(1)).alias("n"))
    for r in sorted(counts.collect(), key=lambda r: r["_bin"]):  # classes * bins rows at most
        _, n = last.get(r["lang"], (0, 0))
        if n < per_class:
            last[r["lang"]] = (r["_bin"], n + r["n"])
    edges = known.sparkSession.createDataFrame([(lang, at) for lang, (at, _) in last.items()], "lang string, _last long")
    order = Window.partitionBy("lang").orderBy("_h", F.xxhash64("text"))
    near = binned.join(F.broadcast(edges), "lang").filter("_bin <= _last")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_class).select("lang", "text")


def pieces(text: bytes, per_text: int) -> list[bytes]:
    """Windows spread evenly over a text, and a short piece of it as short texts are."""
    room = max(0, len(text) - WINDOW)
    at = sorted({room * k // max(1, per_text - 1) for k in range(per_text)})
    short = len(text) % 37 + 8
    begin = len(text) // 3
    return [text[a : a + WINDOW] for a in at] + [text[begin : begin + short]]


def predict(docs: DataFrame, net: Network | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with lang_pred and score of the whole text."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(quoted(c)) for c in names]).schema.add("lang_pred", "string").add("score", "double")
    stored = net.saved() if net is not None else None  # some 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.loaded(stored) if stored is not None else None
        for b in batches:
            texts, letters = b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = judge(network, texts, letters)
            kept = [b.column(i) for i in range(b.num_columns - 2)]
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*names, "lang_pred", "score"])

    body = F.col(quoted(text))
    return docs.select(
        *[F.col(quoted(c)) for c in names], body.cast("binary").alias("_li_text"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("_li_letters")
    ).mapInArrow(run, schema)


def judge(net: Network | None, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow array of bytes, its windows scored in batches."""
    n = len(texts)
    if net is None or not letters.any():
        return [UNKNOWN] * n, np.zeros(n)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    size = np.where(letters, np.diff(offsets), 0)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(n), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    starts, ends = offsets[row] + place * WINDOW, (offsets[:-1] + size)[row]
    total = np.zeros((n, len(net.langs)))
    for at in range(0, len(row), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        p = net.probabilities(cut(data, starts[part], ends[part])) * np.minimum(WINDOW, ends[part] - starts[part])[:, None]
        np.add.at(total, row[part], p)
    mean = total / np.maximum(size, 1)[:, None]
    best = mean.argmax(axis=1)
    lang = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
    return lang, np.clip(np.where(letters, mean[np.arange(n), best], 0.0), 0.0, 1.0)


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text of a table (doc_id, text, lang)."""
    net = train(docs.select("doc_id", "text", "lang"), **sample)
    judged = predict(docs.select("doc_id", "text"), net, keep=["doc_id"])
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
