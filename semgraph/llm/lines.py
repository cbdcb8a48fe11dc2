"""Removal of repeated passages by overlapping windows of three pieces.

A piece is a line, or what a longer line is cut into: its sentences (up to ``.``, ``!`` or ``?`` before white space),
and of a longer sentence runs of 16 words. So a passage of more than 48 words that begins with a line or a sentence
has three pieces at least and thus a window, on however few lines it stands. Windows run over the pieces that are not
blank, compared without trailing white space. One that holds parts of lines counts only if it has 60 characters or
more, so that no run of tiny sentences is taken for a passage; three whole lines always count.

A window that occurs more than once keeps its first occurrence, by (doc_id, place); pieces under a later occurrence
go, and a line goes with the last of its pieces. Overlapping later windows cover a passage together, so a passage of
any length goes whole; a sentence of which it holds a part only stays. A later occurrence that overlaps its own first
one takes only the pieces beyond it: of a line repeated over and over, three stay.

Texts of fewer than three pieces have no window and stay as they are, as do null and empty texts. A null doc_id
is the first. Rows repeating a doc_id with the same text are one document: none of them counts as later.
Blank lines stay. Other columns are kept; names starting with ``_ld_`` are used here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from semgraph.functions.scratch import Scratch
from semgraph.llm.text import mixed

WINDOW = 3
#: Words of a sentence taken as one piece, and characters that a window of parts of lines must hold.
RUN, LEAST = 16, 60
#: A piece with the white space around it: words up to the end of a sentence, else a run of words.
PIECE = re.compile(rf"\s*+(?:(?:\S++\s*+){{0,{RUN - 1}}}?\S*+(?<=[.!?])(?:\s++|$)|(?:\S++\s*+){{1,{RUN}}})", re.ASCII)
#: Texts cut and hashed at a time.
SLICE = 1_000
SPACE = " \t\r\x0b\f"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(line: str) -> list[str]:
    """What a line is cut into; joined they are the line. A blank line is one piece."""
    return PIECE.findall(line) or [line]


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per window: doc_id, _ld_text, at (number of its first piece that is not blank), 128 bits of hash of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole_batch.slice(at, SLICE) for whole_batch in batches for at in range(0, whole_batch.num_rows, SLICE)):
            marks, sizes, whole, counts = [], [], [], []
            for text in b.column(2):
                before = len(sizes)
                for line in (text.as_py() or "").split("\n"):
                    cut = pieces(line)
                    for piece in cut:
                        if solid := piece.rstrip(SPACE):
                            marks.append(xxhash.xxh3_128_digest(solid.encode()))
                            sizes.append(len(solid))
                            whole.append(len(cut) == 1)
                counts.append(len(sizes) - before)
            n = len(sizes) - width + 1
            if n < 1:
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes, h = np.frombuffer(b"".join(marks), "<u8").reshape(-1, 2), np.zeros((n, 2), np.uint64)
            size, lines = np.zeros(n, np.int64), np.ones(n, bool)
            for k in range(width):
                h = mixed(h * _ODD + hashes[k : k + n])
                size += np.array(sizes[k : k + n])
                lines &= np.array(whole[k : k + n])
            inside = (row[:n] == row[width - 1 :]) & (lines | (size >= LEAST))
            of, h = pa.array(row[:n][inside]), h[inside].view(np.int64)
            columns = [b.column(0).take(of), b.column(1).take(of), pa.array(at[:n][inside].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(h[:, i])) for i in (0, 1))], ["doc_id", "_ld_text", "at", "h1", "h2"])

    rows = docs.select("doc_id", "_ld_text", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _ld_text long, at int, h1 long, h2 long")


def covered(spark: SparkSession, docs: DataFrame, scratch: Scratch, width: int = WINDOW) -> DataFrame:
    """doc_id, _ld_text and ``_ld_gone``: the pieces to remove, by their numbers among those that are not blank."""
    found = scratch.save(windows(docs, width), "windows")
    repeated = found.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("h1", "h2", "first")
    repeated = scratch.save(repeated, "repeated")
    late = found.join(repeated, ["h1", "h2"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    late = late.filter(~(same & (F.col("at") == F.col("first.at"))))
    start = F.when(same, F.greatest(F.col("at"), F.col("first.at") + width)).otherwise(F.col("at"))
    spans = late.select("doc_id", "_ld_text", start.alias("lo"), (F.col("at") + width - 1).alias("hi")).filter("lo <= hi")
    return spans.groupBy("doc_id", "_ld_text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("lo", "hi"))))).alias("_ld_gone")
    )


def without(text: str, gone: set[int]) -> str:
    """A text less some of its pieces, by their numbers among those that are not blank."""
    left, number = [], 0
    for line in text.split("\n"):
        kept, cut = [], pieces(line)
        for piece in cut:
            solid = bool(piece.rstrip(SPACE))
            if not solid or number not in gone:
                kept.append(piece)
            number += solid
        if kept:
            left.append("".join(kept))
    return "\n".join(left)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without(t, set(g.tolist())) for t, g in zip(texts, gone, strict=True)], dtype=object)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents with their texts less the removed pieces, ``n_lines`` before and ``n_removed`` pieces."""
    scratch = Scratch(spark, "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed") and not c.startswith("_ld_")]
    # a row is known by its id and text: rows alike in both are treated alike
    keyed = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("_ld_text", F.xxhash64("text"))
    gone = scratch.save(covered(spark, keyed, scratch, width), "gone").withColumnRenamed("doc_id", "_ld_doc").withColumnRenamed("_ld_text", "_ld_hash")
    # one plan at every size: rows with removed pieces grow with the table
    here = F.col("doc_id").eqNullSafe(F.col("_ld_doc")) & (F.col("_ld_text") == F.col("_ld_hash"))
    joined = keyed.join(gone.hint("merge"), here, "left")
    touched = F.col("_ld_gone").isNotNull()
    # texts of other rows do not go to Python
    text = F.when(touched, _without(F.when(touched, F.col("text")), F.col("_ld_gone"))).otherwise(F.col("text"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_ld_gone"), F.lit(0)).alias("n_removed"),
    )
