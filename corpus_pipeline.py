"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of the documents.
What a stage returns is written to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.scratch import Scratch
from semgraph.llm import jaccard, lines, mixing, packing, toxicity

#: Mixing: target entropy as a share of the largest, and how often a document may be read.
ENTROPY_SHARE, MAX_REPEATS = 0.97, 2.0


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the table of labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.score(docs, *toxicity.train(toxicity.training_rows(docs, labels, folds=5, per_class=8_000)), column="_toxic")
    return judged.filter(F.col("_toxic") < 0.5).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go, and documents of which nothing is left; n_chars follows the text."""
    clean = lines.drop_repeated_lines(spark, docs)
    left = clean.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row of the least doc_id stays, and of repeated rows one.

    Rows are told apart by doc_id and text, so one row of a group stays also where ids are null (the last to be chosen) or
    repeated. Rows without words are linked with nothing and all stay.
    """
    groups = Scratch(spark, "near-duplicates").save(jaccard.similar(spark, docs.select("doc_id", "text")), "groups")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("_nd_key")
    grouped = groups.filter("group_id IS NOT NULL").groupBy("group_id")
    first = grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("r")).select("r.*")
    first = first.select(key, F.col("text_hash").alias("_nd_text"))
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.withColumn("_nd_key", key).withColumn("_nd_text", hashed)
    kept = rows.join(first, ["_nd_key", "_nd_text"], "left_semi").dropDuplicates(["_nd_key", "_nd_text"])
    wordless = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*_columns(docs)).unionByName(wordless)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by tempered weights: the largest is read once, smaller ones more often; every document is read."""
    mixed = mixing.mix(spark, docs, entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS, seed=7)
    return mixed.select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary, tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(spark, docs, vocabulary, public_tokenizers.PATTERN, tokenizer=tokenizer)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifying, mixing and token ids have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
