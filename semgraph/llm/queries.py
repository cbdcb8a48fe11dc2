"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.llm import (
    chat, fingerprints, graph_search, hard_negatives, jaccard, language_id, language_model, lines, mixing, packing,
    ranked_search, sharding, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return graph_search.neighbours(spark, vectors, vectors.filter(F.col("id") % 20 == 0), k=20)


@query
def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trial = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", trial), (-7, 1, "assistant", trial)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_chats(turns.unionByName(extra), vocabulary), vocabulary).drop("n_ids")


def _escapes(value: str) -> str:
    """SQL: how many signs escaping adds to a text."""
    times = lambda part: f"(length({value}) - length(replace({value}, '{part}', ''))) // {len(part)}"
    return " + ".join(times(part) for part in (chat.ESCAPE, *chat.GUARDED))


ORACLES["op2_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.ROLE_TEXT + chat.SEP_TEXT + chat.END_TEXT)} + length(role) + length(text) + {_escapes("role")} + {_escapes("text")}) AS BIGINT)
    AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(spark, documents(spark, folder), vocabulary, public_tokenizers.PATTERN, tokenizer=tokenizer)


@query
def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.model_scores(spark, documents(spark, folder))


@query
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_table(spark, f"{folder}/documents.parquet", 24, seed=6)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sharding_sql(shards: int, seed: int) -> str:
    """The same network in SQL for a table that lies in the order of its doc_id (a test; DuckDB has no crc32 for the rest)."""
    prime, step = sharding._PRIME, sharding._STEP
    ctes = ["n AS (SELECT count(*) AS n, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS a FROM documents)",
            "s AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM n)",
            "r0 AS (SELECT d.doc_id, d.text, row_number() OVER (ORDER BY d.doc_id) - 1 AS p, s.* FROM documents d, s)"]
    for walk in range(6):
        ctes.append(f"w{walk}_0 AS (SELECT *, p % a AS l, p // a AS r FROM r{walk})")
        for i, key in enumerate(sharding.round_keys(seed)):
            mine, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
            x = f"(({other} + {key}) % {prime})"
            y = f"((({x} * {x}) % {prime} * {step} + {key}) % {prime})"
            ctes.append(f"w{walk}_{i + 1} AS (SELECT * REPLACE (({mine} + ({y} * {y}) % {prime}) % {size} AS {mine}) FROM w{walk}_{i})")
        inside = "" if walk == 0 else "CASE WHEN p < n THEN p ELSE "
        ctes.append(f"r{walk + 1} AS (SELECT doc_id, text, {inside}r * a + l{' END' * bool(inside)} AS p, n, a, b FROM w{walk}_{sharding.ROUNDS})")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard,
  CAST(p // {shards} AS BIGINT) AS slot FROM r6"""


@query
def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(spark, documents(spark, folder))


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    clean = lines.drop_repeated_lines(spark, documents(spark, folder))
    return clean.select("doc_id", "text", "n_lines", "n_removed")


@query
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edited(spark, documents(spark, folder))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "source")
    mixed = mixing.mix(spark, docs, budget_ratio=1.0, entropy_share=0.97, max_repeats=4.0, seed=7)
    return mixed.select("doc_id", "source", "n_tokens", "weight", "copy", "stretch", "slot")


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh row carries the next label; every hundredth row is an anchor."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(spark, rows, F.col("id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5"""


@query
def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(documents(spark, folder))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(spark, documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
ORACLES["op13_ranked_search"] = f"""
WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM c, s WHERE term IN (SELECT term FROM i) GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN c USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10"""


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
