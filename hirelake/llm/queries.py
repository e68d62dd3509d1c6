"""One query per operator over its whole table, and the SQL it must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import alignment, backoff, jaccard, mixing, negatives, packing, pii, quality, quotes, substrings, token_output, toxicity, vectors
from hirelake.llm.quotes_sql import QUOTES_SQL
from hirelake.session import run_folder

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def installed(name: str) -> str:
    """A tokenizer's file; installed with the machine, not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_50k() -> str:
    return installed("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, folder, "documents"), bpe_50k())


@query("op2_substring_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_passages_removed(table(spark, folder, "documents")).drop("kept_text")


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, folder, "documents")).drop("fp")


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_quotation_linking", QUOTES_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.linked_messages(table(spark, folder, "conversations"))


MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         coalesce(doc_id % 64, 0) AS part
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER e, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0)) AS level
  FROM s WINDOW e AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size <= level * w AS capped FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 3 * source_size ELSE
           w * ((sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())
                / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target,
         ('0x' || md5('17:' || coalesce(source, chr(0)))[1:8])::BIGINT / 4294967296.0 AS u
  FROM c),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.part, d.doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies FROM r)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 3) AS target, copies * size::BIGINT AS taken, copies FROM n
"""


@query("op6_source_mixing", MIXING_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.mixed_sizes(table(spark, folder, "documents"))
    return sizes.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", "copies")


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_token_id_output")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark, "token-ids")
    token_output.write_token_files(table(spark, folder, "documents"), path, bpe_50k())
    return spark.read.schema(token_output.ROWS).parquet(path)


@query("op9_personal_data")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, folder, "embeddings"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, v.k, v.vec_id, v.label = a.label AS same,
         list_sum(list_transform(list_zip(a.q, v.q), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.k <> a.k),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, k) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.k)::INT AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = negatives.integer_vectors(table(spark, folder, "embeddings"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op12_language_model_scores")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.language_model_scores(table(spark, folder, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned_tokens(table(spark, folder, "documents"), bpe_50k(), installed("piece_bpe_32k.model"))
