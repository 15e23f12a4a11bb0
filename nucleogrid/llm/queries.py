"""The queries of this subpackage and, where SQL can express one, its equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, langid, licenses, mixing, near_dup_vectors, ngram_join, quality, token_counts, token_output, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.write_sequences(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_output.read_digests(files)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 3) != 1)
    return langid.identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_vectors.vector_components(table(spark, sf_dir, "embeddings"), 0.98)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_output, op2_decontamination, op3_ngram_jaccard, op4_language_id, op5_token_counts, op6_source_mixing, op7_embedding_near_dups, op8_quality, op9_warc_archive, op10_license_scan, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_warc_archive": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha256(b) AS h FROM p),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
            SELECT page_id, n AS payload_bytes, h AS payload_digest,
                   CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
            FROM f""",
    }
