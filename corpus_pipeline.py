"""A training corpus from the documents table, in stages that each use one operator of nucleogrid.llm.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as
the next stage's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nucleogrid.llm import decontaminate, mixing, ngram_join, quality, queries, token_output
from nucleogrid.llm.store import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score under 0.3."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"), F.lit(True))
    return quality.accepted(docs, model, 0.3)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of 5-word shingles are connected by similarities of 0.8 or more, keeps one with the smallest doc_id."""
    return ngram_join.deduplicated(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 60 % of a benchmark item's words or more."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings domains, languages and sources to their target weights; documents of small leaves may come twice."""
    return mixing.sample(docs)


def token_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token sequences and reads them back, one row for each document."""
    return token_output.read_digests(token_output.write_sequences(docs, queries.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("token-ID output", token_sequences),
]

#: Learned scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
