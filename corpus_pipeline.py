"""A corpus from raw documents: five stages, each on what the one before kept.

Each stage takes (spark, docs, sf_dir); between stages the rows are written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import language_id, mixing, sampled_pieces, simhash, stream_dedup
from spendlens.llm.common import written

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TARGET = mixing.Target(entropy=0.95, repeats=4.0)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no learned language go."""
    return language_id.reject_foreign(docs, language_id.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return stream_dedup.distinct_docs(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints are connected by at most 2 differing bits the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of sources has them; as many tokens as before."""
    return mixing.mix(docs, TARGET)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row."""
    samples = sampled_pieces.encode(docs, sampled_pieces.Pieces.load(PIECE_MODEL), k=2)
    return samples.select("doc.doc_id", "doc.source", "sample", "ids", "log_prob", "log_inclusion")


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", near_dedup),
    ("source_mixing", mixture),
    ("sampled_pieces", pieces),
]

#: The last stage samples by seeded hashes, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
