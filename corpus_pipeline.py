"""Raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor has written, works on all of it and, but for the last, returns
documents with their columns:

1. quality rules: rejected documents go;
2. quality classifier: rejected documents go;
3. near-dedup by SimHash and by 5-word Jaccard of 0.8 or more: one document of each group stays;
4. secret scan: every span becomes ``[kind]``;
5. best-fit packing: one row for each piece, with its token ids, sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postflow.llm import byte_cnn, packing, quality_rules, secret_scan, shingle_join
from postflow.llm.encoders import added_tokens
from postflow.llm.queries import pattern, vocabulary
from postflow.llm.tables import stored, table


def follow_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Learned from all labelled documents: those that the rules have left are nearly all of one label.
    return byte_cnn.keep(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), with_ids=True,
                          added=added_tokens(vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", follow_rules),
    ("quality_classifier", classify),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: Token ids and trained weights have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
