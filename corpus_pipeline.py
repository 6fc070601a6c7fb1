"""From raw documents to packed training sequences: quality, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.llm import jaccard, packing, quality, secrets_scan
from parcelworks.llm.common import light, save
from parcelworks.llm.queries import classifier, tokenizer

#: A document goes if its probability of being good is below this: one that is as likely good as bad stays.
REJECT_BELOW = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are scored like others."""
    return quality.keep_good(docs, classifier(spark, sf_dir), REJECT_BELOW)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones (five words, similarity of 0.8 or more): that with the least doc_id.

    Documents with an empty text are in no group and stay, as do rows with a null id; of rows that repeat an id all stay
    or go together, as the greatest of their texts says.
    """
    groups = save(jaccard.join_groups(docs, k=5, num=80, den=100).where("doc_id <> component_id").select("doc_id"), "duplicates")
    gone = F.broadcast(groups) if light(groups, jaccard.BROADCAST_MB) else groups
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    name = "found"
    while name in docs.columns:
        name += "_"
    clean = secrets_scan.find_secrets(docs, redact="[secret]", out=name).drop(name)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1,024 tokens, with the ids themselves."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("secret scans", secrets_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier, the tokenizer or the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
