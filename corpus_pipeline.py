"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage
before it kept.  A stage's result is written as Parquet in the shared folder and
read again as the next stage's documents.

Every stage takes an empty table (its result is empty, with the same columns),
documents whose extra columns have any names, and texts of any length.  What
each does with nulls, empty texts, ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keylattice.llm import decontam, packing, quality, secrets, simhash
from keylattice.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rule rejects go.

    Null and empty texts have no n-grams and stay; a null ``doc_id`` is judged
    like any other; repeated rows are judged each on its own and alike; a score
    equal to the threshold stays; very long texts are scored whole; an empty
    labels table rejects nothing; all columns are passed on unread.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates stays: the smallest (``doc_id``, text hash).

    Null and empty texts and texts without a word duplicate nothing and stay,
    and so does every row with a null ``doc_id``; of rows with one id and one
    text (with a word) one stays; an id with two texts is two texts; very long
    texts are fingerprinted whole; all columns are passed on.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain nothing and stay; a row with a null ``doc_id``
    cannot be named and stays; rows that share an id go together; repeated rows
    share their fate; a window that holds exactly the required share counts as
    containing; very long texts are searched whole; an empty benchmark, or one
    of null items, removes nothing; all columns are passed on.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; reported secrets are replaced in its text.

    Null and empty texts and null ids stay as they are; repeated rows are
    redacted alike; where two rules claim one stretch, the stronger, longer,
    earlier one wins; very long texts and values are scanned and replaced
    whole; ``n_chars``, where it is an integer column, is counted again for
    changed texts; all other columns are passed on.
    """
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' token sequences.

    Null and empty texts have no tokens and give no piece; a null ``doc_id`` is
    carried as null; repeated rows give their pieces each; equal lengths keep
    the order of the text; very long texts give as many longest pieces as they
    need; no other column is read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL can express neither the first stage's hashed features nor the last one's byte-pair token ids: tests/llm/test_pipeline.py
#: compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
