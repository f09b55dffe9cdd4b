"""Corpus pipeline: toxicity, line dedup, near-dedup, source mixing, packing.

Each stage reads what its predecessor wrote as Parquet. All but the last return the columns of
``documents``; the last returns the packed pieces. Line dedup comes before near-dedup, as the order of
the stages was given: near copies whose common lines it has removed then have little left in common.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import line_dedup, minhash, mixing, packing, toxicity
from loomwright.session import remove, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null and empty texts score low and stay, as do their repetitions; an empty table gives none.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without duplicate lines; a document goes only if duplicates were all that it had.

    n_chars follows the text where that changes. Null and empty texts and rows with a null doc_id stay as
    they are; equal rows lose the same lines; columns may have any names.
    """
    counts = ("_" * (1 + max(map(len, docs.columns))), "_" * (2 + max(map(len, docs.columns))))
    out = line_dedup.dedup_lines(docs, counts=counts)
    changed = F.col(counts[1]) > 0
    shown = {c: F.col(f"`{c}`") for c in docs.columns}
    if "n_chars" in shown:
        shown["n_chars"] = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~changed | F.col("text").rlike(r"\S")).select(*[v.alias(c) for c, v in shown.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of the least doc_id.

    Rows of one doc_id with different texts are documents of their own; of equal rows one stays. Null
    texts and rows with a null doc_id stay.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one taken in part stays if at least half is taken.

    Documents without words, null texts too, have nothing to take and go; a null source is one of its own.
    """
    return mixing.repeat(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of near-equal length; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Scores of a trained model, signatures and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one is the result and stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            remove(spark, before)
        before = here
    return docs
