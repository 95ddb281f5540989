"""A training corpus from raw documents, stage by stage: each takes what its predecessor kept, written and read again.

Rules of every stage, beside those of its operator: a null text counts as empty; a null id is no other document's copy and is
kept; rows that repeat an id are judged one by one; a text of any length is read whole; all but the last return the columns of
documents and any others that came, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import bpe, line_dedup, mixing, simhash, toxicity
from notemill.llm.common import shared_folder, table

#: Toxicity is learned, so SQL cannot give run()'s rows; the stages are tested one by one, against brute force and planted cases.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier of toxicity rejects. It learns from the training folds of the labels. Documents without
    words get the score of the intercept, and stay unless most labels are toxic; without labels of both classes all score alike."""
    classifier = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs.select(F.struct("*").alias("row"), "text"), classifier)
    return scored.where("score < 0.5").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one has; n_chars follows the text. A text that loses all lines is empty;
    rows without an id keep all of theirs."""
    found = line_dedup.dedup_lines(docs)
    kept = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return found.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: texts whose SimHash fingerprints differ in 3 of 64 bits at
    most, as op8 links them. Rows that repeat the smallest id of a group stay together; texts without words have fingerprint zero
    and are linked by it like any other; rows without an id stay."""
    groups = simhash.near_duplicates(docs).where("component_id < id").select(F.col("id").alias("_copy")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["_copy"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, as often as it takes them; rows without words stay once. A null source is one
    of its own; equal rows are taken one by one."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of every document; none for an empty text."""
    encoded = bpe.encode_documents(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
