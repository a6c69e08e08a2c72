"""Corpus cleaning pipeline over ``documents``: five stages, each a table that the next one reads.

1. quality: documents that the factorisation machine scores under the threshold go.
2. near_duplicates: of each SimHash class (3-word shingles, at most 3 differing bits) the smallest doc_id stays.
3. repeated_passages: bytes covered by a repeated 100-byte string are cut; a document whose bytes are all cut goes.
4. decontamination: documents that hold a benchmark item go.
5. pieces: whole texts as SentencePiece ids, with the decoded text's digest.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the
columns of ``documents``. Rows of one doc_id share their fate in the stages that drop documents; stage 2 keeps one of
repeated rows; a null text passes as an empty one; a row without doc_id is never dropped by
the quality and decontamination stages' joins (nulls match nothing). An empty table passes through all stages.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkmem.llm.common import read_table, written  # noqa: E402
from sparkmem.llm.decontaminate import find_leaks  # noqa: E402
from sparkmem.llm.pieces import encode_checked  # noqa: E402
from sparkmem.llm.quality import score  # noqa: E402
from sparkmem.llm.queries import QUALITY_THRESHOLD, quality_model, tokenizer_path  # noqa: E402
from sparkmem.llm.simhash import near_duplicates  # noqa: E402
from sparkmem.llm.suffix import deduplicate  # noqa: E402
from sparkmem.session import apply_runtime_conf, ensure_checkpoint_dir, ship_package  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _prepare(spark: SparkSession) -> None:
    apply_runtime_conf(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is under the threshold (learned outside the held-out fold)."""
    _prepare(spark)
    rows = _ids(docs)
    low = (score(rows, quality_model(spark, rows, sf_dir)).groupBy("id").agg(F.max("score").alias("score"))
           .where(F.col("score") < QUALITY_THRESHOLD).select(F.col("id").alias("doc_id")))
    return docs.select(COLUMNS).join(low, "doc_id", "left_anti").select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each SimHash class."""
    _prepare(spark)
    classes = near_duplicates(_ids(docs))
    others = classes.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    docs = docs.select(COLUMNS)
    # doc_ids that stand in several rows (none in a clean corpus): repeated rows become one
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(others.unionByName(twice).distinct(), "doc_id", "left_anti")
    repeated = docs.join(twice, "doc_id", "left_semi").join(others, "doc_id", "left_anti").distinct()
    return once.select(COLUMNS).unionByName(repeated.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; documents of which nothing remains go."""
    _prepare(spark)
    out = deduplicate(docs.select(COLUMNS), "doc_id", "text", with_text=True)
    return (out.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", F.col("kept_text"))
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    _prepare(spark)
    found = find_leaks(_ids(docs), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.select(COLUMNS).join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every remaining text."""
    _prepare(spark)
    out = encode_checked(_ids(docs), tokenizer_path("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), F.size("piece_ids").alias("n_pieces"), "piece_ids", "decoded_sha256", "round_trip")


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("pieces", pieces)]

#: The stages learn a model, hash fingerprints bit by bit and encode pieces: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's table is written to the shared folder and read again."""
    _prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
