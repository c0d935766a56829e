"""The corpus pipeline: from raw documents to a mixed, encoded training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows without an id are kept or dropped like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlog.llm import lines, mixing, ngram_join, pieces, toxicity
from factlog.llm.common import packed, stored, table, unpacked
from factlog.llm.queries import piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    rows = toxicity.scored(docs, table(spark, sf_dir, "labels")).filter("score < 0.5")
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all its lines stays, as an empty text."""
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document with the smallest id stays, and of repeated rows one; ids may repeat with other texts."""
    kept = ngram_join.joined(docs).filter("kept").select(F.xxhash64("id", "key").alias("_place"))
    rows = docs.select(packed(docs), F.xxhash64(F.col("doc_id").cast("long"), ngram_join.text_key("text")).alias("_place"))
    return unpacked(rows.join(kept, "_place", "left_semi").dropDuplicates(["_place"]), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks for, or not at all."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, score, lossless."""
    rows = pieces.encoded(docs, piece_model())
    return rows.select(F.col("id").alias("doc_id"), F.size("pieces").cast("long").alias("n_pieces"), "pieces", "score", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram join", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: No SQL for boosted trees or segmentation; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "pipeline")
    return docs
