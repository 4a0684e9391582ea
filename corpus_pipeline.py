"""The corpus pipeline: quality, line dedup, near-duplicate documents, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of ``documents``; ``run`` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import WORD
from textloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_bayes
from textloom.llm.common import materialize, scratch, small_or_shuffled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Documents without words, null and empty texts included, go. Repeated rows are judged alike and stay
    repeated. A null id, source or lang is fine. Without labels of both kinds all documents with words stay;
    an empty table stays empty."""
    judged = quality_bayes.classify(docs, _table(spark, sf_dir, "labels"))
    return judged.where("qb_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that lose lines and have no line with a word left go.

    Null and empty texts have no lines and stay. Of rows with equal lines the one with the smallest id keeps
    them, then the one with the smallest hash of its text; rows equal in id and text are treated alike. A null
    id comes last. An empty table stays empty."""
    clean = line_dedup.dedup_lines(docs)
    return clean.where((F.col("ld_exact") + F.col("ld_near") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Rows alike in id and text become one. Rows
    without an id stay. Null, empty and blank texts are in no group; an empty table stays empty."""
    found = materialize(ngram_join.near_duplicates(docs), "near")
    # The ids that go are fewer than the documents, and narrow.
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    gone = small_or_shuffled(materialize(gone, "gone"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go.

    Null and empty texts and ids, and repeated rows, stay as they are; null items hit nothing. An empty table,
    or an empty benchmark, changes nothing."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into windows.

    A null or empty text is its end id alone, a null id stays null, repeated rows are packed as often as they
    come, and an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: SQL cannot express the fitted classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{k}"))
    return STAGES[-1][1](spark, docs, sf_dir)
