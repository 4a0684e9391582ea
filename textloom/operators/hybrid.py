"""Hybrid retrieval: merging semantic and full-text hits, and joining documents back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

HIT = ["id", "doc_id", "text", "score", "search_type", "is_chunk", "ordinal"]


def _has_term(c: Column, terms: list[str]) -> Column:
    words = T.tokens(c)
    out = F.lit(False)
    for t in terms:
        out = out | T.has_any(words, t)
    return out


def merge(semantic: DataFrame, fulltext: DataFrame, query: str) -> DataFrame:
    """Semantic hits, then full-text hits of documents that they do not cover (columns of HIT, and exact).

    A semantic hit covers its document only if it holds a whole-word variant of a query term, or the query
    has none. Hits are told apart by id, the first one stays. What is covered is a set of ids, so its
    anti-join needs no order."""
    terms = T.query_words(query, stop_words=False)
    first = Window.partitionBy("id").orderBy("ordinal", F.desc("score"))
    sem = semantic.withColumn("search_type", F.lit("semantic")).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    sem = sem.withColumn("exact", _has_term(F.col("text"), terms))
    covers = sem if not terms else sem.where("exact")
    seen = sem.select(F.col("id").alias("__id")).unionByName(covers.select(F.col("doc_id").alias("__id"))).distinct()
    full = fulltext.withColumn("search_type", F.lit("fulltext")).withColumn("is_chunk", F.lit(False)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    full = full.join(seen, F.col("id") == F.col("__id"), "left_anti").withColumn("exact", _has_term(F.col("text"), terms))
    return sem.select(*HIT, "exact").unionByName(full.select(*HIT, "exact"))


def order_of_hybrid() -> list[Column]:
    """Whole-word matches, then full-text over semantic, then the score; ties by source and place."""
    return [F.desc("exact"), F.desc(F.col("search_type") == "fulltext"), F.desc("score"), F.col("ordinal"), F.col("id")]


def with_full_text(hits: DataFrame, docs: DataFrame, aliases: list[str] | None = None) -> DataFrame:
    """Hits with ``full_text`` of their document: by doc_id, else by the first participant alias that fits.
    Which document that is, is found by ids alone; texts are joined last, so that none is shuffled for each hit.
    A document without a text is like one that is not there."""
    has, text_of = F.col("text").isNotNull(), lambda c: F.col(c).cast("string")
    there = docs.where(has & F.col("doc_id").isNotNull()).select(text_of("doc_id").alias("__doc")).distinct()
    out = hits.join(there, F.coalesce(text_of("doc_id"), text_of("id")) == F.col("__doc"), "left")
    for alias in [a for a in (aliases or []) if a in docs.columns and a in hits.columns]:
        first = F.min_by(F.struct(text_of("doc_id").alias("d"), has.alias("has")), "doc_id").alias("__first")
        other = docs.groupBy(text_of(alias).alias("__alias")).agg(first).where("__first.has").select("__alias", F.col("__first.d").alias("__other"))
        out = out.join(other, F.col("__doc").isNull() & (text_of(alias) == F.col("__alias")), "left")
        out = out.withColumn("__doc", F.coalesce("__doc", "__other")).drop("__alias", "__other")
    texts = docs.where(has).select(text_of("doc_id").alias("__of"), F.col("text").alias("full_text"))
    return out.join(texts, F.col("__doc") == F.col("__of"), "left").drop("__doc", "__of")
