"""How hits are shown: snippets, highlights, inferred responses, normalised scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

# What marks an excerpt that starts with metadata, and how far it is looked for.
PREFIX_CHARS = 140
PREFIX_START = r"(?U)^\d+\s+\d+"
PREFIX_MARKS = [r"\$\d+k?", "Weekly", "Monthly", "No food restrictions", r"\b(California|West)\b"]
MARK_OPEN, MARK_CLOSE = '<mark class="search-hit">', "</mark>"


def has_metadata_prefix(c: Column) -> Column:
    """Does a text start with concatenated metadata rather than narrative?"""
    head = F.substring(c, 1, PREFIX_CHARS)
    return F.coalesce(head.rlike(PREFIX_START) & head.rlike("|".join(f"(?:{m})" for m in PREFIX_MARKS)), F.lit(False))


def _inside(body: Column) -> Callable[[Column], Column]:
    return lambda sentence: body.contains(T.strip(sentence))


def inferred_response(quote: Column, responses: list[Column], matching: Column | None = None) -> Column:
    """The number of the first response, from 1, that holds the quote or one of the matching sentences."""
    out = None
    for k, r in enumerate(responses, 1):
        body = T.strip(r)
        there = body.contains(T.strip(quote))
        if matching is not None:
            there = there | F.exists(matching, _inside(body))
        found = F.coalesce((F.length(body) > 0) & there, F.lit(False))
        out = F.when(found, k) if out is None else out.when(found, k)
    return out


def matching_sentences(c: Column, terms: list[str]) -> Column:
    """Sentences that hold a variant of a term as a whole word."""
    wanted = sorted({v for t in terms for v in T.variants(t)})
    if not wanted:
        return F.array().cast("array<string>")
    return F.filter(T.sentences(c), lambda s: F.arrays_overlap(T.tokens(s), F.array(*map(F.lit, wanted))))


def snippet(c: Column, terms: list[str], first: int = 5) -> Column:
    """Up to five matching sentences; else the first two, or 400 characters of a text of one sentence."""
    found, every = matching_sentences(c, terms), T.sentences(c)
    head = F.concat(F.left(c, F.lit(400)), F.when(F.length(c) > 400, F.lit("...")).otherwise(F.lit("")))
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, first), " ")).when(F.size(every) >= 2, F.array_join(F.slice(every, 1, 2), " ")).otherwise(head)


def escaped(c: Column) -> Column:
    """HTML-escaped, quotes too."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def highlighted(c: Column, terms: list[str]) -> Column:
    """Escaped text in which whole-word variants of the terms are marked, longest first."""
    wanted = sorted({v for t in terms for v in T.variants(t)}, key=lambda v: (-len(v), v))
    if not wanted:
        return escaped(c)
    return F.regexp_replace(escaped(c), rf"(?iU)\b({'|'.join(wanted)})\b", f"{MARK_OPEN}$0{MARK_CLOSE}")


def normalized_score(kind: Column, score: Column, max_fulltext: Column, c: Column, query: str) -> Column:
    """0 to 1 from a hit's own score, lifted for whole-word and phrase matches of the query, lowered for hits
    that hold none of its terms."""
    terms, phrases = T.query_words(query), T.quoted_phrases(query)
    single = len(terms) == 1 and not phrases
    words = T.tokens(c)
    score = F.coalesce(score, F.lit(0.0))
    relative = F.when(max_fulltext > 0, score / max_fulltext).otherwise(score / 10.0)
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(kind == "semantic", score).otherwise(relative)))
    hits, phrase = T.match_count(words, terms), T.phrase_match(c, phrases)
    full = F.when(kind == "fulltext", 0.03).otherwise(0.0)
    boost = F.when(phrase, 0.25).when((hits == len(terms)) & F.lit(bool(terms)), 0.18).when(hits > 0, 0.10).otherwise(0.0) + full
    miss = F.lit(bool(terms)) & (hits == 0) & ~phrase
    factor = F.when(miss & (kind == "semantic"), 0.55 if single else 0.75).when(miss & (kind == "fulltext"), 0.45 if single else 0.7).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * factor + boost))


def with_normalized_scores(hits: DataFrame, query: str, fulltext: DataFrame | None = None) -> DataFrame:
    """Adds normalized_score to hits (search_type, score, text). The largest full-text score of the result
    list is one aggregate, joined back as a single row; ``fulltext``, if given, holds the full-text hits with
    their score, so the list need not be made twice for it."""
    scores = F.col("score") if fulltext is not None else F.when(F.col("search_type") == "fulltext", F.col("score"))
    top = (hits if fulltext is None else fulltext).agg(F.coalesce(F.max(scores), F.lit(1.0)).alias("__max"))
    return hits.join(F.broadcast(top)).withColumn("normalized_score", normalized_score(F.col("search_type"), F.col("score"), F.col("__max"), F.col("text"), query)).drop("__max")


def _semantic_score() -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))


def semantic_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    """What ``score_threshold`` does to semantic hits, whose scores do not depend on other hits."""
    if not threshold or threshold <= 0:
        return hits
    return hits.where((F.col("search_type") != "semantic") | (_semantic_score() >= threshold))


def score_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits whose score, semantic as it is and full-text as a share of the largest, reaches the threshold; in
    every search mode. No threshold, or one of 0, keeps all."""
    if not threshold or threshold <= 0:
        return hits
    top = hits.agg(F.coalesce(F.max(F.when(F.col("search_type") == "fulltext", F.col("score"))), F.lit(0.0)).alias("__max"))
    share = F.when(F.col("__max") > 0, F.col("score") / F.col("__max")).otherwise(0.0)
    value = F.when(F.col("search_type") == "fulltext", share).otherwise(_semantic_score())
    return hits.join(F.broadcast(top)).where(value >= threshold).drop("__max")


def prevalence_histogram(hits: DataFrame, key: Column, bins: int = 30) -> DataFrame:
    """bin, low, high, participants: participants by their best normalised score, empty bins included."""
    best = hits.where(key.isNotNull()).groupBy(key.cast("string").alias("__key")).agg(F.greatest(F.max("normalized_score"), F.lit(0.0)).alias("s"))
    counts = best.groupBy(F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = hits.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.round(F.col("bin") / bins, 6).alias("low"), F.round((F.col("bin") + 1) / bins, 6).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("participants"))


def ranked(df: DataFrame, *order: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """With 1, 2, 3... in an order, within groups if given."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return df.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("long"))


def best(df: DataFrame, *order: Column, limit: int | None = None, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows in an order with 1, 2, 3... Without a limit all rows, with numbers that grow in
    the order but have gaps: they are given out in the tasks of the sort, so none holds all rows."""
    if limit is None:
        return df.orderBy(*order).withColumn(name, F.monotonically_increasing_id() + 1)
    return ranked(df.orderBy(*order).limit(limit), *order, name=name)
