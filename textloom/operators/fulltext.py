"""Full-text search over the inverted index: BM25, conditions, phrases, fuzzy terms and the fallback."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.stem import porter
from textloom.operators.index import MIN_TOKEN, Index

K1, B = 1.2, 0.75


def query_terms(query: str, analyzer: str = "plain") -> list[str]:
    """Distinct analysed words of a query, in order."""
    words = re.findall(r"\w+", query.lower())
    if analyzer == "porter":
        words = [porter(w) for w in words if len(w) >= MIN_TOKEN and w not in T.STOP_WORDS]
    return list(dict.fromkeys(words))


def bm25(index: Index, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, term, score of matching postings. ``stats``: the rows of term_stats of their terms. Corpus sizes
    are one row, and document lengths are joined to matching rows only."""
    corpus = index.doc_stats.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    rows = postings.join(stats, "term").join(index.doc_stats, "doc_id").crossJoin(F.broadcast(corpus))
    idf = F.log(F.col("docs") / (F.col("df") + 1)) + 1
    tf = F.col("tf")
    return rows.select("doc_id", "term", (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("score"))


def _of_terms(index: Index, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of some terms. The statistics are a row for each, so they are broadcast: a
    frequent term's postings need not meet in one task."""
    wanted = F.col("term").isin(terms)
    return index.postings.where(wanted), F.broadcast(index.term_stats.where(wanted))


def search_terms(index: Index, terms: list[str], require_all: bool = True) -> DataFrame:
    """doc_id, score (6 decimals), matched: documents with all, or any, of the terms."""
    rows = bm25(index, *_of_terms(index, terms))
    out = rows.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("matched"))
    return out.where(F.col("matched") == len(terms)) if require_all else out


def top(hits: DataFrame, limit: int | None) -> DataFrame:
    """The best hits, ties by id; without a limit all of them, in no order. Sort and limit stay together, so
    each task keeps ``limit`` rows."""
    return hits if limit is None else hits.orderBy(F.desc("score"), "doc_id").limit(limit)


def _near(term: Column, word: str, distance: int) -> Column:
    """Edit distance within a bound; lengths, which are cheap, rule out most terms."""
    return F.length(term).between(len(word) - distance, len(word) + distance) & (F.levenshtein(term, F.lit(word), distance) >= 0)


# Conditions: what postings decide (Leaf, made by word, phrase, like, near and between), and lists of them, of which all,
# any or none hold. The index has one field, text.


@dataclass(frozen=True)
class Leaf:
    """One of: words in a row, a mask (* any characters, ? one), a word and its edits, bounds (both included; empty:
    open), or ``among``, terms of which any will do. ``boost`` multiplies the score of its terms."""

    words: tuple[str, ...] = ()
    mask: str | None = None
    fuzzy: tuple[str, int] | None = None
    bounds: tuple[str, str] | None = None
    among: tuple[str, ...] | None = None
    boost: float = 1.0

    def terms(self, term: Column) -> Column:
        if self.among is not None:
            return term.isin(list(self.among))
        if self.fuzzy:
            return _near(term, *self.fuzzy)
        if self.bounds:
            low, high = self.bounds
            return (term >= low if low else F.lit(True)) & (term <= high if high else F.lit(True))
        if self.mask is not None:
            start = re.split(r"[*?]", self.mask)[0]
            fits = term.rlike("^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in self.mask) + "$")
            return term.startswith(start) & fits if start else fits
        return term.isin(list(self.words))


@dataclass(frozen=True)
class Group:
    """``how``: all, any or none of the parts hold."""

    how: str
    parts: tuple[Condition, ...]


Condition = Leaf | Group


def word(text: str, boost: float = 1.0) -> Leaf:
    return Leaf(words=(text.lower(),), boost=boost)


def phrase(text: str, boost: float = 1.0) -> Leaf:
    """The words of a text, in a row."""
    return Leaf(words=tuple(re.findall(r"\w+", text.lower())), boost=boost)


def like(mask: str, boost: float = 1.0) -> Leaf:
    return Leaf(mask=mask.lower(), boost=boost)


def near(text: str, distance: int = 1, boost: float = 1.0) -> Leaf:
    return Leaf(fuzzy=(text.lower(), distance), boost=boost)


def between(low: str = "", high: str = "", boost: float = 1.0) -> Leaf:
    return Leaf(bounds=(low.lower(), high.lower()), boost=boost)


def all_of(*parts: Condition) -> Group:
    return Group("all", parts)


def any_of(*parts: Condition) -> Group:
    return Group("any", parts)


def none_of(*parts: Condition) -> Group:
    return Group("none", parts)


def typed(query: str) -> Group:
    """What a user types: all of its words and quoted phrases."""
    return all_of(*[phrase(q) if q else word(w) for q, w in re.findall(r'"([^"]*)"|(\w+)', query)])


def _analysed(condition: Condition, analyzer: str) -> Condition | None:
    """The condition on the index's terms, without parts that have no words; None if nothing is left."""
    if isinstance(condition, Group):
        parts = tuple(p for p in (_analysed(p, analyzer) for p in condition.parts) if p is not None)
        return Group(condition.how, parts) if parts else None
    if condition.mask is not None or condition.fuzzy or condition.bounds or condition.among is not None:
        return condition
    words = condition.words
    if analyzer == "porter":
        words = tuple(porter(w) for w in words if len(w) >= MIN_TOKEN and w not in T.STOP_WORDS)
    return replace(condition, words=words) if words else None


def _leaves(condition: Condition) -> list[Leaf]:
    return [condition] if isinstance(condition, Leaf) else [leaf for p in condition.parts for leaf in _leaves(p)]


def _holds(condition: Condition, flags: dict[Leaf, Column]) -> Column:
    if isinstance(condition, Leaf):
        return flags[condition]
    parts = [_holds(p, flags) for p in condition.parts]
    return ~_any(parts) if condition.how == "none" else _all(parts) if condition.how == "all" else _any(parts)


def _open(condition: Condition) -> bool:
    """Whether a document without any of the leaves' terms can match."""
    if isinstance(condition, Leaf):
        return False
    parts = [_open(p) for p in condition.parts]
    return not any(parts) if condition.how == "none" else all(parts) if condition.how == "all" else any(parts)


def _looked_up(index: Index, leaf: Leaf) -> Leaf:
    """A mask or a word with edits as the terms that fit, if the index has a dictionary and they are few."""
    found = index.dictionary.terms(leaf.terms, leaf.mask, leaf.fuzzy) if index.dictionary else None
    return leaf if found is None else Leaf(among=tuple(found), boost=leaf.boost)


def _followed(first: Column, rest: list[Column]) -> Column:
    """Is there a place in the first array from which the others go on, word by word?"""
    return F.exists(first, lambda p: _all([F.array_contains(r, p + k) for k, r in enumerate(rest, 1)]))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def search_where(index: Index, condition: Condition) -> DataFrame:
    """doc_id, score, matched: documents that meet a condition. The index decides all of it: one aggregate over
    the postings of its terms flags each leaf; phrases compare positions. A condition without words finds nothing."""
    condition = _analysed(condition, index.analyzer)
    if condition is None:
        return index.doc_stats.where("false").select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))
    t = F.col("term")
    leaves = {leaf: _looked_up(index, leaf) for leaf in _leaves(condition)}
    if all(leaf.words or leaf.among is not None for leaf in leaves.values()):
        found, stats = _of_terms(index, sorted({w for leaf in leaves.values() for w in leaf.among or leaf.words}))
    else:
        wanted = _any([leaf.terms(t) for leaf in leaves.values()])
        found, stats = index.postings.where(wanted), index.term_stats.where(wanted)
    flags, extra = {}, []
    for k, (named, leaf) in enumerate(leaves.items()):
        if len(leaf.words) > 1:
            for j, w in enumerate(leaf.words):
                extra.append(F.first(F.when(t == w, F.col("positions")), ignorenulls=True).alias(f"p{k}_{j}"))
            places = [F.coalesce(F.col(f"p{k}_{j}"), F.array().cast("array<int>")) for j in range(len(leaf.words))]
            flags[named] = _followed(places[0], places[1:])
        else:
            extra.append(F.max(leaf.terms(t)).alias(f"f{k}"))
            flags[named] = F.coalesce(F.col(f"f{k}"), F.lit(False))
    boost = F.greatest(*[F.when(leaf.terms(t), leaf.boost).otherwise(0.0) for leaf in leaves.values()], F.lit(0.0))
    scores = bm25(index, found, stats).select("doc_id", "term", (F.col("score") * boost).alias("score")).groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("matched"))
    flagged = found.groupBy("doc_id").agg(*extra).join(scores, "doc_id")
    if _open(condition):
        flagged = index.doc_stats.select("doc_id").join(flagged, "doc_id", "left")
    return flagged.where(_holds(condition, flags)).select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def search_query(index: Index, query: str) -> DataFrame:
    """doc_id, score, matched: documents with all typed words and quoted phrases."""
    return search_where(index, typed(query))


def fuzzy_distance(word: str, distance: int) -> int:
    """Edits allowed for a word: short words are taken exactly."""
    return 0 if len(word) <= 4 else min(distance, 1) if len(word) <= 6 else distance


def search_fuzzy(index: Index, query: str, distance: int = 1, scaled: bool = False) -> DataFrame:
    """doc_id, score, matched: documents with a term near each of the query's words. Edit distances are taken
    over the vocabulary, not over the postings."""
    words = [(w, fuzzy_distance(w, distance) if scaled else distance) for w in query_terms(query, index.analyzer)]
    if not words:
        return search_query(index, "")
    fits = [_near(F.col("term"), w, d) for w, d in words]
    leaves = [_looked_up(index, Leaf(fuzzy=x)) for x in words]
    if all(leaf.among is not None for leaf in leaves):
        some = F.col("term").isin(sorted({w for leaf in leaves for w in leaf.among}))
    else:
        some = _any(fits)
    close = index.term_stats.where(some).withColumn("words", F.array_compact(F.array(*[F.when(f, F.lit(w)) for f, (w, _) in zip(fits, words, strict=True)])))
    rows = bm25(index, index.postings.where(some), close).select("doc_id", "term", "score").join(close.select("term", F.explode("words").alias("word")), "term")
    out = rows.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count_distinct("word").alias("matched"))
    return out.where(F.col("matched") == len(words))


def search_phrase(index: Index, text: str) -> DataFrame:
    return search_where(index, phrase(text))


def narrowed(index: Index, query: str | Condition, keep: Callable[[DataFrame], DataFrame], distance: int = 2) -> Index:
    """The part of an index that ``search`` reads for a query: postings of terms that can match, and the documents'
    lengths. An index that is a plan over documents reads them for each use of a table, so ``keep`` keeps both."""
    condition = _analysed(typed(query) if isinstance(query, str) else query, index.analyzer)
    if condition is None:
        return index
    t = F.col("term")
    wanted = [leaf.terms(t) for leaf in _leaves(condition)]
    if isinstance(query, str):
        wanted += [_near(t, w, fuzzy_distance(w, distance)) for w in query_terms(query, index.analyzer)]
    postings = keep(index.postings.where(_any(wanted)))
    return replace(index, postings=postings, doc_stats=keep(index.doc_stats), term_stats=postings.groupBy("term").agg(F.count("*").alias("df")))


def search(index: Index, query: str | Condition, limit: int | None = None, fallback: bool = True, distance: int = 2, least: int = 1, within: DataFrame | None = None) -> DataFrame:
    """doc_id, score, matched, match_type, rank. ``within``: documents (doc_id) that hits are taken from; scores
    are those of the whole index. Fuzzy hits are added where there are fewer than ``least``
    exact ones and the query is typed, without quotes; a document keeps its best score. The decision is a count of the
    exact hits inside the plan, so nothing runs twice on the driver."""
    inside = (lambda hits: hits) if within is None else (lambda hits: hits.join(within.select("doc_id"), "doc_id", "left_semi"))
    exact = inside(search_query(index, query) if isinstance(query, str) else search_where(index, query)).withColumn("match_type", F.lit("exact"))
    out = exact
    if fallback and isinstance(query, str) and '"' not in query and query_terms(query, index.analyzer):
        few = exact.limit(least).agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(1).alias("few"))
        fuzzy = inside(search_fuzzy(index, query, distance, scaled=True)).withColumn("match_type", F.lit("fuzzy")).crossJoin(F.broadcast(few)).drop("few")
        both = exact.unionByName(fuzzy)
        best = F.max_by(F.struct("score", "matched", "match_type"), F.struct("score", (F.col("match_type") == "exact").alias("e")))
        out = both.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")
    from textloom.functions.present import best as best_rows

    return best_rows(out, F.desc("score"), F.col("doc_id"), limit=limit)
