"""What each of several filters removes, in every order of applying them.

The orders form a trie whose nodes are prefixes. What a prefix leaves does not depend on the order within it, so
nodes with the same set of filters are one state. States are visited depth first: each one's survivors are a
persisted DataFrame, filtered from those of the state it was first reached from, and what leads from it is counted
at once, for all its edges together. A state met again is not computed again. Of n filters, 2^n - 1 states are
counted instead of the n! x n steps of all orders, and at most n survivor tables are held at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh_path, materialize

State = frozenset[str]


def trie_edges(filters: list[str]) -> list[tuple[State, str]]:
    """Every unordered prefix with each filter that may follow it."""
    states = {frozenset(order[:k]) for order in permutations(filters) for k in range(len(filters))}
    return [(s, f) for s in sorted(states, key=lambda s: (len(s), sorted(s))) for f in filters if f not in s]


def _mask(state: State, filters: list[str]) -> int:
    return sum(1 << k for k, f in enumerate(filters) if f in state)


def _paths(filters: list[str]) -> list[tuple[str, int, int, str]]:
    """(order, step, prefix before the step, filter of the step) of all orders."""
    return [("".join(order), k + 1, _mask(frozenset(order[:k]), filters), f) for order in permutations(filters) for k, f in enumerate(order)]


def count_edges(verdicts: DataFrame, filters: list[str], watched: list[str]) -> DataFrame:
    """part, state, filter, reached, removed, and of those removed each of ``watched``: for each part that reaches
    a state, and each filter that may follow. ``verdicts`` (materialised): part, a boolean for each filter (true:
    it fails), and a boolean for each of ``watched``."""
    spark, path, seen = verdicts.sparkSession, fresh_path(verdicts.sparkSession, "edges"), set()
    # the same expressions for every state, so Spark compiles them once: no survivor fails a filter of its state
    counts = [c for f in filters for c in (F.count_if(f).alias(f"removed_{f}"), *[F.count_if(F.col(f) & F.col(w)).alias(f"{w}_{f}") for w in watched])]

    def visit(state: State, rows: DataFrame) -> None:
        seen.add(state)
        survivors = rows.persist()
        survivors.groupBy("part").agg(F.count("*").alias("reached"), *counts).write.parquet(f"{path}/state={_mask(state, filters)}")
        for f in filters:
            after = state | {f}
            if f not in state and len(after) < len(filters) and after not in seen:
                visit(after, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), verdicts)
    columns = ", ".join(f"{c}_{f} long" for f in filters for c in ("removed", *watched))
    states = spark.read.schema(f"part string, reached long, {columns}, state int").parquet(path)
    edge = lambda k, f: F.struct(F.lit(f).alias("filter"), F.lit(1 << k).alias("bit"), F.col(f"removed_{f}").alias("removed"), *[F.col(f"{w}_{f}").alias(w) for w in watched])
    edges = states.select("part", "state", "reached", F.explode(F.array(*[edge(k, f) for k, f in enumerate(filters)])).alias("e"))
    return edges.where(F.col("state").bitwiseAND(F.col("e.bit")) == 0).select("part", "state", "reached", "e.filter", "e.removed", *[f"e.{w}" for w in watched])


def audit(verdicts: DataFrame, filters: list[str], watched: list[str]) -> DataFrame:
    """A row for each part, order of the filters (filter_order, their names joined) and step, zeros included: kept
    (after the step), removed (at it), redundant (fail its filter, but were removed before), unique_fails (fail its
    filter only), shapley (removed by its filter, summed over all orders), and ``watched``: those of them removed
    at the step. ``verdicts`` as for ``count_edges``; a part is any string. No parts, no rows."""
    n, edges = len(filters), materialize(count_edges(verdicts, filters, watched), "edges")
    masks = [(_mask(s, filters), f) for s, f in trie_edges(filters)]
    every = F.explode(F.array(*[F.struct(F.lit(m).alias("state"), F.lit(f).alias("filter")) for m, f in masks]))
    # parts that a state has no survivors of
    none = edges.where("state = 0").select("part").distinct().select("part", every.alias("e")).select("part", "e.*", *[F.lit(0).cast("long").alias(c) for c in ("reached", "removed", *watched)])
    whole = edges.unionByName(none).groupBy("part", "state", "filter").agg(*[F.sum(c).alias(c) for c in ("reached", "removed", *watched)])
    before = F.bit_count("state").cast("int")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), before + 1)
    alone = (F.lit((1 << n) - 1) == F.col("state").bitwiseOR(F.element_at(F.create_map(*[x for k, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << k))]), F.col("filter")))) & (before == n - 1)
    totals = whole.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("all_fails"), F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * orders).cast("long").alias("shapley"),
    )
    # those of a filter that are still there when it is applied are what it removes
    paths = whole.sparkSession.createDataFrame(_paths(filters), "filter_order string, step int, state int, filter string")
    out = whole.join(totals, ["part", "filter"]).join(F.broadcast(paths), ["state", "filter"])
    redundant = (F.col("all_fails") - F.col("removed")).alias("redundant")
    return out.select("part", "filter_order", "step", (F.col("reached") - F.col("removed")).alias("kept"), "removed", redundant, "unique_fails", *watched, "shapley")


# the filters of the query

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "#$%&*|"
FILTERS = ["A", "B", "C", "D", "E"]


def _text_stats(text: Column) -> Column:
    """Words (between white space), different words, capitals A-Z, characters, and whether there is any of MARKS."""
    capitals, marks = bytes(range(65, 91)), MARKS.encode()

    def rows(texts: pa.Array) -> Iterator[tuple[int, int, int, int, bool]]:
        for k in range(len(texts)):
            text = texts[k].as_py() or ""
            raw = text.encode()
            words = raw.split()  # at the six white-space characters of ASCII
            yield len(words), len(set(words)), len(raw) - len(raw.translate(None, capitals)), len(text), len(raw) > len(raw.translate(None, marks))

    names, kinds = ["n_words", "n_distinct", "n_capitals", "n_chars", "marked"], [pa.int64()] * 4 + [pa.bool_()]

    @F.arrow_udf("struct<n_words long, n_distinct long, n_capitals long, n_chars long, marked boolean>")
    def stats(texts: pa.Array) -> pa.Array:
        columns = list(zip(*rows(texts), strict=True)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return stats(text)


def text_verdicts(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, A to E (true: the document fails), good_lost and toxic_lost (it is labelled quality 1, toxic 1).

    A: under 200 words. B: under half of the words are different. C: over 2 of 100 characters are A-Z. D: it holds
    a mark. E: a smaller id has the same text. Null texts count as empty, null parts as the empty string; a null id
    is no smaller than another and no larger, so it never fails E, nor is it labelled. Rows alike in id and text
    are alike. A document with several labels has what any of them says.

    Texts are read once; what is shuffled is ids and digests. E asks whether (digest, id) is the digest's smallest,
    so copies are spread by their ids."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stats = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), _text_stats(text).alias("s"),
    )
    stats = materialize(stats.select(
        "part", "id", "digest", (F.col("s.n_words") < MIN_WORDS).alias("A"), (100 * F.col("s.n_distinct") < DISTINCT_PERCENT * F.col("s.n_words")).alias("B"),
        (100 * F.col("s.n_capitals") > CAPITAL_PERCENT * F.col("s.n_chars")).alias("C"), F.col("s.marked").alias("D"),
    ), "stats")
    firsts = stats.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    judged = stats.join(firsts, ["digest", "id"], "left").withColumn("E", F.col("id").isNotNull() & F.col("first").isNull())
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good_lost"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic_lost"))
    out = judged.join(known, "id", "left")
    return materialize(out.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good_lost", "toxic_lost")]), "verdicts")


def audit_texts(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``audit`` of the five text filters."""
    return audit(text_verdicts(docs, labels, part, id_col, text_col), FILTERS, ["good_lost", "toxic_lost"])
