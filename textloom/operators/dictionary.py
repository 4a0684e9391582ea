"""The terms of a saved index by deletion variants and by runs of three characters, so that words with edits and masks
read some row groups instead of comparing every term."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edits that variants are kept for. Two words within them share a variant of their first PREFIX characters: at most
#: 1 + 7 + 21 rows for a term, however long it is.
EDITS = 2
PREFIX = 7
#: So many terms are named in a plan; for more, conditions are put to all terms as without a dictionary.
MAX_TERMS = 1_000


def variant_keys(term: Column) -> Column:
    """The start of a term and what is left of it without one or two characters. Each is an expression of its own, as
    functions of lambdas are not compiled; places behind a term's end leave what others leave."""
    start = F.substring(term, 1, PREFIX)

    def without(*gone: int) -> Column:
        cuts = [-1, *gone, PREFIX]
        return F.concat(*[F.substring(start, a + 2, b - a - 1) for a, b in pairwise(cuts) if b - a > 1])

    return F.array_distinct(F.array(*[without(*gone) for d in range(EDITS + 1) for gone in combinations(range(PREFIX), d)]))


def _keys_of(word: str, distance: int) -> list[str]:
    start = word[:PREFIX]
    return sorted({"".join(c for i, c in enumerate(start) if i not in gone) for d in range(distance + 1) for gone in combinations(range(len(start)), min(d, len(start)))})


# For runs of three, a term stands between ^ and $, which are no characters of terms.


def gram_keys(term: Column) -> Column:
    s = F.concat(F.lit("^"), term, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: s.substr(i, F.lit(3))))


def _grams_of(mask: str) -> list[str]:
    """The runs of three characters that every term that fits a mask has."""
    return sorted({run[i : i + 3] for run in re.split(r"[*?]", f"^{mask}$") for i in range(len(run) - 2)})


@dataclass
class Dictionary:
    """variants (key, term), grams (key, term)."""

    variants: DataFrame
    grams: DataFrame

    def terms(self, fits: Callable[[Column], Column], mask: str | None = None, fuzzy: tuple[str, int] | None = None) -> list[str] | None:
        """The terms that fit a mask, or a word and its edits. None where the tables do not help: more edits
        than EDITS, a mask without three characters in a row, or more than MAX_TERMS terms."""
        if fuzzy is not None and fuzzy[1] <= EDITS:
            rows = self.variants.where(F.col("key").isin(_keys_of(*fuzzy))).select("term").distinct()
        elif mask is not None and (keys := _grams_of(mask)):
            rows = self.grams.where(F.col("key").isin(keys)).groupBy("term").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(keys)).select("term")
        else:
            return None
        found = rows.where(fits(F.col("term"))).limit(MAX_TERMS + 1).collect()
        return sorted(r.term for r in found) if len(found) <= MAX_TERMS else None


def save_dictionary(terms: DataFrame, path: str, part: str = "") -> None:
    """``terms``: each term once. Tables lie in ranges of their keys; ``part``: a folder within each."""
    # a term is some 26 rows, so tasks are for them, not for the terms' few bytes
    terms = terms.select("term").repartition(4 * terms.sparkSession.sparkContext.defaultParallelism)
    for name, keys in (("variants", variant_keys), ("grams", gram_keys)):
        rows = terms.select(F.explode(keys(F.col("term"))).alias("key"), "term")
        rows.repartitionByRange("key", "term").sortWithinPartitions("key", "term").write.mode("overwrite").parquet(f"{path}/{name}{part}")


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(spark.read.parquet(f"{path}/variants"), spark.read.parquet(f"{path}/grams"))
