"""Target-distribution importance resampling over hashed word features.

Documents are drawn with probabilities in proportion to the ratio of a target's to the corpus' feature
distribution (naive Bayes over buckets of hashed n-grams; Gumbel noise turns the draw into a top-k). Identical
texts are collapsed first: they are grouped by their full text, features and weight are computed once for each,
counts are multiplied by the number of copies, and weights are joined back before each document gets its own
noise.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import join_copies, materialize, numbered


@dataclass(frozen=True)
class Resampling:
    """Features are runs of ``ngrams`` (from, to) words, hashed into ``buckets``. Of the documents with at least
    ``min_words`` words, ``percent`` in a hundred are drawn."""

    ngrams: tuple[int, int] = (1, 1)
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024


def _byte_table() -> bytes:
    """A-Z lower-cased; ASCII other than digits and letters as blanks; all other bytes as they are."""
    table = bytearray(range(256))
    for b in range(128):
        table[b] = b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32
    return bytes(table)


def _hashed(text: Column, params: Resampling) -> Column:
    """n_words, and the bucket of each feature in turn."""
    table, (low, high), buckets = _byte_table(), params.ngrams, params.buckets

    @F.arrow_udf("struct<n_words int, buckets array<int>>")
    def features(texts: pa.Array) -> pa.Array:
        counts, found, at = [], [], [0]
        for k in range(len(texts)):
            words = (texts[k].as_py() or "").encode().translate(table).split()
            runs = words if (low, high) == (1, 1) else [b" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
            found.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % buckets)
            counts.append(len(words))
            at.append(at[-1] + len(runs))
        flat = np.concatenate(found) if found else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], ["n_words", "buckets"])

    return features(text)


def collapsed_features(docs: DataFrame, params: Resampling, text_col: str = "text") -> DataFrame:
    """A row for each different text (null counts as empty): digest, copies, n_words, buckets. Copies are counted
    before the shuffle, so a text that a third of all rows share is one row of each task there."""
    texts = docs.groupBy(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    rows = texts.select(F.sha2("text", 256).alias("digest"), "copies", _hashed(F.col("text"), params).alias("f"))
    return rows.select("digest", "copies", "f.n_words", "f.buckets")


def _counts(features: DataFrame, name: str) -> DataFrame:
    """Features in each bucket, copies included."""
    return features.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))


def bucket_gains(features: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket 1000 times the logarithm of the target's share over the corpus' share, both with one more
    feature in each bucket, rounded down. ``buckets`` numbers, so they come to the driver."""
    both = F.broadcast(features.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))).join(_counts(features, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def _weight(buckets: Column, gains: np.ndarray) -> Column:
    @F.arrow_udf("long")
    def weight(lists: pa.Array) -> pa.Array:
        at = lists.offsets.to_numpy()
        sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()])])
        return pa.array(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]], pa.int64())

    return weight(buckets)


def noise(doc_id: Column, seed: int) -> Column:
    """A document's Gumbel noise in thousandths, from a hash of seed and id, so a draw can be repeated."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, params: Resampling = Resampling(), keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with rs_words, rs_features, rs_weight, rs_score and
    rs_rank: 1, 2, 3, ... for the documents drawn, by score, then id; null for all others. Columns of these
    names are replaced.

    Null and empty texts have no words, weight 0, and are not drawn unless ``min_words`` is 0. A null id has the
    noise of an empty one and comes last among ties; rows alike in id and score are ordered by the hash of their
    text, and rows alike in that too are alike. An empty target, or an empty corpus, has no features; all weights
    then follow from the other's counts alone.

    Texts are shuffled once, to be collapsed. All else is narrow: weights come back to the documents by digest
    (common ones by a broadcast of fixed size), and ranks by one range shuffle.
    """
    features = materialize(collapsed_features(docs, params, text_col), "features")
    gains = bucket_gains(features, collapsed_features(target, params, text_col), params.buckets)
    weights = features.select("digest", "copies", F.struct("n_words", F.size("buckets").alias("n_features"), _weight(F.col("buckets"), gains).alias("weight")).alias("w"))
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    columns = [c for c in (keep or docs.columns) if c not in ("rs_words", "rs_features", "rs_weight", "rs_score", "rs_rank")]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    scored = join_copies(rows, weights, "digest").select("row", "id", "digest", "w", (F.col("w.weight") + noise(F.col("id"), params.seed)).alias("score"))
    scored = scored.withColumn("open", F.col("w.n_words") >= params.min_words)
    ranked = numbered(scored, [F.desc("open"), F.desc("score"), F.asc_nulls_last("id"), F.col("digest")], "ranked")
    drawn = ranked.where("row.open").count() * params.percent // 100
    rank = F.when(F.col("row.open") & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select("row.row.*", F.col("row.w.n_words").cast("long").alias("rs_words"), F.col("row.w.n_features").cast("long").alias("rs_features"), F.col("row.w.weight").alias("rs_weight"), F.col("row.score").alias("rs_score"), rank.alias("rs_rank"))
