"""Theme analytics: bullets, clusters, representatives, shares, prevalence, graded scores, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

# Scores of the answers A to E.
ANSWER_SCORES = {"A": 1.0, "B": 0.75, "C": 0.5, "D": 0.25, "E": 0.0}
EXCERPT_CHARS = 220
NOISE = -1


def excerpt(c: Column) -> Column:
    """At most 220 characters; longer ones are cut after 217, trailing white space goes, and dots follow."""
    return F.when(F.length(c) > EXCERPT_CHARS, F.concat(F.regexp_replace(F.left(c, F.lit(EXCERPT_CHARS - 3)), r"(?U)\s+$", ""), F.lit("..."))).otherwise(c)


def answer_score(c: Column) -> Column:
    """The score of an answer by its first letter; 0 for any other, and for none."""
    letter = F.upper(F.left(T.strip(c), F.lit(1)))
    out = F.lit(0.0)
    for k, v in ANSWER_SCORES.items():
        out = F.when(letter == k, v).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def json_object(c: Column, schema: str) -> Column:
    """A JSON object from a reply: the whole text, or what lies between its first and last brace; else null."""
    whole = F.when(F.try_parse_json(c).isNotNull() & T.strip(c).startswith("{"), c)
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.from_json(F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner)), schema)


def clamped_int(c: Column, low: int, high: int) -> Column:
    """A whole number within bounds; the lower one if it is none."""
    return F.coalesce(F.least(F.greatest(c.cast("string").try_cast("int"), F.lit(low)), F.lit(high)), F.lit(low))


def bullets(quotes: DataFrame, limit: int | None = T.MAX_CHUNKS) -> DataFrame:
    """One bullet per chunk of two or three sentences of a document's joined quotes (doc_id, quotes): doc_id,
    bullet_no, bullet_id, bullet, source_text, sentence range, quote (the first). At most ``limit`` a document:
    what a model call may see."""
    joined = quotes.where(F.size("quotes") > 0).select("doc_id", F.array_join("quotes", " ").alias("t"), F.get("quotes", F.lit(0)).alias("quote"))
    rows = joined.select("doc_id", "quote", F.posexplode(T.chunks_2_3(T.theme_sentences(F.col("t")), limit)).alias("bullet_no", "c"))
    bullet_id = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("bullet_no").cast("string")), 256)
    return rows.select("doc_id", "bullet_no", bullet_id.alias("bullet_id"), excerpt(F.col("c.text")).alias("bullet"), F.col("c.text").alias("source_text"), "c.start_sentence_idx", "c.end_sentence_idx", "c.sentence_count", "quote")


def with_metadata(points: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Bullets with some columns of their document, joined late so they are not carried through earlier steps."""
    return points.join(docs.select("doc_id", *[c for c in columns if c in docs.columns]), "doc_id", "left")


def cluster_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("cluster_id").agg(F.count("*").alias("n"))


def cluster_centroids(points: DataFrame) -> DataFrame:
    return points.groupBy("cluster_id").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def largest_clusters(points: DataFrame, n: int) -> DataFrame:
    """The n largest clusters without noise; ties by id."""
    return cluster_sizes(points).where(F.col("cluster_id") != NOISE).orderBy(F.desc("n"), "cluster_id").limit(n)


def doc_theme_scores(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, cluster_id, score, n_bullets_in_theme, n_bullets_total: for each document with bullets outside
    noise and each labelled cluster, the share of these bullets in it; zeros included. Labelled clusters are
    the themes of a run (50 at most)."""
    real = points.where(F.col("cluster_id") != NOISE)
    counts = real.groupBy("doc_id", "cluster_id").agg(F.count("*").alias("n"))
    totals = counts.groupBy("doc_id").agg(F.sum("n").alias("n_bullets_total"))
    dense = totals.crossJoin(F.broadcast(labelled.select("cluster_id").distinct()))
    out = dense.join(counts, ["doc_id", "cluster_id"], "left").withColumn("n_bullets_in_theme", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("doc_id", "cluster_id", F.round(F.col("n_bullets_in_theme") / F.col("n_bullets_total"), 6).alias("score"), "n_bullets_in_theme", "n_bullets_total")


def theme_prevalence(scores: DataFrame, labelled: DataFrame) -> DataFrame:
    """cluster_id, docs, mean_score, docs_with_any; zeros for a theme without documents."""
    found = scores.groupBy("cluster_id").agg(F.count("*").alias("docs"), F.avg("score").alias("mean"), F.count_if(F.col("score") > 0).alias("any"))
    out = labelled.select("cluster_id").distinct().join(found, "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_score"), F.coalesce("any", F.lit(0)).cast("long").alias("docs_with_any"))


def representatives(themes: DataFrame, points: DataFrame, by_example: bool, n: int = 6) -> DataFrame:
    """cluster_id, bullets: up to six bullets per theme. ``by_example``: those of the theme's example ids
    (example_doc_ids) in their order, else the cluster's first; without it always the cluster's first."""
    order = Window.partitionBy("cluster_id").orderBy("ordinal")
    first = points.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).groupBy("cluster_id").agg(_ordered("k", "bullet").alias("first"))
    out = themes.select("cluster_id", "example_doc_ids").join(first, "cluster_id", "left")
    if not by_example:
        return out.select("cluster_id", F.coalesce("first", F.array().cast("array<string>")).alias("bullets"))
    wanted = themes.select("cluster_id", F.posexplode("example_doc_ids").alias("pos", "doc_id"))
    some = wanted.join(points, ["cluster_id", "doc_id"]).withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos", "ordinal"))).where(F.col("k") <= n)
    chosen = some.groupBy("cluster_id").agg(_ordered("k", "bullet").alias("chosen"))
    return out.join(chosen, "cluster_id", "left").select("cluster_id", F.coalesce("chosen", "first", F.array().cast("array<string>")).alias("bullets"))


def representative_quotes(themes: DataFrame, quotes: DataFrame, points: DataFrame, n: int = 4) -> DataFrame:
    """cluster_id, quotes: the first quote of each example document that has one; else of the first documents."""
    known = quotes.where(F.size("quotes") > 0).select("doc_id", F.get("quotes", F.lit(0)).alias("quote"))
    wanted = themes.select("cluster_id", F.posexplode("example_doc_ids").alias("pos", "doc_id")).join(known, "doc_id")
    docs = points.groupBy("cluster_id", "doc_id").agg(F.min("ordinal").alias("pos")).join(known, "doc_id")
    rows = wanted.select("cluster_id", F.lit(0).alias("rank"), F.col("pos").cast("long").alias("pos"), "quote").unionByName(docs.select("cluster_id", F.lit(1).alias("rank"), F.col("pos").cast("long").alias("pos"), "quote"))
    rows = rows.withColumn("best", F.min("rank").over(Window.partitionBy("cluster_id"))).where(F.col("rank") == F.col("best"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))).where(F.col("k") <= n)
    return rows.groupBy("cluster_id").agg(_ordered("k", "quote").alias("quotes"))


def _ordered(order: str, value: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])


def graded(points: DataFrame, themes: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, bullet_id, concept_id, score, rationale, highlight: every bullet with every theme, with the
    answer (bullet_id, concept_id, answer, rationale, quote) where there is one; else 0 and empty. Themes
    are those of a run, so they are broadcast."""
    grid = points.select("doc_id", "bullet_id").crossJoin(F.broadcast(themes.select(F.col("cluster_id").alias("concept_id"))))
    out = grid.join(answers, ["bullet_id", "concept_id"], "left")
    return out.select("doc_id", "bullet_id", "concept_id", answer_score(F.col("answer")).alias("score"), F.coalesce("rationale", F.lit("")).alias("rationale"), F.coalesce("quote", F.lit("")).alias("highlight"))


def top_matches(scores: DataFrame, least: float = 0.75, n: int = 8) -> DataFrame:
    """concept_id, matches: up to eight best rows (score, ordinal) as lines of their highlight, else text."""
    order = Window.partitionBy("concept_id").orderBy(F.desc("score"), "ordinal")
    some = scores.where(F.col("score") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    line = F.concat(F.lit("- "), F.when(F.length("highlight") > 0, F.col("highlight")).otherwise(F.col("text")))
    return some.withColumn("line", line).groupBy("concept_id").agg(F.array_join(_ordered("k", "line"), "\n").alias("matches"))


def distinct_themes(themes: DataFrame, k: int | None = None) -> DataFrame:
    """Themes that differ in name or prompt, in any case, the first of each (by ordinal); at most ``k``."""
    same = Window.partitionBy(F.lower("name"), F.lower("prompt")).orderBy("ordinal")
    out = themes.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    return out.orderBy("ordinal").limit(k) if k else out


def review(themes: DataFrame, removed: DataFrame, selected: DataFrame, most: int) -> DataFrame:
    """Themes after a review: without those removed (all, if nothing would be left), then those selected (the
    first ``most`` by size, if none of them is left). ``removed`` and ``selected`` hold cluster_id."""
    kept = themes.join(removed, "cluster_id", "left_anti")
    some_kept = kept.limit(1).select(F.lit(True).alias("any"))
    base = themes.join(F.broadcast(some_kept), F.lit(True), "left").join(removed.select("cluster_id", F.lit(True).alias("gone")).distinct(), "cluster_id", "left")
    base = base.where(F.col("any").isNull() | F.col("gone").isNull()).drop("any", "gone")
    marked = base.join(selected.select("cluster_id", F.lit(1).alias("sel")).distinct(), "cluster_id", "left")
    whole = Window.partitionBy(F.lit(1))
    marked = marked.withColumn("__sel", F.count("sel").over(whole)).withColumn("__k", F.row_number().over(whole.orderBy(F.desc("n_points"), "cluster_id")))
    return marked.where((F.col("sel") == 1) | ((F.col("__sel") == 0) & (F.col("__k") <= most))).drop("sel", "__sel", "__k")
