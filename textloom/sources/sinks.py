"""Saved runs: JSON documents and CSV artefacts."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the CSV artefacts.
POINT_COLUMNS = ["doc_id", "bullet_id", "cluster_id", "x", "y", "bullet", "quote", "source_text", "start_sentence_idx", "end_sentence_idx", "sentence_count", "participant_id", "region_of_residence"]
THEME_COLUMNS = ["cluster_id", "name", "prompt", "n_points", "representative_bullets", "representative_quotes", "example_doc_ids"]
SCORE_COLUMNS = ["doc_id", "text", "bullet_id", "bullet", "concept_id", "concept_name", "concept_prompt", "score", "rationale", "highlight", "concept_seed"]


#: What a file's name does not keep, and how long it gets.
_DROPPED, _LONGEST = r"[^\p{L}\p{N}\-_. ]", 120


def safe_filename(c: Column) -> Column:
    """Letters, digits and ``- _ .`` with spaces as ``_``, 120 characters at most; ``run`` if nothing is left."""
    kept = F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _DROPPED, "")), F.lit(" "), F.lit("_"))
    return F.when(F.length(kept) > 0, F.left(kept, F.lit(_LONGEST))).otherwise("run")


def safe_name(name: str | None) -> str:
    """``safe_filename`` of a name on the driver."""
    import regex

    return regex.sub(_DROPPED, "", name or "").strip(" ").replace(" ", "_")[:_LONGEST] or "run"


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a CSV artefact; arrays are joined by `` | ``, columns that are missing stay empty."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast("string").alias(c)
        return (F.array_join(F.col(c).cast("array<string>"), " | ") if kinds[c].startswith("array") else F.col(c)).alias(c)

    return df.select(*map(cell, columns))


def membership_scores(points: DataFrame, themes: DataFrame) -> DataFrame:
    """Scores where none were graded: every point with every theme, 1 if it is of the theme's cluster; the
    highlight is the first 18 words. Themes are few (a run has 50 at most), so they are broadcast."""
    words = F.filter(F.split(F.coalesce("bullet", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    short = F.concat(F.array_join(F.slice(words, 1, 18), " "), F.when(F.size(words) > 18, "…").otherwise(""))
    t = themes.select(F.col("cluster_id").cast("string").alias("concept_id"), F.col("name").alias("concept_name"))
    same = F.col("concept_id") == F.col("cluster_id").cast("string")
    return points.crossJoin(F.broadcast(t)).select("doc_id", "bullet_id", "concept_id", "concept_name", F.when(same, 1.0).otherwise(0.0).alias("score"), short.alias("highlight"))


def save_run(spark: SparkSession, folder: str, name: str, payload: dict, tables: dict[str, DataFrame] | None = None) -> str:
    """A run as JSON, and its points, themes and scores as CSV. Returns the run's path. A table that cannot be
    written leaves the run and the other tables, as the JSON is the run; it is logged."""
    base = f"{folder.rstrip('/')}/{safe_name(name)}"
    spark.createDataFrame([(json.dumps(payload, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}.json")
    for kind, df in (tables or {}).items():
        columns = {"points": POINT_COLUMNS, "themes": THEME_COLUMNS, "scores": SCORE_COLUMNS}.get(kind, df.columns)
        try:
            flat(df, columns).write.mode("overwrite").csv(f"{base}_{kind}.csv", header=True)
        except Exception as e:  # noqa: BLE001  whatever its plan or the file system raises
            logging.getLogger(__name__).warning("%s of run %s not saved: %s", kind, name, e)
    return f"{base}.json"


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run, modified, payload: saved runs, the newest first; files that are not JSON are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder.rstrip('/')}/*.json")
    runs = files.select(F.regexp_extract("path", r"/([^/]+)\.json/[^/]*$", 1).alias("run"), F.col("modificationTime").alias("modified"), F.trim(F.decode("content", "UTF-8"), F.lit("\n")).alias("payload"))
    return runs.where((F.col("run") != "") & F.try_parse_json("payload").isNotNull()).orderBy(F.desc("modified"), "run")


def load_run(spark: SparkSession, folder: str, name: str) -> dict | None:
    row = list_runs(spark, folder).where(F.col("run") == safe_name(name)).first()
    return json.loads(row.payload) if row else None


def delete_run(spark: SparkSession, folder: str, name: str) -> bool:
    """Deletes a run's JSON; its CSV artefacts stay."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{safe_name(name)}.json")
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
