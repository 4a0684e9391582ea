"""The corpus: reading tables, assembling documents, profiles and metadata values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.buckets import normalized_value
from textloom.functions.text import strip
from textloom.sources.workbook import read_workbooks

# Names of narrative columns, fields kept with a bullet, and names of a participant's id.
RESPONSE = re.compile(r"^q[1-5]_response$", re.IGNORECASE)
BULLET_FIELDS = ["participant_id", "age", "city_of_residence", "state_of_residence", "region_of_residence", "income", "pizza_consumption", "food_restrictions"]
PARTICIPANT_NAMES = ["participant_id", "participant", "id", "participant_number"]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by its ending: parquet, csv, json or orc; xlsx by ``read_workbooks``, a file or a folder.
    A path without rows or that does not exist fails as Spark's readers do."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        return read_workbooks(spark, path, schema=schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    return {"json": reader.json, "jsonl": reader.json, "orc": reader.orc}.get(kind, reader.parquet)(path)


def named(name: str) -> Column:
    """A column by its whole name, which may have dots and backticks, as a workbook's often have."""
    return F.col("`" + name.replace("`", "``") + "`")


def response_columns(df: DataFrame) -> list[str]:
    """Narrative columns in the table's order."""
    return [c for c in df.columns if RESPONSE.match(c)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def metadata_map(df: DataFrame, normalize: bool = False) -> Column:
    """All columns as a map of strings, without null cells; ages and incomes bucketed if asked."""
    cells = [x for c in df.columns for x in (F.lit(c), (normalized_value(c, named(c)) if normalize else named(c)).cast("string"))]
    return F.map_filter(F.create_map(*cells), lambda _, v: v.isNotNull())


def assemble_documents(df: DataFrame, id_column: str, normalize: bool = False) -> DataFrame:
    """id, text, metadata, row_index: responses joined by a space, null cells left out. ``id_column`` gives the
    row's place: positions in a file have no meaning for distributed rows."""
    text = F.concat_ws(" ", *[named(c).cast("string") for c in response_columns(df)])
    return df.select(named(id_column).cast("string").alias("id"), text.alias("text"), metadata_map(df, normalize).alias("metadata"), named(id_column).cast("long").alias("row_index"))


def select_text(df: DataFrame, source: str = "all", text: str = "text") -> DataFrame:
    """One response (``q1`` to ``q5``) or the whole text as ``text``, without rows where it is empty. A source
    that is not known means the whole."""
    column = next((c for c in df.columns if c.lower() == f"{source.lower()}_response"), text)
    return df.withColumn("text", strip(F.coalesce(named(column).cast("string"), F.lit("")))).where(F.length("text") > 0)


def conversation_responses(conversations: DataFrame, turns: int = 5) -> DataFrame:
    """conv_id, q1_response, ...: a conversation's first user turns as a respondent's answers."""
    users = conversations.where("role = 'user'")
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    numbered = users.withColumn("k", F.row_number().over(order)).where(F.col("k") <= turns)
    return numbered.groupBy("conv_id").agg(*[F.max(F.when(F.col("k") == k, F.col("text"))).alias(f"q{k}_response") for k in range(1, turns + 1)])


def null_profile(df: DataFrame) -> DataFrame:
    """column, n_rows, n_nulls: one pass over the table, a row per column."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(named(c).isNull()).alias(f"n_{k}") for k, c in enumerate(df.columns)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"n_{k}").alias("n_nulls")) for k, c in enumerate(df.columns)])))


def profile(df: DataFrame) -> dict:
    """Shape, column types, null counts and three rows."""
    nulls = {r.column: (r.n_rows, r.n_nulls) for r in null_profile(df).collect()}
    return {"rows": next(iter(nulls.values()), (0, 0))[0], "columns": df.columns, "types": dict(df.dtypes), "nulls": {c: n for c, (_, n) in nulls.items()}, "sample": [r.asDict() for r in df.limit(3).collect()]}


def metadata_fields(documents: DataFrame, hide_responses: bool = True) -> DataFrame:
    """field: distinct metadata keys in order; those that start as a response's name are hidden."""
    fields = documents.select(F.explode(F.map_keys("metadata")).alias("field")).distinct()
    if hide_responses:
        fields = fields.where(~F.col("field").rlike(r"(?i)^q[1-5]_response"))
    return fields.orderBy("field")


def metadata_values(df: DataFrame, field: str, limit: int = 100) -> DataFrame:
    """value: distinct values of a column that are not null, by their text, the first ``limit``."""
    return df.where(named(field).isNotNull()).select(named(field).cast("string").alias("value")).distinct().orderBy("value").limit(limit)


def participant(df: DataFrame, fallback: str = "id") -> Column:
    """The first id of a participant that is not null, or else the hit's own, as text."""
    there = [named(c).cast("string") for c in PARTICIPANT_NAMES if c in df.columns]
    return F.coalesce(*there, F.col(fallback).cast("string"))
