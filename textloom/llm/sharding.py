"""Shards of nearly equal bytes, as ranges of a key.

Keys are sampled in proportion to the sizes of their records, and quantiles of the sample split the records into
ranges, whose bytes are then measured. A range that a shard must end in is overfull while it has more rows than the
driver looks at: it is sampled by itself and subdivided, round by round, and a key that the sample meets so often
that it would fill ranges alone gets a range of its own. So shards end where the exact bytes of all records say:
a record lies in the shard that the middle one of its bytes belongs to, were all records in one row. Shards differ by
one record at most, whatever the sample.

Records with equal keys are ordered by a hash of key and text, so a key that a third of all rows share is split like
any other range.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize

SHARDS = 16
#: Ranges of the first round, and of each subdivision; sampled keys of each range, on average.
RANGES, SUBDIVISIONS, OVERSAMPLE = 256, 64, 16
#: Rows of one range that the driver reads to find where a shard ends. At most shards x this.
EXACT_ROWS = 2_000
#: Bytes of records that a task sorts and writes.
TASK_BYTES = 64 << 20

#: A record's place in the order: (has a key, key, tie). A boundary has a fourth part: 0 before that place, 1 behind it.
Place = tuple[bool, Any, int]
Boundary = tuple[bool, Any, int, int]


def record_size(text: Column) -> Column:
    """Bytes in UTF-8, none for null, plus one."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def _number(boundaries: list[Boundary]) -> Column:
    """How many boundaries lie before the record (columns key, tie)."""

    @F.pandas_udf("int")
    def number(keys: pd.Series, missing: pd.Series, ties: pd.Series) -> pd.Series:
        rows = zip(missing.tolist(), keys.tolist(), ties.tolist(), strict=True)
        return pd.Series([bisect_right(boundaries, (not m, None if m else k, t, 0)) for m, k, t in rows], dtype="int32")

    # null keys arrive as a value of their type, so that other keys keep theirs
    return number(F.coalesce("key", "stand_in"), F.col("key").isNull(), F.col("tie"))


@dataclass
class _Range:
    """Records between two boundaries (None: no end), the bytes before them, their bytes and rows."""

    low: Boundary | None
    high: Boundary | None
    before: int
    size: int
    rows: int

    @property
    def one_place(self) -> bool:
        return self.low is not None and self.high is not None and self.low[:3] == self.high[:3]


def _inside(keys: DataFrame, ranges: list[_Range]) -> DataFrame:
    """Records of these ranges (in their order, apart from each other), with ``range``: which one."""
    if ranges[0].low is None and ranges[0].high is None:
        return keys.withColumn("range", F.lit(0))
    marks = sorted({b for r in ranges for b in (r.low, r.high) if b is not None})
    numbers = [0 if r.low is None else bisect_right(marks, r.low) for r in ranges]
    found = keys.withColumn("mark", _number(marks)).where(F.col("mark").isin(numbers))
    ordinal = F.create_map(*[F.lit(x) for k, n in enumerate(numbers) for x in (n, k)])
    return found.withColumn("range", ordinal[F.col("mark")]).drop("mark")


def _subdivide(keys: DataFrame, ranges: list[_Range], pieces: int, seed: int) -> list[_Range]:
    """All ranges cut at quantiles of a size-weighted sample of their records, and measured. The sample has about
    pieces x OVERSAMPLE places for each range."""
    inside = _inside(keys, ranges)
    step = F.element_at(F.array(*[F.lit(r.size / (pieces * OVERSAMPLE)) for r in ranges]), F.col("range") + 1)
    chance = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = inside.withColumn("n", F.floor(F.col("size") / step + chance)).where("n > 0").groupBy("range", "key", "tie").agg(F.sum("n").alias("n")).collect()
    marks: set[Boundary] = set()
    for k in range(len(ranges)):
        points = sorted(((r.key is not None, r.key, r.tie), r.n) for r in drawn if r.range == k)
        quantile, passed, every = 1, 0, sum(n for _, n in points) / pieces
        for place, n in points:
            passed += n
            if passed >= quantile * every:
                marks.add((*place, 0))
                if n >= every:  # it fills a range by itself
                    marks.add((*place, 1))
                quantile = int(passed / every) + 1
    marks |= {b for r in ranges for b in (r.low, r.high) if b is not None}
    ordered = sorted(marks)
    measured = {r.mark: r for r in inside.groupBy(_number(ordered).alias("mark")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    out = []
    for r in ranges:
        first = 0 if r.low is None else bisect_right(ordered, r.low)
        last = len(ordered) if r.high is None else bisect_right(ordered, r.high) - 1
        before = r.before
        for n in range(first, last + 1):
            if n in measured:
                out.append(_Range(ordered[n - 1] if n else None, ordered[n] if n < len(ordered) else None, before, measured[n].size, measured[n].rows))
                before += measured[n].size
    return out


def shard_ends(keys: DataFrame, shards: int = SHARDS, seed: int = 7) -> list[Boundary]:
    """Boundaries between the shards, ``shards`` - 1 of them, in order (equal ones where a record is larger than a
    shard). ``keys`` (materialised): key, stand_in (any value of its type), tie, size."""
    whole = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    if not whole.rows:
        return []
    targets, ends = {k: k * whole.size for k in range(1, shards)}, {}  # in bytes x shards
    active, pieces = [_Range(None, None, 0, whole.size, whole.rows)], RANGES
    while active:
        wanted = {k: r for r in active for k, t in targets.items() if k not in ends and r.before * shards < t <= (r.before + r.size) * shards}
        for k, r in wanted.items():
            if r.one_place:  # equal records stay together
                ends[k] = r.low if (2 * r.before + r.size) * shards >= 2 * targets[k] else r.high
        small = [r for r in active if r.rows <= EXACT_ROWS and any(wanted[k] is r for k in wanted if k not in ends)]
        if small:
            ends |= _exact_ends(keys, small, {k: targets[k] for k, r in wanted.items() if k not in ends and any(r is s for s in small)}, shards)
        overfull = [r for r in active if any(wanted[k] is r for k in wanted if k not in ends)]
        active, pieces, seed = (_subdivide(keys, overfull, pieces, seed) if overfull else []), SUBDIVISIONS, seed + 1
    return [ends[k] for k in sorted(ends)]


def _exact_ends(keys: DataFrame, ranges: list[_Range], targets: dict[int, int], shards: int) -> dict[int, Boundary]:
    """Where shards end in ranges of few rows: before the first record whose middle lies at or behind the target."""
    rows = _inside(keys, ranges).groupBy("range", "key", "tie").agg(F.sum("size").alias("size")).collect()
    ends: dict[int, Boundary] = {}
    for k, r in enumerate(ranges):
        at, open_ = r.before, sorted(n for n, t in targets.items() if r.before * shards < t <= (r.before + r.size) * shards)
        own = sorted(((x.key is not None, x.key, x.tie), x.size) for x in rows if x.range == k)
        for place, size in own:
            while open_ and (2 * at + size) * shards >= 2 * targets[open_[0]]:
                ends[open_.pop(0)] = (*place, 0)
            at += size
        for n in open_:
            ends[n] = (*own[-1][0], 1)
    return ends


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> None:
    """Write ``docs`` as shards: Parquet under ``path``/records, a folder for each shard, with the rows (``row``) in
    the order of their keys; and ``path``/slots, from which places in the shards follow: the first one of each
    task's rows.

    A null text has one byte, as an empty one has. Null keys come first. Rows alike in key and text are alike and
    stay in one shard. A record larger than a shard leaves its neighbours' shards smaller, or empty. An empty table
    gives no shard. Columns of any name are kept inside ``row``.

    Keys and sizes are written once (a row of some 30 bytes for a record) and searched; texts are shuffled once, by
    range, into tasks of about TASK_BYTES."""
    spark, size, tie = docs.sparkSession, record_size(F.col(text_col)), F.xxhash64(F.col(key_col), F.col(text_col))
    keyed = docs.select(F.col(key_col).alias("key"), tie.alias("tie"), size.alias("size"), F.struct("*").alias("row"))
    keys = materialize(keyed.select("key", "tie", "size"), "keys")
    some = keys.where("key is not null").select("key").first()
    stand_in = F.lit(some.key if some else None).cast(keys.schema["key"].dataType)
    keys = keys.withColumn("stand_in", stand_in)
    ends = shard_ends(keys, shards, seed)
    tasks = max(shards, -(-(keys.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    dealt = keyed.withColumn("stand_in", stand_in).select(_number(ends).alias("shard"), "key", "tie", "size", "row")
    order = [F.col("shard"), F.asc_nulls_first("key"), F.col("tie")]
    ordered = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered.select("shard", "at", "size", "row").write.partitionBy("shard").parquet(f"{path}/records")
    _write_slots(spark, path, docs)


def _records(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    from pyspark.sql.types import StructField, StructType

    fields = spark.createDataFrame([], "at long, size long").schema.fields
    shard = spark.createDataFrame([], "shard int").schema.fields
    return spark.read.schema(StructType([*fields, StructField("row", docs.schema), *shard])).parquet(f"{path}/records")


def _task() -> Column:
    return F.shiftright("at", 33).cast("int")  # Spark's ids hold the task above bit 33


def _write_slots(spark: SparkSession, path: str, docs: DataFrame) -> None:
    """A row for each shard and task that has records of it; so few that the driver adds them up."""
    found = _records(spark, path, docs).groupBy("shard", _task().alias("task")).agg(F.min("at").alias("first_at"), F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    out, filled = [], {}
    for r in sorted(found, key=lambda r: (r.shard, r.task)):
        out.append((r.shard, r.task, r.first_at, filled.get(r.shard, 0), r.rows, r.bytes))
        filled[r.shard] = filled.get(r.shard, 0) + r.rows
    spark.createDataFrame(out, "shard int, task int, first_at long, first_slot long, rows long, bytes long").coalesce(1).write.parquet(f"{path}/slots")


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """shard, slot (from 0 without gaps in each shard), size, row. ``docs`` gives the columns of ``row``."""
    slots = spark.read.schema("shard int, task int, first_at long, first_slot long").parquet(f"{path}/slots")
    rows = _records(spark, path, docs).withColumn("task", _task()).join(F.broadcast(slots), ["shard", "task"])
    return rows.select("shard", (F.col("first_slot") + F.col("at") - F.col("first_at")).alias("slot"), "size", "row")
