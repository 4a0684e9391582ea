"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing A-Z only (``lower`` would touch every script).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest table, in rows of a few dozen bytes, that an operator broadcasts by itself: 100 MB at most.
BROADCAST_ROWS = 1_000_000

_own_dirs: dict[int, str] = {}
#: Paths made outside of every ``scratch``, and those of the innermost one of this thread.
_made: list[str] = []
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a single machine, where the
    session need not name one, a folder of our own. On a cluster without one this fails: executors would
    write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _own_dirs:
        folder = tempfile.TemporaryDirectory(prefix="textloom-")
        atexit.register(folder.cleanup)
        _own_dirs[key] = f"file://{folder.name}"
    return _own_dirs[key]


def _here() -> list[str]:
    made = _scratch.get()
    return _made if made is None else made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``scratch`` or ``release`` will delete."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    _here().append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete what this driver has put into the shared folder, in any file system that Spark can reach. To be
    called when results that were made from it have been written; what a ``scratch`` still uses stays."""
    while _made:
        _delete(spark, _made.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end, the tables made inside by the same thread, but for those passed to the function it
    gives as soon as they are made. For steps whose results are all written before the end."""
    outer, mine, kept = _here(), [], set()
    token = _scratch.set(mine)

    def keep(made: DataFrame) -> DataFrame:
        kept.add(mine[-1])
        return made

    try:
        yield keep
    finally:
        _scratch.reset(token)
        outer += [p for p in mine if p in kept]
        for path in mine:
            if path not in kept:
                _delete(spark, path)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (they are counted), else as it is,
    so that a larger one is joined by a shuffle. For materialised tables of narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Keys with more than one in so many rows count as common: there are fewer of them than this.
COMMON = 1_000


def join_copies(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has a row for each ``key`` and its number of rows, ``copies``.
    Every key of ``rows`` is in it. Common keys are joined by a broadcast of fewer than COMMON rows; the rows that
    have found theirs are then dealt by their place instead of their key, so no key gathers in one task."""
    others = [c for c in values.columns if c not in (key, "copies")]
    total = values.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    common = values.where(F.col("copies") * COMMON > total).select(key, F.struct(*others).alias("__common"))
    marked = rows.join(F.broadcast(common), key, "left")
    place = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    marked = marked.withColumn("__key", F.when(F.col("__common").isNull(), F.col(key).cast("string")).otherwise(place))
    rest = values.where(F.col("copies") * COMMON <= total).select(F.col(key).cast("string").alias("__key"), F.struct(*others).alias("__rest"))
    both = marked.join(rest, "__key", "left")
    return both.select(*rows.columns, *[F.coalesce(f"__common.{c}", f"__rest.{c}").alias(c) for c in others])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``row`` (the columns of ``df``) and ``place``, from 0 in the given order, materialised. One range shuffle;
    places are those within a task and the rows of the tasks before, a number for each task, which the driver
    adds up."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(ordered.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), name)
    # Spark's ids hold the task in the upper 31 bits, and the place in it below
    task = F.shiftright("at", 33).cast("int")
    before, offsets = 0, []
    for r in sorted(made.groupBy(task.alias("task")).count().collect()):
        offsets.append((r.task, before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(offsets, "task int, before long")
    placed = made.withColumn("task", task).join(F.broadcast(offsets), "task")
    return placed.select("row", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def batches_of(column, size: int) -> Iterator[list]:
    """Python values of an Arrow column, a few at a time."""
    for at in range(0, len(column), size):
        yield column.slice(at, size).to_pylist()
