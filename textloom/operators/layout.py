"""Two coordinates for vectors, so that near ones lie together on a map.

Links of the graph of nearest neighbours get a weight that falls with the distance, in units of each point's own
neighbourhood. The first two principal components are then smoothed over that graph by block power iteration (the
next two eigenvectors behind the trivial one, begun from the components, so parts of the graph that are not linked
keep their places), and points are moved in rounds: towards their neighbours, and away from a sample of all points.

A round is a join of links with coordinates and a sum for each point. What the driver sees of a round are a handful
of sums and the ``SAMPLE`` points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import ann, vector
from textloom.sources.shared import delete, shared_folder, written

POWER_ROUNDS, ROUNDS, SAMPLE = 8, 24, 128
#: Points whose coordinates are broadcast at most: some 30 MB.
BROADCAST_ROWS = 1_000_000


def weighted_links(near: DataFrame) -> DataFrame:
    """a, b and w of ``near`` (id, other, distance), in both directions: exp(-(d - nearest) / spread) seen from each
    end, joined as chances are (p + q - pq)."""
    stats = near.groupBy("id").agg(F.min("distance").alias("first"), F.avg("distance").alias("mean"))
    seen = near.join(stats, "id").select("id", "other", F.exp(-(F.col("distance") - F.col("first")) / F.greatest(F.col("mean") - F.col("first"), F.lit(1e-9))).alias("p"))
    both = seen.unionByName(seen.select(F.col("other").alias("id"), F.col("id").alias("other"), "p"))
    return both.groupBy(F.col("id").alias("a"), F.col("other").alias("b")).agg((F.sum("p") - F.when(F.count("p") > 1, F.product("p")).otherwise(0)).alias("w"))


def principal_components(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, x, y of all vectors with a direction."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(F.col(id_col).alias("id"), vector.unit(F.col(column)).alias("u")).where(F.col("u").isNotNull())
    rows = rows.withColumn("v", array_to_vector("u"))
    if rows.isEmpty() or len(rows.first().u) < 2:
        return rows.select("id", F.col("u")[0].alias("x"), F.lit(0.0).alias("y"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return p.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


class _Steps:
    """A table for each round in a folder of its own; the one before last is deleted."""

    def __init__(self, start: DataFrame):
        self.spark, self.folder, self.n = start.sparkSession, shared_folder(start.sparkSession, "layout"), 0
        self.small = start.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        delete(self.spark, f"{self.folder}/{self.n - 2}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def end(self, coords: DataFrame, name: str) -> DataFrame:
        """Coordinates by their point, to be joined with one end of links."""
        rows = coords.select(F.col("id").alias(name), F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))
        return F.broadcast(rows) if self.small else rows


def smoothed(start: DataFrame, links: DataFrame, rounds: int = POWER_ROUNDS) -> DataFrame:
    """``start`` (id, x, y) after rounds of (I + D^-1 W) / 2, made independent of each other and of the constant by
    degree-weighted sums."""
    steps = _Steps(start)
    degrees = written(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree")), "degrees")
    coords = steps.write(start)
    for _ in range(rounds):
        pulled = links.join(steps.end(coords, "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("w") * F.col("x_b")).alias("px"), F.sum(F.col("w") * F.col("y_b")).alias("py"))
        moved = coords.join(degrees, "id", "left").join(pulled, "id", "left")
        new = {c: F.coalesce((F.col(c) + F.col(f"p{c}") / F.col("degree")) / 2, F.col(c)) for c in ("x", "y")}
        moved = steps.write(moved.select("id", new["x"].alias("x"), new["y"].alias("y"), F.coalesce("degree", F.lit(0.0)).alias("degree")))
        d = F.col("degree")
        s = moved.agg(*[F.sum(e).alias(n) for n, e in {"n": d, "x": d * F.col("x"), "y": d * F.col("y"), "xx": d * F.col("x") ** 2, "yy": d * F.col("y") ** 2, "xy": d * F.col("x") * F.col("y")}.items()]).first()
        if not s.n:
            return coords
        mx, my = s.x / s.n, s.y / s.n
        xx, yy, xy = s.xx / s.n - mx * mx, s.yy / s.n - my * my, s.xy / s.n - mx * my
        over = xy / xx if xx > 0 else 0.0  # what y has of x goes
        left = yy - over * xy
        x = (F.col("x") - mx) / (xx**0.5 if xx > 0 else 1.0)
        y = (F.col("y") - my - over * (F.col("x") - mx)) / (left**0.5 if left > 1e-12 else 1.0)
        coords = moved.select("id", x.alias("x"), y.alias("y"))
    return written(coords, "smoothed")


def _moves(sample: np.ndarray, step: float, repulsion: float):
    """A function of a point's place and the pull on it: its next place, pushed away from the sample."""

    @F.pandas_udf("struct<x double, y double>")
    def move(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y, px, py in batches:
            place = np.stack([x, y], axis=1)
            away = place[:, None] - sample[None]
            square = (away**2).sum(-1)
            push = repulsion * (away / ((0.01 + square) * (1 + square))[:, :, None]).mean(1)
            place = place + step * np.clip(push + np.stack([px, py], axis=1), -4, 4)
            yield pd.DataFrame({"x": place[:, 0], "y": place[:, 1]})

    return move


def attracted(start: DataFrame, links: DataFrame, rounds: int = ROUNDS, scale: float = 5.0, repulsion: float = 30.0) -> DataFrame:
    """``start`` (id, x, y; of unit variance) moved towards neighbours and away from a fixed sample of points, by steps
    that shrink to nothing."""
    steps = _Steps(start)
    coords = steps.write(start.select("id", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y")))
    chosen = [r.id for r in coords.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id").collect()]
    for t in range(1, rounds + 1):
        sample, step = np.array([[r.x, r.y] for r in coords.where(F.col("id").isin(chosen)).collect()]), 1 - t / (rounds + 1)
        dx, dy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
        pull = F.col("w") / (1 + dx * dx + dy * dy) / 2
        pulled = links.join(steps.end(coords, "a"), "a").join(steps.end(coords, "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum(pull * dx).alias("px"), F.sum(pull * dy).alias("py"))

        move = _moves(sample, step, repulsion)
        moved = coords.join(pulled, "id", "left").select("id", move("x", "y", F.coalesce("px", F.lit(0.0)), F.coalesce("py", F.lit(0.0))).alias("m"))
        coords = steps.write(moved.select("id", "m.x", "m.y"))
    return coords


def layout(index: ann.VectorIndex, near: DataFrame, power_rounds: int = POWER_ROUNDS, rounds: int = ROUNDS) -> DataFrame:
    """id, x, y of all vectors of a saved index; those without direction lie at 0, 0. ``near``: their neighbours
    (``ann.neighbours``)."""
    links = written(weighted_links(near), "weights")
    start = written(principal_components(index.vectors, index.id_col, index.column), "start")
    if start.isEmpty():
        placed = start
    else:
        placed = attracted(smoothed(start, links, power_rounds), links, rounds)
    ids = index.vectors.select(F.col(index.id_col).alias("id"))
    return ids.join(placed, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
