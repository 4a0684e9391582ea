"""Density clusters and a map of vectors, from the graph of their nearest neighbours.

A point's core distance is that of its ``min_samples``-th nearest other. Points a and b are linked at the larger of
their core distances and their own distance, if one is among the other's ``neighbours`` nearest. The links are taken
in bands, at ``LEVELS`` distances (quantiles of all links), shortest first: with each band components grow
together, which is the tree of components seen at these distances. A component of at least ``least`` points is a
cluster. It stays one while it only takes in smaller components, and ends where it meets another cluster. Clusters
that no cluster is within are the leaves of the tree, and are what is found; all other points are noise.

A band is one step for all its links: joins and sums over the tables of points and components and the band's own
links. Once no more than DRIVER_LINKS links are left, the driver takes the same steps
for the bands that remain; it gets these links and their components, never the points.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import ann
from textloom.sources.shared import delete, shared_folder, written

NOISE = -1
NEIGHBOURS, LEVELS = 15, 32
#: Links between components that the driver joins at most: a MB or two.
DRIVER_LINKS = 20_000


def mutual_links(near: DataFrame, min_samples: int) -> DataFrame:
    """a, b (a < b) and w of ``near`` (id, other, distance, rank): each link once, at its mutual reachability. A point
    with fewer neighbours than ``min_samples`` has its farthest one's distance as its core distance."""
    core = near.where(F.col("rank") <= min_samples).groupBy("id").agg(F.max("distance").alias("core"))
    links = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("d"))
    links = links.join(core.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    return links.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def cut_distances(links: DataFrame, levels: int = LEVELS) -> list[float]:
    """Quantiles of the links' w, the largest included."""
    found = links.agg(F.percentile_approx("w", [(k + 1) / levels for k in range(levels)], 10_000).alias("c"), F.max("w").alias("most")).first()
    return sorted({*(found.c or []), found.most}) if found.most is not None else []


def _joined(pairs: DataFrame) -> DataFrame:
    """comp and root: the smallest component of those that the pairs (u < v) join, for all in them."""
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["u"]
    few = pairs.limit(DRIVER_LINKS + 1).collect()
    if len(few) <= DRIVER_LINKS:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for r in few:
            u, v = find(r.u), find(r.v)
            root[max(u, v)] = min(u, v)
        return F.broadcast(spark.createDataFrame([(x, find(x)) for x in list(root)], f"comp {kind}, root {kind}"))
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "pairs")
    labels = written(both.groupBy(F.col("u").alias("comp")).agg(F.least(F.col("u"), F.min("v")).alias("root")), "labels")
    while True:
        # the smallest label among the neighbours', then the label of that label
        near = both.join(labels.withColumnRenamed("comp", "v"), "v").groupBy(F.col("u").alias("comp")).agg(F.min("root").alias("other"))
        lower = labels.join(near, "comp").select("comp", F.least("root", "other").alias("root"), F.col("root").alias("old"))
        further = labels.select(F.col("comp").alias("root"), F.col("root").alias("further"))
        jumped = written(lower.join(further, "root").select("comp", F.least("root", "further").alias("root"), "old"), "labels")
        labels = jumped.drop("old")
        if jumped.where("root <> old").isEmpty():
            return labels


def leaf_clusters(ids: DataFrame, links: DataFrame, least: int, cuts: list[float]) -> DataFrame:
    """id and cluster of all ``ids`` (a column id): a point's id that names it, null for noise. ``links``: a, b, w;
    ``cuts``: the distances at which they are looked at, the largest of all links included. What has not met by
    then meets behind it, so parts of the graph without a link are clusters if they are large enough. A single
    cluster that meets no other is the whole, and counts as noise."""
    spark, kind = ids.sparkSession, dict(ids.dtypes)["id"]
    folder = shared_folder(spark, "density")

    def step(df: DataFrame, name: str, k: int) -> DataFrame:
        """The table for band k; that of the band before last is deleted."""
        df.write.parquet(f"{folder}/{name}-{k}")
        delete(spark, f"{folder}/{name}-{k - 2}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}-{k}")

    band = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        band = F.when(F.col("w") <= cuts[k], k).otherwise(band)
    none, large = F.lit(None).cast(kind), F.col("size") >= least
    # comp: a point's component. A component is small, or a cluster (leaf: its name), or has ended
    points = step(ids.select("id", F.col("id").alias("comp"), none.alias("cluster")), "points", 0)
    comps = step(ids.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("ended"), (F.col("id") if least <= 1 else none).alias("leaf")), "comps", 0)
    links.select("a", "b", band.cast("int").alias("band")).write.partitionBy("band").parquet(f"{folder}/links")
    banded = spark.read.schema(f"a {kind}, b {kind}, band int").parquet(f"{folder}/links")
    in_band = {r.band: r["count"] for r in banded.groupBy("band").count().collect()}

    def between(some: Column) -> DataFrame:
        """u < v and the first band of the components that these links are between. A link is looked up once."""
        x, y = (points.select(F.col("id").alias(end), F.col("comp").alias(name)) for end, name in (("a", "x"), ("b", "y")))
        met = banded.where(some).join(x, "a").join(y, "b").where("x <> y")
        return met.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("band").alias("band"))

    for k in range(len(cuts)):
        if sum(n for b, n in in_band.items() if b >= k) <= DRIVER_LINKS:
            return _rest_on_driver(points, comps, between(F.col("band") >= k).collect(), least)
        joined = _joined(between(F.col("band") == k).select("u", "v"))
        grown = comps.join(joined, "comp").groupBy("root").agg(F.sum("size").alias("size"), F.count_if(large).alias("met"), F.bool_or("ended").alias("ended"), F.max(F.when(large, F.col("leaf"))).alias("leaf"))
        ended = F.col("ended") | (F.col("met") > 1)
        leaf = F.when(ended, none).when(F.col("met") == 1, F.col("leaf")).when(large, F.col("root"))
        grown = grown.select(F.col("root").alias("comp"), "size", ended.alias("ended"), leaf.alias("leaf"))
        comps = step(comps.join(joined, "comp", "left_anti").unionByName(grown), "comps", k + 1)
        # a component of most points is one row here
        moves = joined.join(comps.select(F.col("comp").alias("root"), "leaf"), "root")
        moved = points.join(moves, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"), F.coalesce("cluster", "leaf").alias("cluster"))
        points = step(moved, "points", k + 1)
    return _unless_whole(points, comps.where(large).select("ended").limit(2).collect())


def _unless_whole(points: DataFrame, large: list) -> DataFrame:
    """id and cluster, none if the only large component (all, or two, are given) is one cluster."""
    whole = len(large) == 1 and not large[0].ended
    return points.select("id", F.lit(None).cast(dict(points.dtypes)["id"]).alias("cluster") if whole else "cluster")


@dataclass
class _Comp:
    size: int
    ended: bool
    leaf: object
    open: list  # components whose points have no cluster yet


def _rest_on_driver(points: DataFrame, comps: DataFrame, links: list, least: int) -> DataFrame:
    """The remaining bands, as there are few links left: the same steps in Python. ``links``: u, v, band."""
    spark, kind = points.sparkSession, dict(points.dtypes)["id"]
    some = spark.createDataFrame([(x,) for x in {c for r in links for c in (r.u, r.v)}], f"comp {kind}")
    state = {r.comp: _Comp(r.size, r.ended, r.leaf, [r.comp]) for r in comps.join(F.broadcast(some), "comp", "left_semi").collect()}
    root, assigned = {c: c for c in state}, []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for _, of_band in groupby(sorted(links, key=lambda r: r.band), key=lambda r: r.band):
        before: dict = {}  # components that have met in this band, by their root
        for r in of_band:
            u, v = sorted((find(r.u), find(r.v)))
            if u != v:
                root[v] = u
                before[u] = before.get(u, [u]) + before.pop(v, [v])
        for u, members in before.items():
            parts = [state.pop(c) for c in members]
            large = [p for p in parts if p.size >= least]
            size, ended = sum(p.size for p in parts), any(p.ended for p in parts) or len(large) > 1
            leaf = None if ended else large[0].leaf if large else u if size >= least else None
            waiting = [c for p in parts for c in p.open]
            if leaf is not None:
                assigned += [(c, leaf) for c in waiting]
                waiting = []
            state[u] = _Comp(size, ended, leaf, waiting)
    found = spark.createDataFrame(assigned, f"comp {kind}, leaf {kind}")
    others = comps.where(F.col("size") >= least).join(F.broadcast(some), "comp", "left_anti").select("ended").limit(2).collect()
    out = points.join(F.broadcast(found), "comp", "left").select("id", F.coalesce("cluster", "leaf").alias("cluster"))
    return _unless_whole(out, [*others, *[c for c in state.values() if c.size >= least]])


def least_cluster_size(n: int) -> int:
    """A thirtieth of the points, between 3 and 20."""
    return max(3, min(20, -(-n // 30)))


def density_clusters(index: ann.VectorIndex, least: int | None = None, neighbours: int = NEIGHBOURS, levels: int = LEVELS, probes: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """id and cluster (NOISE for noise, and for vectors without direction) of a saved index's vectors, whose ids are
    whole numbers, each once. ``least``: the least size of a cluster, and the neighbour that core distances go to.
    ``near``: their neighbours, if they are known already, at least ``least`` of them."""
    ids = index.vectors.select(F.col(index.id_col).alias("id"))
    least = least or least_cluster_size(ids.count())
    if near is None:
        near = written(ann.neighbours(index, max(neighbours, least), probes), "near")
    links = written(mutual_links(near, least), "links")
    found = leaf_clusters(ids, links, least, cut_distances(links, levels))
    return found.select("id", F.coalesce("cluster", F.lit(NOISE)).cast("long").alias("cluster"))
