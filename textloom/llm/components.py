"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import join_copies, materialize, scratch

#: Links that the driver joins at most: a MB or two. More are joined by rounds of joins.
DRIVER_LINKS = 20_000


def _joined(us: list, vs: list) -> list[tuple]:
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for u, v in zip(us, vs, strict=True):
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    return [(x, find(x)) for x in list(root)]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: for each node of ``links`` the smallest node that it reaches.

    Each round takes the smallest label among neighbours and then follows labels to their own labels, so
    long chains shrink fast. Labels are written after each round. A node with very many links, and a label of
    very many nodes, is joined by ``join_copies``: neither's rows gather in one task, and minima are
    pre-aggregated before the shuffle. Links with a null end are left out; a link of a node with itself gives
    its component of one; no links give no rows. At most DRIVER_LINKS links are joined on the driver instead."""
    spark = links.sparkSession
    with scratch(spark) as keep:
        both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
        few = both.limit(DRIVER_LINKS + 1).toArrow()
        if few.num_rows <= DRIVER_LINKS:
            return spark.createDataFrame(_joined(few.column(0).to_pylist(), few.column(1).to_pylist()), f"node {both.dtypes[0][1]}, label {both.dtypes[0][1]}")
        both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
        # a node's links are as many in one direction as in the other
        state = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count("*").alias("degree")), "labels")
        while True:
            ends = state.select(F.col("u").alias("v"), "label", F.col("degree").alias("copies"))
            near = join_copies(both, ends, "v").groupBy("u").agg(F.min("label").alias("near"))
            new = materialize(state.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"), "degree"), "labels")
            members = new.groupBy("label").agg(F.count("*").alias("copies"))
            jump = materialize(members.join(new.select(F.col("u").alias("label"), F.col("label").alias("far")), "label"), "jumps")
            state = materialize(join_copies(new, jump, "label").select("u", "old", F.least("label", "far").alias("label"), "degree"), "labels")
            if state.where("old <> label").isEmpty():
                return keep(state).select(F.col("u").alias("node"), "label")
            state = state.select("u", "label", "degree")
