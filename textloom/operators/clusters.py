"""Clusters of bullet vectors with two coordinates each: by density, or by principal components and bisecting
k-means, where points far from their centre, and clusters below the least size, count as noise (-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ann, density, layout
from textloom.operators.density import least_cluster_size
from textloom.operators.themes import NOISE
from textloom.sources.shared import shared_folder, written


def cluster_points(points: DataFrame, vector: str = "embedding", k: int | None = None, seed: int = 7, components: int = 5, outliers: float = 0.95) -> DataFrame:
    """``points`` with cluster_id, x and y (the first two components). Fewer points than two clusters' least
    size are all noise. Only counts reach the driver; the models are a few hundred numbers."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = points.count()
    least = least_cluster_size(n)
    if n < 2 * least:
        return points.withColumns({"cluster_id": F.lit(NOISE), "x": F.lit(0.0), "y": F.lit(0.0)})
    rows = points.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    pca = PCA(k=components, inputCol="__v", outputCol="__p").fit(rows)
    rows = pca.transform(rows)
    model = BisectingKMeans(k=k or max(2, min(30, n // (3 * least))), seed=seed, featuresCol="__p", predictionCol="__c", minDivisibleClusterSize=float(2 * least)).fit(rows)
    rows = model.transform(rows).withColumn("__a", vector_to_array("__p"))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    far = F.aggregate(F.zip_with("__a", centres[F.col("__c")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("__far", far)
    stats = rows.groupBy("__c").agg(F.count("*").alias("__n"), F.percentile_approx("__far", outliers).alias("__limit"))
    rows = rows.join(F.broadcast(stats), "__c")
    cluster = F.when((F.col("__n") >= least) & (F.col("__far") <= F.col("__limit")), F.col("__c")).otherwise(NOISE)
    return rows.withColumns({"cluster_id": cluster.cast("int"), "x": F.col("__a")[0], "y": F.col("__a")[1]}).drop("__v", "__p", "__c", "__a", "__far", "__n", "__limit")


def density_points(points: DataFrame, vector: str = "embedding", id_col: str = "bullet_id", neighbours: int = density.NEIGHBOURS) -> DataFrame:
    """``points`` with cluster_id (a number that names the cluster), x and y, by the graph of nearest neighbours of a
    saved index of their vectors. A point is known by the hash of its id."""
    spark = points.sparkSession
    numbered = points.withColumn("__id", F.xxhash64(id_col).bitwiseAND(F.lit((1 << 63) - 1)))
    index = ann.create(numbered.select(F.col("__id").alias("id"), F.col(vector).alias("embedding")), shared_folder(spark, "points"))
    least = least_cluster_size(index.vectors.count())
    near = written(ann.neighbours(index, max(neighbours, least)), "near")
    found = density.density_clusters(index, least, near=near).join(layout.layout(index, near.where(F.col("rank") <= neighbours)), "id")
    found = found.select(F.col("id").alias("__id"), F.col("cluster").alias("cluster_id"), "x", "y")
    return numbered.join(written(found, "placed"), "__id").drop("__id")


def first_of_cluster(points: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy("ordinal")
    return points.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")
