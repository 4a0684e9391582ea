"""An approximate vector index: vectors in lists by their nearest centroid, with product-quantised codes.

Lists are made in two steps: cells around coarse centroids, and lists around finer ones within each cell, so a
vector is compared with some hundred centroids however many lists there are. A vector's code has a byte for every
CODE_DIMS numbers of what is left of it when its list's centroid is taken away. A search reads the codes of the
lists nearest to a query, orders their vectors by the similarity that codes tell, and scores the best of them
exactly. How many lists and how many vectors that takes is measured when the index is built, by exact searches for
a sample of its vectors, and kept with it; so recall holds on vectors with clusters and without.

Centroids and codes are fitted on a bounded sample; every vector is in the index. A vector without direction
(null, or all zeros) is similar to nothing and lies in list -1, which no query reads.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import vector
from textloom.sources.shared import shared_folder, written

#: Vectors that centroids and codes are fitted on, about; lists at most (their centroids are some MB), which larger
#: tables fill with more vectors each.
MAX_SAMPLE, MAX_LISTS = 100_000, 8_192
#: Lists up to which there is one step: each cell is a list.
ONE_STEP = 64
CODE_DIMS, CODE_WORDS = 4, 256
#: Sampled queries, the share of their TOP exact best that a search is to find, and that must lie in the lists read.
CALIBRATION, TOP, RECALL, LIST_RECALL = 100, 10, 0.95, 0.98
#: Candidates of a query at most while the index is measured.
MOST_SCORED = 2_000
#: Queries of a block: their tables of code words are some 16 MB.
BLOCK = 256
#: Candidates, rows of a few dozen bytes, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NOWHERE = -1


@dataclass
class VectorIndex:
    """``vectors``: the columns given, ``list`` and ``code``. ``centroids``: unit vectors, a row for each list;
    ``cells``: unit vectors, a row for each cell, and ``starts`` the first list of each. ``words``: code words by
    part. ``probes`` lists are read, and ``scored`` vectors scored, for a search of TOP."""

    vectors: DataFrame
    cells: np.ndarray
    starts: np.ndarray
    centroids: np.ndarray
    words: np.ndarray
    id_col: str = "id"
    column: str = "embedding"
    probes: int = 1
    scored: int = TOP

    @property
    def empty(self) -> bool:
        return not self.centroids.any()


def _centres(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k means of a sample's rows; fewer if fewer differ."""
    rows = np.unique(rows, axis=0)
    k = min(k, len(rows))
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(rows, -(-len(rows) * k // vector.CELLS))])
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _lists_of(units: np.ndarray, cells: np.ndarray, starts: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The list of each vector: the nearest cell, then the nearest list in it."""
    cell, out = (units @ cells.T).argmax(1), np.zeros(len(units), np.int64)
    for c in np.unique(cell):
        first, last = starts[c], starts[c + 1]
        own = cell == c
        out[own] = first + (units[own] @ centroids[first:last].T).argmax(1)
    return out


def _parts(rows: np.ndarray) -> np.ndarray:
    """(rows, parts, CODE_DIMS), with zeros behind the last number."""
    wide = -(-rows.shape[1] // CODE_DIMS) * CODE_DIMS
    return np.pad(rows, ((0, 0), (0, wide - rows.shape[1]))).reshape(len(rows), -1, CODE_DIMS)


def _codes(rest: np.ndarray, words: np.ndarray) -> np.ndarray:
    parts = _parts(rest)
    return np.stack([((w**2).sum(1) - 2 * parts[:, m] @ w.T).argmin(1) for m, w in enumerate(words)], axis=1).astype(np.uint8)


def _placed(index: VectorIndex) -> DataFrame:
    """The index's vectors with list and code."""
    cells, starts, centroids, words = index.cells, index.starts, index.centroids, index.words

    @F.pandas_udf("struct<list int, code binary>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists, codes = np.full(len(batch), NOWHERE, np.int32), [None] * len(batch)
            units = vector.unit_rows(batch)
            for at in range(0, len(batch), 2_000):
                there = at + np.flatnonzero(units[at : at + 2_000].any(axis=1))
                if len(there):
                    lists[there] = own = _lists_of(units[there], cells, starts, centroids)
                    for k, code in zip(there, _codes(units[there] - centroids[own], words), strict=True):
                        codes[k] = code.tobytes()
            yield pd.DataFrame({"list": lists, "code": codes})

    return index.vectors.withColumn("__place", place(F.col(index.column).cast("array<double>"))).select("*", "__place.list", "__place.code").drop("__place")


def _fitted(sample: DataFrame, lists: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells, first lists, centroids and code words, fitted in tasks on the sample's unit vectors (``v``). A cell,
    or a part of all codes, is fitted by one task; both are bounded by the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n_cells = lists if lists <= ONE_STEP else round(math.sqrt(lists))
    if n_cells > 1:
        model = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="f", distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("f")))
        cells = _units(np.array(model.clusterCenters()))
    else:
        cells = _units(np.array([sample.first().v]))
    each = 1 if lists <= ONE_STEP else -(-lists // n_cells)

    def nearest_cell(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v) @ cells.T).argmax(1).astype(np.int32))

    def sublists(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": key[0], "v": list(_units(_centres(np.stack(rows["v"]), each, seed)))})

    if each == 1:
        starts, centroids = np.arange(len(cells) + 1), cells
    else:
        found = sample.withColumn("cell", F.pandas_udf(nearest_cell, "int")("v")).groupBy("cell").applyInPandas(sublists, "cell int, v array<double>").collect()
        by_cell = {c: [r.v for r in found if r.cell == c] or [list(cells[c])] for c in range(len(cells))}
        starts, centroids = np.cumsum([0] + [len(by_cell[c]) for c in range(len(cells))]), np.array([v for c in range(len(cells)) for v in by_cell[c]])

    def rests(v: pd.Series) -> pd.Series:
        units = np.stack(v)
        return pd.Series([p.tolist() for p in _parts(units - centroids[_lists_of(units, cells, starts, centroids)])])

    def code_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": key[0], "v": list(_centres(np.stack(rows["p"]), CODE_WORDS, seed))})

    parts = sample.select(F.posexplode(F.pandas_udf(rests, "array<array<double>>")("v")).alias("part", "p"))
    found = parts.groupBy("part").applyInPandas(code_words, "part int, v array<double>").collect()
    words = [np.array([r.v for r in found if r.part == m]) for m in range(1 + max(r.part for r in found))]
    # parts with fewer words repeat their first
    words = np.stack([np.concatenate([w, np.repeat(w[:1], CODE_WORDS - len(w), axis=0)]) for w in words])
    return cells, starts, centroids, words


def build(vectors: DataFrame, id_col: str = "id", column: str = "embedding", lists: int | None = None, seed: int = 7, recall: float | None = RECALL) -> VectorIndex:
    """An index over ``vectors``, whose vectors have one length. ``lists``: by default as many as the root of
    their number. ``recall``: what searches are to find of the exact best; None leaves it unmeasured. An empty
    table has one list. Lists and codes are columns of a plan; an index that is used more than once is to be saved
    or its ``vectors`` written first."""
    doubles = F.transform(F.col(column), lambda x: x.cast("double"))
    some = vectors.where(F.coalesce(F.exists(F.col(column), lambda x: x != 0), F.lit(False)))
    n = some.count()
    none = np.zeros((1, 1))
    if n == 0:
        return VectorIndex(vectors.withColumns({"list": F.lit(NOWHERE), "code": F.lit(None).cast("binary")}), none, np.array([0, 1]), none, np.zeros((1, CODE_WORDS, CODE_DIMS)), id_col, column)
    k = max(1, min(lists or round(math.sqrt(n)), MAX_LISTS, n))
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, MAX_SAMPLE / n)))
    sample = (some.where(share) if n > MAX_SAMPLE else some).select(vector.unit(doubles).alias("v")).repartition(F.xxhash64("v")).cache()
    fitted = VectorIndex(vectors, *_fitted(sample, k, seed), id_col, column)
    sample.unpersist()
    index = replace(fitted, vectors=_placed(fitted), probes=len(fitted.centroids), scored=MOST_SCORED)
    return index if recall is None else calibrated(index, recall)


def calibrated(index: VectorIndex, recall: float = RECALL, queries: int = CALIBRATION) -> VectorIndex:
    """The index with the fewest lists and vectors that a search needs for ``recall``. Queries are ``queries`` of
    its own vectors, the first by hash, none of which counts as found by finding itself."""
    if index.empty:
        return index
    some = index.vectors.where("list >= 0").select(index.id_col, index.column)
    asked = some.orderBy(F.xxhash64(index.id_col), index.id_col).limit(queries).select(F.col(index.id_col).alias("query_no"), F.col(index.column).alias("query_vector"))
    asked = index.vectors.sparkSession.createDataFrame(asked.collect(), asked.schema)
    truth = vector.nearest(some, asked, TOP + 1, index.id_col, index.column).where(F.col("query_no") != F.col(index.id_col))
    truth = index.vectors.select(index.id_col, "list").join(F.broadcast(truth.where(F.col("rank") <= TOP + 1).select("query_no", index.id_col)), index.id_col).collect()
    if not truth:
        return replace(index, probes=len(index.centroids), scored=TOP)
    (numbers, units), = vector.query_blocks(asked, queries + 1)
    order = np.argsort(np.argsort(-(units @ index.centroids.T), axis=1, kind="stable"), axis=1)
    at = {q: k for k, q in enumerate(numbers)}
    places = sorted(order[at[r.query_no], r.list] for r in truth)
    probes = 1 + int(places[math.ceil(max(recall, LIST_RECALL) * len(places)) - 1])
    found: dict = {}
    for r in candidates(index, asked, MOST_SCORED, probes).collect():
        found.setdefault(r.query_no, []).append((-r.score, r[index.id_col]))
    ranks = {(q, i): k for q, rows in found.items() for k, (_, i) in enumerate(sorted(rows), 1)}
    needed = sorted(ranks.get((r.query_no, r[index.id_col]), MOST_SCORED) for r in truth)
    return replace(index, probes=probes, scored=max(TOP, int(needed[math.ceil(recall * len(needed)) - 1])))


def candidates(index: VectorIndex, queries: DataFrame, n: int, probes: int) -> DataFrame:
    """query_no, id, list and score (by codes) of the ``n`` best vectors in the ``probes`` lists nearest to each query.
    Only ids and codes of these lists are read."""
    id_col, id_type, no_type = index.id_col, dict(index.vectors.dtypes)[index.id_col], dict(queries.dtypes)["query_no"]
    schema = f"query_no {no_type}, {id_col} {id_type}, list int, score double"

    def run(numbers: list, units: np.ndarray) -> DataFrame:
        to_centroid = units @ index.centroids.T
        nearest = np.argsort(-to_centroid, axis=1, kind="stable")[:, :probes]
        asked_by = {int(x): np.flatnonzero((nearest == x).any(axis=1)) for x in np.unique(nearest)}
        # inner products of each query's parts with the code words
        table = np.einsum("qmd,mkd->qmk", _parts(units), index.words).astype(np.float32)
        base = to_centroid.astype(np.float32)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, list_of = vector.Best(n, len(numbers)), {}
            for batch in batches:
                for x, rows in batch.groupby("list"):
                    asking = asked_by[int(x)]
                    for at in range(0, len(rows), step := max(1, vector.CELLS // len(asking))):
                        part = rows.iloc[at : at + step]
                        codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                        score = np.repeat(base[asking, int(x)][:, None], len(part), axis=1)
                        for m in range(codes.shape[1]):
                            score += table[asking, m][:, codes[:, m]]
                        best.add(asking, part[id_col].to_numpy(), score.astype(float))
                        list_of.update(dict.fromkeys(part[id_col], int(x)))
                kept = set(best.rows["id"])
                list_of = {k: v for k, v in list_of.items() if k in kept}
            found = best.rows
            yield pd.DataFrame({"query_no": [numbers[q] for q in found["query"]], id_col: found["id"].to_numpy(), "list": [list_of[i] for i in found["id"]], "score": found["score"].to_numpy()})

        return index.vectors.where(F.col("list").isin(sorted(asked_by))).select(id_col, "list", "code").mapInPandas(scan, schema)

    return vector.ranked_lists(vector.by_block(queries, BLOCK, run, schema, "candidates"), n, id_col).drop("rank")


#: Numbers of the vectors that are broadcast at a time, 64 MB: 131,072 vectors of 64.
PIECE = 1 << 23
#: Vectors whose neighbours a task looks for at a time, others that one product compares them with, and pairs of which
#: exact products are taken at once.
ASKING, COMPARED, EXACT = 1024, 4096, 1 << 16


def neighbours(index: VectorIndex, k: int, probes: int | None = None) -> DataFrame:
    """id, other and distance (between unit vectors) of the ``k`` nearest others of each vector that has a direction,
    in the lists nearest to it (``probes``: as many as the index has found to be needed). Lists are broadcast in
    pieces of PIECE numbers, and every task looks there for its own vectors' neighbours, so a piece costs ``k`` rows for each
    vector, however many tasks there are. The pieces' results are written as they are found. ``index`` is to
    be a saved one."""
    id_col, spark = index.id_col, index.vectors.sparkSession
    id_type, probes = dict(index.vectors.dtypes)[id_col], min(probes or index.probes, len(index.centroids))
    schema = f"id {id_type}, other {id_type}, score double"
    path, most = shared_folder(spark, "neighbours"), max(1, PIECE // index.centroids.shape[1])
    counts = {r.list: r["count"] for r in index.vectors.where("list >= 0").groupBy("list").count().collect()}  # MAX_LISTS at most
    pieces: list[tuple[list[int], int, int]] = []
    for x in sorted(counts):
        parts = -(-counts[x] // most)
        if parts == 1 and pieces and pieces[-1][2] == 1 and sum(counts[y] for y in pieces[-1][0]) + counts[x] <= most:
            pieces[-1][0].append(x)
        else:
            pieces += [([x], p, parts) for p in range(parts)]
    if not pieces:
        found = spark.createDataFrame([], schema)
    else:
        # near vectors are asked for together, and read again for each piece
        own = index.vectors.where("list >= 0").select(id_col, "list", index.column)
        own = written(own.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "list", F.xxhash64(id_col)), "asking")
        for lists, part, parts in pieces:
            piece = own.where(F.col("list").isin(lists) & (F.pmod(F.xxhash64(id_col), F.lit(parts)) == part)).toArrow()
            if len(piece):
                piece = piece.sort_by([("list", "ascending"), (id_col, "ascending")]).combine_chunks()
                units = vector.unit_array(piece.column(index.column).chunk(0))
                shared = spark.sparkContext.broadcast((piece.column(id_col).chunk(0), piece.column("list").to_numpy(), units))
                _near(index, own, shared, k, probes, schema).write.mode("append").parquet(path)
                shared.destroy()
        found = spark.read.schema(schema).parquet(path)
    ranked = vector.ranked_lists(found.withColumnRenamed("id", "query_no"), k, "other")
    return ranked.select(F.col("query_no").alias("id"), "other", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("distance"), F.col("rank").cast("int").alias("rank"))


def _near(index: VectorIndex, own: DataFrame, shared: Broadcast, k: int, probes: int, schema: str) -> DataFrame:
    """The ``k`` nearest in a piece (ids, lists, unit vectors; by list and id) of each vector of ``own``."""
    column, centroids = index.column, index.centroids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, others = shared.value
        narrow, place = others.astype(np.float32), ids.to_numpy(zero_copy_only=False).argsort(kind="stable").argsort(kind="stable")
        for batch in batches:
            for at in range(0, batch.num_rows, ASKING):
                part = batch.slice(at, ASKING)
                units = vector.unit_array(part.column(2))
                nearest = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes]
                asked = np.zeros((len(units), len(centroids)), bool)
                np.put_along_axis(asked, nearest, True, axis=1)
                itself = pc.index_in(part.column(0), ids).fill_null(-1).to_numpy(zero_copy_only=False)
                q, r, score = _best(units, others, narrow, asked, lists, itself, place, k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), ids.take(pa.array(r)), pa.array(score)], ["id", "other", "score"])

    return own.select(index.id_col, "list", column).mapInArrow(scan, schema)


def _best(units: np.ndarray, others: np.ndarray, narrow: np.ndarray, asked: np.ndarray, lists: np.ndarray, itself: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``units``, rows of ``others`` and scores (9 decimals) of each one's ``k`` best in the lists that it has asked for,
    ties by ``place``. Products in single precision rule out what cannot be among them, by the most that they are off."""
    off = (units.shape[1] + 16) * 6e-8 + 1e-9
    q, r, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(units), -np.inf)
    for at in range(0, len(others), COMPARED):
        of = lists[at : at + COMPARED]
        some = np.flatnonzero(asked[:, np.unique(of)].any(axis=1))
        if not len(some):
            continue
        rough = units[some].astype(np.float32) @ narrow[at : at + COMPARED].T
        inside = (itself[some] >= at) & (itself[some] < at + len(of))
        rough[np.flatnonzero(inside), itself[some][inside] - at] = -np.inf
        cut = least[some]
        if rough.shape[1] > k and not np.isfinite(cut).all():
            if not asked.all():
                rough[~asked[np.ix_(some, of)]] = -np.inf
            cut = np.maximum(cut, np.partition(rough, -k, axis=1)[:, -k] - off)
        x, y = np.nonzero(rough >= np.maximum(cut - off, -2)[:, None].astype(np.float32))
        there = asked[some[x], of[y]]
        x, y = some[x[there]], at + y[there]
        if not len(x):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", units[x[i : i + EXACT]], others[y[i : i + EXACT]]) for i in range(0, len(x), EXACT)])
        q, r, score = np.append(q, x), np.append(r, y), np.append(score, np.round(exact, 9))
        order = np.lexsort((place[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, np.arange(len(units)))
        kept = np.arange(len(q)) - first[q] < k
        q, r, score = q[kept], r[kept], score[kept]
        count = np.bincount(q, minlength=len(units))
        last = np.cumsum(count) - 1
        least[count == k] = score[last[count == k]]
    return q, r, score


def search(index: VectorIndex, queries: DataFrame, k: int = TOP, probes: int | None = None, scored: int | None = None) -> DataFrame:
    """The columns of the index, query_no, score and rank of the k best for each query (query_no, query_vector), of
    any number. Candidates by codes come first; their vectors are then scored exactly."""
    probes = min(probes or index.probes, len(index.centroids))
    n = max(k, (scored or index.scored) * -(-k // TOP))
    if index.empty:  # no vector has a direction
        none = index.vectors.drop("list", "code").where("false").withColumn("score", F.lit(0.0)).crossJoin(queries.select("query_no").where("false"))
        return none.withColumn("rank", F.lit(0).cast("long"))
    some = written(candidates(index, queries, n, probes).drop("score"), "candidates")
    read = [r.list for r in some.select("list").distinct().collect()]  # MAX_LISTS at most
    few = some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = index.vectors.where(F.col("list").isin(read)).drop("code").join(F.broadcast(some) if few else some, ["list", index.id_col]).drop("list")
    rows = rows.join(queries.select("query_no", "query_vector"), "query_no")
    rows = rows.withColumn("score", F.round(vector.cosine(F.col(index.column), F.col("query_vector")), 6)).drop("query_vector")
    return vector.ranked_lists(rows, k, index.id_col)


def recall(index: VectorIndex, queries: DataFrame, k: int = TOP, probes: int | None = None, scored: int | None = None) -> float:
    """Share of the exact k best that the index finds."""
    exact = vector.nearest(index.vectors, queries, k, index.id_col, index.column).select("query_no", index.id_col).cache()
    found = search(index, queries, k, probes, scored).select("query_no", index.id_col)
    n = exact.count()
    share = exact.join(found, ["query_no", index.id_col], "left_semi").count() / n if n else 1.0
    exact.unpersist()
    return share


# a collection: the index under a path


def _save_vectors(index: VectorIndex, path: str) -> None:
    """In a folder for each list, in ranges of lists, so a list of very many equal vectors is not one task's."""
    index.vectors.repartitionByRange(F.col("list"), F.xxhash64(index.id_col)).write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")


def _save_numbers(index: VectorIndex, path: str) -> None:
    numbers = lambda kind, rows: [(kind, k, [float(x) for x in np.ravel(r)]) for k, r in enumerate(rows)]
    rows = numbers("cell", index.cells) + numbers("start", index.starts) + numbers("centroid", index.centroids) + numbers("words", index.words)
    rows += [("probes", index.probes, []), ("scored", index.scored, []), (f"id:{index.id_col}", 0, []), (f"column:{index.column}", 0, [])]
    index.vectors.sparkSession.createDataFrame(rows, "kind string, ordinal long, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def save(index: VectorIndex, path: str) -> None:
    _save_vectors(index, path)
    _save_numbers(index, path)


def create(vectors: DataFrame, path: str, id_col: str = "id", column: str = "embedding", lists: int | None = None, seed: int = 7, recall: float = RECALL) -> VectorIndex:
    """A saved index. Its vectors are placed once, and what recall needs is measured on what was written."""
    index = build(vectors, id_col, column, lists, seed, None)
    _save_vectors(index, path)
    index = calibrated(replace(index, vectors=vectors.sparkSession.read.schema(index.vectors.schema).parquet(f"{path}/vectors")), recall)
    _save_numbers(index, path)
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.ordinal)
    of = lambda kind: np.array([r.numbers for r in rows if r.kind == kind])
    named = dict(r.kind.split(":", 1) for r in rows if ":" in r.kind)
    number = {r.kind: r.ordinal for r in rows if r.kind in ("probes", "scored")}
    words = of("words")
    words = words.reshape(len(words), CODE_WORDS, CODE_DIMS)
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), of("cell"), of("start").ravel().astype(int), of("centroid"), words, named["id"], named["column"], **number)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, _ = _folder(spark, path)
    # centroids are written last
    return bool(system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids/_SUCCESS")))


def drop(spark: SparkSession, path: str) -> bool:
    system, target = _folder(spark, path)
    return bool(system.delete(target, True))


def open_or_create(spark: SparkSession, path: str, make: Callable[[], VectorIndex], recreate: bool = False) -> VectorIndex:
    """The saved index; made and saved if there is none, or if it is to be made again."""
    if recreate:
        drop(spark, path)
    if not exists(spark, path):
        save(make(), path)
    return load(spark, path)
