"""Vector search: cosine top-k, rank fusion, chunk aggregation, re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources.shared import shared_folder

OVER_FETCH, DEFAULT_LIMIT = 5, 10
RRF_K = 40


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarities(vectors: DataFrame, query: list[float], column: str = "embedding", digits: int = 6) -> DataFrame:
    """``vectors`` with ``score``: the cosine with one query vector, a literal of the plan, so no join."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col(column), literal), digits))


def unit(c: Column) -> Column:
    """The vector divided by its length, which is taken once, not for each number; null for one of length zero."""
    return F.when(dot(c, c) > 0, T.let(F.sqrt(dot(c, c)), lambda length: F.transform(c, lambda x: x.cast("double") / length)))


def query_similarities(vectors: DataFrame, queries: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with each query (query_no, query_vector) and ``score``. Queries are broadcast: the phrases of
    one request, a handful, or a block of ``in_blocks``. Lengths are taken once for each vector, so a pair costs
    one inner product."""
    rows = vectors.withColumn("__length", F.sqrt(dot(F.col(column), F.col(column))))
    asked = queries.withColumn("__q_length", F.sqrt(dot(F.col("query_vector"), F.col("query_vector"))))
    pairs = rows.join(F.broadcast(asked))
    score = F.try_divide(dot(F.col(column), F.col("query_vector")), F.col("__length") * F.col("__q_length"))
    return pairs.withColumn("score", F.round(score, 6)).drop("query_vector", "__length", "__q_length")


#: Query vectors of a block.
BLOCK = 4096


def in_blocks(vectors: DataFrame, queries: DataFrame, column: str = "embedding") -> DataFrame:
    """``query_similarities`` of any number of queries, in blocks of about BLOCK, each a broadcast of its own."""
    n = max(1, -(-queries.count() // BLOCK))
    out = None
    for k in range(n):
        block = queries.where(F.pmod(F.xxhash64("query_no"), F.lit(n)) == k) if n > 1 else queries
        some = query_similarities(vectors, block, column)
        out = some if out is None else out.unionByName(some)
    return out


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; zeros for nulls and vectors without direction."""
    dims = next((len(v) for v in vectors if v is not None), 1)
    rows = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        if v is not None:
            rows[k] = v
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


#: Scores that a task holds at a time.
CELLS = 1 << 22


class Best:
    """The best ``k`` rows (query number, id, score) for each of ``n`` queries of those added, in a task; ties by id."""

    def __init__(self, k: int, n: int):
        self.k, self.rows = k, pd.DataFrame({"query": pd.Series(dtype="int64"), "id": [], "score": pd.Series(dtype="float64")})
        self.least = np.full(n, -np.inf)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: a row for each of ``queries``, a column for each of ``ids``."""
        least = self.least[queries]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        new = pd.DataFrame({"query": queries[q], "id": ids[r], "score": scores[q, r]})
        both = new if self.rows.empty else pd.concat([self.rows, new])
        self.rows = both.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(self.k)
        full = self.rows.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy()] = full["min"].to_numpy()


def query_blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """Numbers and unit vectors of the queries that have a direction, about ``size`` at a time on the driver."""
    n = max(1, -(-queries.count() // size))
    for k in range(n):
        block = queries.where(F.pmod(F.xxhash64("query_no"), F.lit(n)) == k) if n > 1 else queries
        rows = sorted((r.query_no, r.query_vector) for r in block.select("query_no", "query_vector").collect())
        units = unit_rows(pd.Series([v for _, v in rows])) if rows else np.zeros((0, 1))
        known = units.any(axis=1)
        if known.any():
            yield [q for (q, _), there in zip(rows, known, strict=True) if there], units[known]


def by_block(queries: DataFrame, size: int, run, schema: str, name: str) -> DataFrame:
    """What ``run`` finds for each block of queries. One block is a plan; of several each is written when it is
    found, so plan and memory do not grow with the number of queries."""
    spark, path, first = queries.sparkSession, None, None
    for numbers, units in query_blocks(queries, size):
        if path is None and first is not None:
            path = shared_folder(spark, name)
            first.write.mode("append").parquet(path)
        found = run(numbers, units)
        if path is None:
            first = found
        else:
            found.write.mode("append").parquet(path)
    if first is None:
        return spark.createDataFrame([], schema)
    return first if path is None else spark.read.schema(schema).parquet(path)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """query_no, id, score and rank of the exact ``k`` best vectors for each query (query_no, query_vector), by
    one matrix product for each batch of vectors. A task keeps the best of what it reads, so ``k`` rows for each
    query and task are shuffled. Vectors and queries without direction are similar to nothing."""
    id_type, no_type = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_no"]
    schema = f"query_no {no_type}, {id_col} {id_type}, score double"

    def run(numbers: list, units: np.ndarray) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, every, step = Best(k, len(numbers)), np.arange(len(numbers)), max(1, CELLS // len(numbers))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.iloc[at : at + step]
                    rows = unit_rows(part[column])
                    there = rows.any(axis=1)
                    if there.any():
                        best.add(every, part[id_col].to_numpy()[there], np.round(units @ rows[there].T, 6))
            yield pd.DataFrame({"query_no": [numbers[q] for q in best.rows["query"]], id_col: best.rows["id"].to_numpy(), "score": best.rows["score"].to_numpy()})

        return vectors.select(id_col, column).mapInPandas(scan, schema)

    return ranked_lists(by_block(queries, BLOCK, run, schema, "nearest"), k, id_col)


#: Scores of one product of ``at_least`` and ``aggregated``, of which all may be kept.
PIECE = 1 << 20
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def unit_array(column: pa.Array) -> np.ndarray:
    """``unit_rows`` of an Arrow column of arrays."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0)
    if column.null_count or not len(column) or column.values.null_count or not lengths[0] or (lengths != lengths[0]).any():
        return unit_rows(column.to_pandas())
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype("float64")
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def products(batches: Iterator[pa.RecordBatch], units: np.ndarray, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches, which of their vectors have a direction, and their scores in millionths with all queries."""
    step = max(1, PIECE // len(units))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows = unit_array(part.column(part.schema.get_field_index(column)))
            there = rows.any(axis=1)
            if not there.any():
                rows = np.zeros((len(rows), units.shape[1]))
            yield part, there, np.rint((units @ rows.T) * 1e6) + 0.0


def dealt(vectors: DataFrame) -> DataFrame:
    """Vectors in several tasks for each core, however few files they lie in: a product costs far more than a shuffle."""
    return vectors.repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism)


def at_least(vectors: DataFrame, queries: DataFrame, threshold: float, id_col: str = "id", column: str = "embedding") -> DataFrame:
    """query_no, id and score of all pairs of queries (query_no, query_vector) and vectors that reach a threshold, by
    one matrix product for each piece of a batch. Only pairs that reach it leave the task. Vectors and queries
    without direction are similar to nothing."""
    id_type, no_type = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_no"]
    schema = f"query_no {no_type}, {id_col} {id_type}, score double"

    def run(numbers: list, units: np.ndarray) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = pa.array(numbers, _ARROW.get(no_type))
            for part, there, scores in products(batches, units, column):
                scores = scores / 1e6
                q, r = np.nonzero(~(scores < threshold) & there)  # NaN is above all numbers, as in Spark
                if len(q):
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), part.column(0).take(pa.array(r)), pa.array(scores[q, r])], ["query_no", id_col, "score"])

        return dealt(vectors.select(id_col, column)).mapInArrow(scan, schema)

    return by_block(queries, BLOCK, run, schema, "at-least")


def top_k(scored: DataFrame, limit: int | None = DEFAULT_LIMIT, id_col: str = "id", threshold: float | None = None) -> DataFrame:
    """The best rows with their rank; a threshold drops rows afterwards, and ranks keep their gaps. A limit of
    0 means the default. Without a limit all rows that reach the threshold."""
    from textloom.functions.present import best

    order, reached = [F.desc("score"), F.col(id_col)], F.col("score") >= (threshold or 0.0)
    if limit is None:
        return best(scored.where(reached) if threshold else scored, *order)
    out = best(scored, *order, limit=limit or DEFAULT_LIMIT)
    return out.where(reached) if threshold else out


def aggregated(vectors: DataFrame, queries: DataFrame, how: str, doc_col: str, column: str = "embedding") -> DataFrame:
    """query_no, doc, score and matching_chunks of all vectors for each query (query_no, query_vector), aggregated as
    by ``aggregate_chunks``: no pair of a query and a vector leaves the task that multiplies them, only what it has
    found for each query and document. Vectors and queries without direction count, and have no score."""
    if how not in ("best", "max", "sum", "avg_top3"):
        raise ValueError(f"unknown aggregation: {how}")
    doc_type, no_type = dict(vectors.dtypes)[doc_col], dict(queries.dtypes)["query_no"]
    depth = 0 if how == "sum" else 3 if how == "avg_top3" else 1
    schema = f"query_no {no_type}, {doc_col} {doc_type}, total double, top array<double>"

    def run(numbers: list, units: np.ndarray) -> DataFrame:
        n = len(numbers)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, kept, docs_type = pa.array(numbers, _ARROW.get(no_type)), {}, None

            def found() -> pa.RecordBatch:
                names = pa.array(list(kept), docs_type)
                total, top = np.stack([t for t, _ in kept.values()]), np.stack([b for _, b in kept.values()])
                columns = [asked.take(pa.array(np.tile(np.arange(n), len(kept)))), names.take(pa.array(np.repeat(np.arange(len(kept)), n))), pa.array(total.ravel())]
                ends = np.arange(0, depth * total.size + 1, depth or 1)[: total.size + 1] if depth else np.zeros(total.size + 1)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(top.ravel())))
                return pa.RecordBatch.from_arrays(columns, ["query_no", doc_col, "total", "top"])

            for part, there, scores in products(batches, units, column):
                each = part.column(part.schema.get_field_index(doc_col)).filter(pa.array(there)).dictionary_encode("encode")
                if not len(each):
                    continue
                scores, docs_type = scores[:, there], each.type.value_type
                codes = each.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                scores, ends = scores[:, order], np.cumsum(np.bincount(codes))
                for doc, start, end in zip(each.dictionary.to_pylist(), [0, *ends], ends, strict=False):
                    own = scores[:, start:end]
                    total, top = kept.get(doc, (0.0, np.full((n, depth), -np.inf)))
                    if depth == 1:
                        top = np.maximum(top, own.max(axis=1, keepdims=True))
                    elif depth:
                        top = np.concatenate([top, own], axis=1)
                        top = np.partition(top, -depth, axis=1)[:, -depth:]
                    # whole numbers of millionths, so sums do not depend on the order
                    kept[doc] = (total + own.sum(axis=1), top)
                if len(kept) * n > PIECE:
                    yield found()
                    kept.clear()
            if kept:
                yield found()

        return dealt(vectors.select(column, doc_col)).mapInArrow(scan, schema)

    rows = by_block(queries, BLOCK, run, schema, "aggregated")
    scores = {"sum": F.sum("total"), "avg_top3": F.collect_list("top")}.get(how, F.max(F.get("top", F.lit(0))))
    found = rows.groupBy("query_no", doc_col).agg(scores.alias("score"))
    if how == "avg_top3":
        best = F.slice(F.sort_array(F.filter(F.flatten("score"), lambda x: x > float("-inf")), asc=False), 1, 3)
        found = found.withColumn("score", F.aggregate(best, F.lit(0.0), lambda s, x: s + x / 1e6) / F.size(best))
    else:
        found = found.withColumn("score", F.col("score") / 1e6)
    # all queries have all documents, also those of which no vector has a direction
    sizes = vectors.groupBy(doc_col).agg(F.count("*").alias("matching_chunks")).withColumnRenamed(doc_col, "__doc")
    every = queries.groupBy(F.col("query_no").alias("__no")).agg(F.count("*").alias("__times")).crossJoin(sizes)
    out = every.join(found, F.col("__no").eqNullSafe(F.col("query_no")) & F.col("__doc").eqNullSafe(F.col(doc_col)), "left")
    return out.select(F.col("__no").alias("query_no"), F.col("__doc").alias(doc_col), F.round("score", 6).alias("score"), (F.col("matching_chunks") * F.col("__times")).alias("matching_chunks"))


#: Rows of one query are ranked in ranges of scores of this width.
SCORE_STEP = 0.001


def ranked_lists(scored: DataFrame, depth: int | None, id_col: str = "id") -> DataFrame:
    """The best ``depth`` rows of each query with their rank; without a depth all rows. Those are ranked within
    ranges of scores, behind the rows of the ranges above, so no task holds all rows of a query."""
    if depth is not None:
        order = Window.partitionBy("query_no").orderBy(F.desc("score"), id_col)
        return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth)
    cut = F.coalesce(F.floor(F.col("score") / SCORE_STEP), F.lit(-1 << 40)).alias("__cut")
    rows = scored.select("*", cut)
    counts = rows.groupBy("query_no", "__cut").agg(F.count("*").alias("n"))
    above = Window.partitionBy("query_no").orderBy(F.desc("__cut")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("query_no", "__cut", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__before"))
    order = Window.partitionBy("query_no", "__cut").orderBy(F.desc("score"), id_col)
    rows = rows.withColumn("__k", F.row_number().over(order)).join(before, ["query_no", "__cut"])
    return rows.select(*scored.columns, (F.col("__before") + F.col("__k")).cast("long").alias("rank"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """id, rrf, score, first_seen of ranked lists (query_no, id, rank, score). Rows are ordered by the fused
    value, but the score reported is the best similarity. Ties keep the order in which ids were first seen."""
    seen = F.min(F.struct("query_no", "rank"))
    return lists.groupBy(id_col).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("score"), seen.alias("first_seen"))


def fused(lists: DataFrame, limit: int | None = None, k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """Fused rows with their rank; without a limit all of them."""
    from textloom.functions.present import best

    return best(reciprocal_rank_fusion(lists, k, id_col), F.desc("rrf"), F.col("first_seen"), F.col(id_col), limit=limit).drop("first_seen")


def aggregate_chunks(hits: DataFrame, how: str = "best", doc_col: str = "doc_id", chunk_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """Chunk hits by document, and by the columns ``by`` (of a query): ``best`` (or ``max``) keeps the best chunk, ``avg_top3`` and ``sum`` its mean or
    sum; ``none`` changes nothing. Raises for any other name. Returns doc, chunk (the best one), score,
    matching_chunks."""
    if how == "none":
        return hits.select(*by, F.col(doc_col), F.col(chunk_col).alias("chunk"), "score", F.lit(1).cast("long").alias("matching_chunks"))
    best = F.max_by(chunk_col, F.struct("score", -F.col(chunk_col)) if dict(hits.dtypes)[chunk_col] in ("bigint", "int") else F.col("score")).alias("chunk")
    count = F.count("*").alias("matching_chunks")
    if how in ("best", "max"):
        return hits.groupBy(*by, doc_col).agg(best, F.max("score").alias("score"), count)
    if how == "sum":
        return hits.groupBy(*by, doc_col).agg(best, F.round(F.sum("score"), 6).alias("score"), count)
    if how == "avg_top3":
        order = Window.partitionBy(*by, doc_col).orderBy(F.desc("score"), chunk_col)
        numbered = hits.withColumn("__k", F.row_number().over(order))
        return numbered.groupBy(*by, doc_col).agg(F.max(F.when(F.col("__k") == 1, F.col(chunk_col))).alias("chunk"), F.round(F.avg(F.when(F.col("__k") <= 3, F.col("score"))), 6).alias("score"), count)
    raise ValueError(f"unknown aggregation: {how}")


def rerank(fulltext: DataFrame, chunk_scores: DataFrame) -> DataFrame:
    """doc_id, fulltext_score, semantic_score, combined_score of full-text hits: half the full-text score (a
    tenth of it, 1 at most, where it is above 1), half the best chunk's cosine, 0 at least."""
    best = chunk_scores.groupBy("doc_id").agg(F.max("score").alias("s"))
    lexical = F.when(F.col("score") > 1, F.least(F.col("score") / 10, F.lit(1.0))).otherwise(F.col("score"))
    semantic = F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))
    out = fulltext.join(best, "doc_id", "left")
    return out.select("doc_id", F.round(lexical, 6).alias("fulltext_score"), semantic.alias("semantic_score"), F.round(0.5 * lexical + 0.5 * semantic, 6).alias("combined_score"))
