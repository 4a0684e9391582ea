"""The engine facade: search, themes, metadata and profile of one corpus, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import present as P
from textloom.functions import text as T
from textloom.functions.filters import apply_filters
from textloom.operators import ann, clusters, fulltext, hybrid, themes, vector
from textloom.operators.index import Index, build_index, chunk_table, load_index, save_index
from textloom.plugins import Annotator, Embedder, Expander, HashEmbedder, NoExpansion, OfflineAnnotator, expansion_phrases
from textloom.sources.corpus import BULLET_FIELDS, PARTICIPANT_NAMES, metadata_fields, metadata_map, metadata_values, participant, profile, select_text


@dataclass(frozen=True)
class ThemeParams:
    seed: str = ""
    text_source: str = "all"
    metadata_filters: dict[str, Any] | None = None
    max_docs: int | None = None
    n_quotes: int = 3
    bullet_words: str = "10-18"
    max_themes: int = 12
    include_theme_summaries: bool = True
    summary_length: str = "15-20 word"
    candidates_per_cluster: int = 3
    max_points_for_scoring: int | None = None
    max_candidate_clusters: int = 30
    label_bullets: int = 35
    clusters: int | None = None
    #: "density", or "components" (with ``clusters`` k-means centres)
    cluster_method: str = "components"

    def candidate_clusters(self, found: int) -> int:
        return min(found, max(self.max_themes, min(max(3, min(self.max_candidate_clusters, 80)), 3 * self.max_themes)))


@dataclass
class SearchResult:
    """Rows in their order (column ``rank``), and how each engine fared: ok, planned (it will run when the
    results are read), skipped, or its error."""

    results: DataFrame
    status: dict[str, str]
    fulltext: DataFrame | None = None
    semantic: DataFrame | None = None


@dataclass
class ThemeRun:
    points: DataFrame
    themes: DataFrame
    doc_scores: DataFrame | None = None
    prevalence: DataFrame | None = None
    scores: DataFrame | None = None
    summaries: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)


class TextEngine:
    """Search and themes over ``docs`` (doc_id, text and any metadata columns).

    Indexes are built lazily from the documents, given, or opened from a folder that ``save`` wrote. Semantic
    searches score every chunk; only with a vector index and ``probes`` do those with a limit read so many of its
    lists (0: as many as the index has found to be needed).
    Queries are plans; only names, counts and model replies of a run reach the driver."""

    def __init__(self, spark: SparkSession, docs: DataFrame, *, index: Index | None = None, chunks: DataFrame | None = None, vectors: ann.VectorIndex | None = None, embedder: Embedder | None = None, annotator: Annotator | None = None, expander: Expander | None = None, analyzer: str = "plain", probes: int | None = None):
        self.spark, self.docs, self.analyzer = spark, docs, analyzer
        self.embedder = embedder or HashEmbedder()
        self.annotator = annotator or OfflineAnnotator()
        self.expander = expander or NoExpansion()
        self._index, self._vectors, self.probes = index, vectors, probes
        self._kept: list[DataFrame] = []
        self._planned = index is None
        self._chunks = vectors.vectors.drop("list", "code") if vectors is not None and chunks is None else chunks

    def _keep(self, rows: DataFrame) -> DataFrame:
        """Rows that a request reads more than once, in the executors' memory and disks until ``release``."""
        self._kept.append(rows.cache())
        return self._kept[-1]

    def release(self) -> None:
        """Forgets what requests have kept. Their results can still be read, and are then computed again."""
        while self._kept:
            self._kept.pop().unpersist()

    def save(self, path: str) -> None:
        """The postings, the dictionary of their terms and the chunks' vector index, in a folder of any file system that Spark reaches."""
        save_index(self.index, f"{path}/index", dictionary=True)
        if self._vectors is not None:
            ann.save(self._vectors, f"{path}/chunks")
        else:
            ann.create(self.chunks, f"{path}/chunks")

    @classmethod
    def open(cls, spark: SparkSession, docs: DataFrame, path: str, **options) -> TextEngine:
        """An engine on what ``save`` wrote: nothing is tokenised or embedded again."""
        return cls(spark, docs, index=load_index(spark, f"{path}/index", options.get("analyzer", "plain"), dictionary=True), vectors=ann.load(spark, f"{path}/chunks"), **options)

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = build_index(self.docs, analyzer=self.analyzer)
        return self._index

    def keep_index(self) -> TextEngine:
        """Keeps the whole index in the executors' memory and disks, for many searches over documents that are
        not saved. A single search needs the postings of its terms only."""
        self._index, self._planned = self.index.cache(), False
        return self

    @property
    def chunks(self) -> DataFrame:
        """Sentence chunks with their vectors."""
        if self._chunks is None:
            rows = chunk_table(self.docs)
            self._chunks = self._keep(rows.withColumn("embedding", self.embedder.column(F.col("text"))))
        return self._chunks

    # metadata

    def profile(self) -> dict:
        return profile(self.docs)

    def metadata_fields(self) -> DataFrame:
        return metadata_fields(self.docs.select(metadata_map(self.docs.drop("text")).alias("metadata")))

    def metadata_values(self, name: str, limit: int = 100) -> DataFrame:
        return metadata_values(self.docs, name, limit)

    def full_text(self, doc_id) -> DataFrame:
        return self.docs.where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "text")

    # search

    def search_fulltext(self, query: str | fulltext.Condition, limit: int | None = None, within: DataFrame | None = None) -> DataFrame:
        """``query``: typed words and quoted phrases, or a condition. ``within``: documents (doc_id) that hits are
        taken from."""
        index = fulltext.narrowed(self.index, query, self._keep) if self._planned else self.index
        hits = fulltext.search(index, query, limit, within=within)
        rows = hits.join(self.docs.select("doc_id", "text"), "doc_id")
        return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "text", "score", "match_type", F.col("rank").alias("ordinal"))

    def search_semantic(self, query: str, limit: int | None = None, threshold: float | None = None, aggregate: str = "none", within: DataFrame | None = None) -> tuple[DataFrame, str]:
        phrases, how = expansion_phrases(query, self.expander)
        vectors = [(k, [float(x) for x in v]) for k, v in enumerate(self.embedder.encode(phrases))]
        queries = self.spark.createDataFrame(vectors, "query_no int, query_vector array<double>")
        fetch = None if limit is None else (limit or vector.DEFAULT_LIMIT) * (1 if aggregate == "none" else vector.OVER_FETCH)
        columns = self.chunks.select("id", "doc_id", "text", "embedding")
        if within is not None:
            columns = columns.join(within.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
        if self._vectors is not None and self.probes is not None and fetch is not None and within is None:
            lists = ann.search(self._vectors, queries, fetch, self.probes or None)
        else:
            lists = None
        if len(vectors) == 1:
            scored = vector.similarities(columns, vectors[0][1]) if lists is None else lists.drop("rank", "query_no")
            hits = vector.top_k(scored.drop("embedding"), fetch, threshold=threshold)
        else:
            lists = vector.ranked_lists(vector.query_similarities(columns, queries), fetch) if lists is None else lists
            hits = vector.fused(lists, fetch).join(columns.drop("embedding"), "id")
            hits = hits.where(F.col("score") >= threshold) if threshold else hits
        if aggregate != "none":
            found = vector.aggregate_chunks(hits, aggregate).withColumnRenamed("chunk", "id")
            n = None if limit is None else limit or vector.DEFAULT_LIMIT
            hits = P.best(found, F.desc("score"), F.col("doc_id"), limit=n).join(columns.select("id", "text"), "id")
        return hits.select("id", "doc_id", "text", "score", F.col("rank").alias("ordinal"), F.lit(aggregate == "none").alias("is_chunk")), how

    def _guarded(self, run, limit: int | None) -> tuple[DataFrame | None, str]:
        """An engine's hits and how it fared. With a limit they are few, so they are computed here, where a
        failure does not reach the other engine; without one they stay a plan."""
        try:
            hits = run()
            if limit is None:
                return hits, "planned"
            hits = self._keep(hits)
            hits.count()
            return hits, "ok"
        except Exception as e:  # noqa: BLE001  engines are isolated from each other
            return None, f"error: {e}"

    def search(self, query: str, search_type: str = "hybrid", limit: int | None = None, threshold: float | None = None, filters: dict[str, Any] | None = None, filter_stage: str = "post", condition: fulltext.Condition | None = None) -> SearchResult:
        """Engines, merge, limit, documents, then filters, excerpts that start with metadata, and the threshold:
        so fewer than ``limit`` rows can be left. Without a limit nothing is cut, and ``rank`` has gaps.
        ``filter_stage="pre"`` takes hits from the filtered documents only; the index is the same.
        ``condition`` decides the full-text hits instead of the words of ``query``.
        A failing engine leaves its error in the status and the other's hits in the result."""
        within = apply_filters(self.docs, filters).select("doc_id") if filters and filter_stage == "pre" else None
        status = {"query_expansion": "skipped", "fulltext": "skipped", "semantic": "skipped"}
        full = semantic = None
        if search_type in ("hybrid", "fulltext"):
            full, status["fulltext"] = self._guarded(lambda: self.search_fulltext(query if condition is None else condition, None if limit is None else 2 * limit, within), limit)
        if search_type in ("hybrid", "semantic"):

            def run() -> DataFrame:
                hits, status["query_expansion"] = self.search_semantic(query, limit, threshold if search_type == "semantic" else None, within=within)
                return hits

            semantic, status["semantic"] = self._guarded(run, limit)
        empty = self.spark.createDataFrame([], "id string, doc_id string, text string, score double, ordinal long, is_chunk boolean")
        some_full = full.drop("match_type") if full is not None else empty.drop("is_chunk")
        if search_type == "hybrid":
            hits, order = hybrid.merge(semantic if semantic is not None else empty, some_full, query), hybrid.order_of_hybrid()
        elif search_type == "fulltext":
            hits, order = some_full.withColumns({"search_type": F.lit("fulltext"), "is_chunk": F.lit(False)}), [F.desc("score"), F.col("id")]
        else:
            hits, order = (semantic if semantic is not None else empty).withColumn("search_type", F.lit("semantic")), [F.col("ordinal")]
        if limit is None:
            hits = P.semantic_threshold(hits, threshold)  # no hit takes another's place, so before the documents
        # hits are kept without their documents: joined to them, a text would be kept for each of its chunks
        hits = self._keep(P.best(hits, *order, limit=limit))
        meta = self.docs.withColumn("doc_id", F.col("doc_id").cast("string")).withColumnRenamed("text", "full_text")
        hits = hits.join(meta.drop(*[c for c in hits.columns if c != "doc_id"]), "doc_id", "left")
        if filter_stage == "post":
            hits = apply_filters(hits, filters)
        hits = hits.where(~P.has_metadata_prefix(F.col("text")))
        if threshold and threshold > 0:
            hits = P.score_threshold(hits, threshold)  # the largest score needs the list once more
        return SearchResult(hits, status, full, semantic)

    def search_api(self, query: str, search_type: str = "hybrid", threshold: float | None = None, filters: dict[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
        """Hits with normalized_score, snippet, highlight and response number, the best first; and the histogram
        of participants."""
        found = self.search(query, search_type, None, threshold if threshold and threshold > 0 else None, filters).results
        terms = T.query_words(query)
        hits = P.with_normalized_scores(found, query)
        body = F.col("text")  # of a full-text hit, the document's
        responses = [F.col(c) for c in self.docs.columns if c.lower() in {f"q{k}_response" for k in range(1, 6)}]
        quote = F.when(F.col("search_type") == "fulltext", P.snippet(body, terms)).otherwise(F.col("text"))
        hits = hits.withColumns({"snippet": quote, "highlight": P.highlighted(quote, terms)})
        sentences = F.when(F.col("search_type") == "fulltext", P.matching_sentences(body, terms)).otherwise(F.array().cast("array<string>"))
        hits = hits.withColumn("response", P.inferred_response(F.col("snippet"), responses, sentences) if responses else F.lit(None).cast("int"))
        return hits.orderBy(F.desc("normalized_score"), "rank"), P.prevalence_histogram(hits, self._participant(hits))

    def _participant(self, hits: DataFrame) -> Column:
        """Whom a hit comes from: the documents' own participant columns, else the document."""
        named = [c for c in self.docs.columns if c in PARTICIPANT_NAMES and c != "id"]
        return participant(hits.select("doc_id", *named), "doc_id")

    # themes

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in as many tasks as may annotate at once."""
        return rows.repartition(self.annotator.tasks) if self.annotator.tasks else rows

    def _points(self, params: ThemeParams) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        counts: dict[str, int] = {}
        docs = apply_filters(self.docs, params.metadata_filters, mode="strict")
        chosen = select_text(docs, params.text_source)
        if params.max_docs:
            chosen = chosen.orderBy("doc_id").limit(params.max_docs)
        with_text, kept = select_text(docs.select(*dict.fromkeys(["doc_id", "text", *[c for c in docs.columns if c.lower() == f"{params.text_source.lower()}_response"]])), params.text_source), docs.select("doc_id")
        # both counts in one job
        both = kept.select(F.lit(0).alias("k")).unionByName(with_text.select(F.lit(1).alias("k"))).groupBy("k").count().collect()
        counts = {"filtered": 0, "with_text": 0} | {("filtered", "with_text")[r.k]: r["count"] for r in both}
        quotes = self._dealt(chosen.select("doc_id", "text")).select("doc_id", self.annotator.quotes(F.col("text"), params.seed, params.n_quotes).alias("quotes"))
        quotes = self._keep(quotes)
        points = self._dealt(themes.bullets(quotes)).withColumn("bullet", self.annotator.bullet(F.col("source_text"), params.seed, params.bullet_words))
        points = self._keep(points.withColumn("embedding", self.embedder.column(F.col("bullet"))))
        points = clusters.density_points(points) if params.cluster_method == "density" else clusters.cluster_points(points, k=params.clusters)
        points = points.withColumn("ordinal", F.struct("doc_id", "bullet_no")).drop("embedding")
        fields = [c for c in dict.fromkeys([*BULLET_FIELDS, *PARTICIPANT_NAMES]) if c in self.docs.columns and c != "id"]
        points = themes.with_metadata(points, self.docs, fields)
        if "participant_id" not in fields:
            points = points.withColumn("participant_id", participant(points.select("doc_id", *[c for c in fields if c in PARTICIPANT_NAMES]), "doc_id"))
        points = self._keep(points)
        counts["bullets"] = points.count()
        return points, quotes, counts

    def _labelled(self, points: DataFrame, params: ThemeParams, k: int) -> DataFrame:
        """Themes of the chosen clusters: a cluster's first bullets (35 at most) go to the annotator."""
        largest = themes.largest_clusters(points, params.candidate_clusters(points.select("cluster_id").distinct().count()))
        first = clusters.first_of_cluster(points.join(F.broadcast(largest.select("cluster_id")), "cluster_id", "left_semi"), params.label_bullets)
        each = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "bullet", F.col("doc_id").cast("string").alias("doc_id")))), lambda x: F.struct(x["bullet"].alias("bullet"), x["doc_id"].alias("doc_id")))
        rows = first.groupBy("cluster_id").agg(each.alias("each")).join(largest, "cluster_id").collect()
        made = []
        for r in sorted(rows, key=lambda r: (-r.n, r.cluster_id)):
            bullets, doc_ids = [e.bullet for e in r.each], [e.doc_id for e in r.each]
            for t in self.annotator.theme(r.cluster_id, bullets, params.seed, k, doc_ids)[:k]:
                chosen = t.get("example_ids") or []
                # the bullets of the documents that the model chose, else the cluster's first
                shown = [b for d in dict.fromkeys(chosen) for b, own in zip(bullets, doc_ids, strict=True) if own == d] or bullets
                made.append((len(made), r.cluster_id, f"{r.cluster_id}-{len(made)}", t["name"], t["prompt"], r.n, shown[:6], chosen or list(dict.fromkeys(doc_ids))[:6]))
        kind = dict(points.dtypes)["cluster_id"]
        df = self.spark.createDataFrame(made, f"ordinal int, cluster_id {kind}, theme_id string, name string, prompt string, n_points long, representative_bullets array<string>, example_doc_ids array<string>")
        return themes.distinct_themes(df)

    def _described(self, found: DataFrame, points: DataFrame, quotes: DataFrame) -> DataFrame:
        """Themes with their cluster's centroid and up to four quotes of their documents."""
        order = points.select("cluster_id", F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("doc_id").alias("ordinal"))
        first = order.groupBy("cluster_id", "doc_id").agg(F.min("ordinal").alias("ordinal"))
        said = themes.representative_quotes(found.dropDuplicates(["cluster_id"]), quotes.withColumn("doc_id", F.col("doc_id").cast("string")), first)
        out = found.join(themes.cluster_centroids(points), "cluster_id", "left").join(said.withColumnRenamed("quotes", "representative_quotes"), "cluster_id", "left")
        return out.withColumn("representative_quotes", F.coalesce("representative_quotes", F.array().cast("array<string>")))

    def theme_exploration(self, params: ThemeParams) -> ThemeRun:
        """Candidate themes per cluster; no review and no scores."""
        points, quotes, counts = self._points(params)
        found = self._described(self._labelled(points, params, params.candidates_per_cluster), points, quotes)
        return ThemeRun(points, found, counts=counts | {"clusters": found.select("cluster_id").distinct().count()})

    def theme_scoring(self, points: DataFrame, chosen: DataFrame, params: ThemeParams, theme_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Graded scores of points with themes, and for each theme with matches the best of them and its summary. ``theme_ids``: the candidates
        to score, by their theme_id; without it all. A theme of several candidates of one cluster is told apart
        by its theme_id, which is then the concept's."""
        concept = F.col("cluster_id").cast("string")
        if theme_ids is not None:
            ids = self.spark.createDataFrame([(str(t),) for t in dict.fromkeys(theme_ids)], "theme_id string")
            chosen, concept = chosen.join(F.broadcast(ids), "theme_id", "left_semi"), F.col("theme_id")
        chosen = chosen.select(concept.alias("cluster_id"), "name", "prompt")
        some = points.orderBy("ordinal").limit(params.max_points_for_scoring) if params.max_points_for_scoring else points
        concepts = self._keep(chosen.withColumnRenamed("cluster_id", "concept_id"))
        answers = self._keep(self.annotator.grade(some.select("bullet_id", F.col("source_text").alias("text"), "bullet"), concepts))
        scores = themes.graded(some, chosen, answers).join(some.select("bullet_id", F.col("source_text").alias("text"), "bullet", "ordinal"), "bullet_id")
        names = F.broadcast(concepts.select("concept_id", F.col("name").alias("concept_name"), F.col("prompt").alias("concept_prompt")))
        scores = scores.join(names, "concept_id").withColumn("concept_seed", F.lit(params.seed))
        matches = themes.top_matches(scores).join(names.select("concept_id", F.col("concept_name").alias("name")), "concept_id")
        if params.include_theme_summaries:
            matches = self._keep(self.annotator.summaries(matches, params.summary_length))
        else:
            matches = matches.withColumn("summary", F.lit(None).cast("string"))
        return scores, matches

    def themes(self, params: ThemeParams) -> ThemeRun:
        """The whole run: bullets, clusters, themes, review, shares, prevalence and graded scores."""
        points, quotes, counts = self._points(params)
        found = self._labelled(points, params, 1)
        removed, selected = self.annotator.review([r.asDict() for r in found.select("cluster_id", "n_points", "name", "prompt").collect()], params.max_themes)
        ids = lambda xs: self.spark.createDataFrame([(int(x),) for x in xs], f"cluster_id {dict(found.dtypes)['cluster_id']}")
        kept = themes.review(found, ids(removed), ids(selected), params.max_themes)
        kept = self._keep(self._described(kept, points, quotes))
        doc_scores = themes.doc_theme_scores(points, kept)
        scores, summaries = self.theme_scoring(points, kept, params)
        return ThemeRun(points, kept, doc_scores, themes.theme_prevalence(doc_scores, kept), scores, summaries, counts | {"clusters": kept.count()})
