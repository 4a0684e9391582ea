"""The registered queries of the retrieval and theme operators, each over its whole tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import buckets, filters
from textloom.functions import present as P
from textloom.functions import text as T
from textloom.operators import ann, density, fulltext, grading, hybrid, layout, themes, vector
from textloom.operators.index import Index, build_index, build_postings, chunk_table, load_index, save_index, term_rows, vocabulary
from textloom.operators.segments import GrowingIndex
from textloom.plans.engine import TextEngine, ThemeParams
from textloom.plugins import HashEmbedder, VocabularyEmbedder
from textloom.sources import corpus, sinks, workbook
from textloom.sources.shared import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left")


def index(spark: SparkSession, sf_dir: str, positions: bool = False) -> Index:
    return build_index(documents(spark, sf_dir), positions=positions)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vectors(rows: DataFrame) -> DataFrame:
    """Those whose id 50 divides."""
    return rows.where("id % 50 = 0").select(F.col("id").alias("query_no"), F.col("embedding").alias("query_vector"))


def nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return vector.nearest(rows, query_vectors(rows), k)


# sources and splitting


@query
def doc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = corpus.conversation_responses(read(spark, sf_dir, "conversations"))
    return corpus.assemble_documents(answers, "conv_id").select("id", "text", "row_index", F.size("metadata").cast("long").alias("n_metadata"))


@query
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents' answers, written as workbooks of 500 rows and read as one table."""
    answers = corpus.conversation_responses(read(spark, sf_dir, "conversations"))
    return workbook.workbook_table(workbook.workbook_files(answers, 500))


@query
def workbook_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and texts of a table, through workbooks whose columns find their types again."""
    return workbook.workbook_table(workbook.workbook_files(read(spark, sf_dir, "part"), 5_000))


@query
def data_profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.null_profile(labelled(spark, sf_dir))


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"), T.MIN_SENTENCE)).alias("idx", "sentence"))


def _windows(size: int, overlap: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(F.col("text"), size, overlap)).alias("chunk_index", "c"))
        return rows.select("doc_id", "chunk_index", "c.*")

    return run


_QUERIES |= {"sentence_windows_w1": _windows(1, 0), "sentence_windows_w2o1": _windows(2, 1), "sentence_windows_w4o1": _windows(4, 1)}


@query
def multi_level_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.explode(T.multi_level_chunks(F.col("text"))).alias("c"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("c.sentence_count").alias("n_sentences"), F.sum(F.length("c.text")).alias("n_chars"))


@query
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(documents(spark, sf_dir)).select("id", "doc_id", "chunk_index", "text", "is_chunk")


@query
def chunks_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.chunks_2_3(T.theme_sentences(F.col("text")), None)).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", "c.*")


@query
def ascii_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("“"), F.col("text"), F.lit("”–—’"))
    return documents(spark, sf_dir).select("doc_id", T.ascii_safe(text).alias("safe"))


@query
def text_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.batch_number(F.col("doc_id"), 6).cast("long").alias("batch"))


@query
def prefixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.prefixed(F.col("text"), False, True).alias("passage"))


# full text


@query
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(term_rows(documents(spark, sf_dir)))


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).term_stats


@query
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(documents(spark, sf_dir), analyzer="porter")


def _search(words: list[str], every: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fulltext.top(fulltext.search_terms(index(spark, sf_dir), words, every), 50)

    return run


_QUERIES |= {"bm25_search_and": _search(["the", "that", "with"], True), "bm25_search_or": _search(["entire", "worthless", "anes"], False)}


def _where(condition: fulltext.Condition, positions: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fulltext.search_where(index(spark, sf_dir, positions), condition).select("doc_id", "score", "matched")

    return run


THE_T = fulltext.all_of(fulltext.like("th?t"), fulltext.word("of"))

_QUERIES |= {
    "boolean_not_search": _where(fulltext.all_of(fulltext.any_of(fulltext.word("the"), fulltext.word("der")), fulltext.none_of(fulltext.word("with")))),
    "prefix_search": _where(fulltext.like("worth*")),
    "wildcard_search": _where(THE_T),
    "boosted_search": _where(fulltext.any_of(fulltext.word("idiot", 2), fulltext.word("moron"))),
    "phrase_search": _where(fulltext.phrase("of the"), True),
    "field_search": _where(fulltext.any_of(fulltext.word("moron"), fulltext.word("entire"))),
    "range_search": _where(fulltext.between("worthless", "worthy")),
}


@query
def saved_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "index")
    save_index(index(spark, sf_dir), path)
    return fulltext.top(fulltext.search_terms(load_index(spark, path), ["the", "that", "with"]), 50)


def with_dictionary(spark: SparkSession, sf_dir: str) -> Index:
    path = shared_folder(spark, "dictionary")
    save_index(index(spark, sf_dir), path, dictionary=True)
    return load_index(spark, path, dictionary=True)


@query
def dictionary_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search_fuzzy(with_dictionary(spark, sf_dir), "worthles moron", 1)


@query
def dictionary_wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search_where(with_dictionary(spark, sf_dir), THE_T)


@query
def growing_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two batches, those of low quality are replaced by a longer text, and toxic ones are
    deleted; then the index is searched as it stands."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text", "lang"), read(spark, sf_dir, "labels")
    grown = GrowingIndex(spark, shared_folder(spark, "growing"))
    first = F.coalesce(F.col("lang") == "en", F.lit(False))
    grown.append(docs.where(first))
    grown.append(docs.where(~first))
    grown.append(docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat_ws(" ", "text", F.lit("revised"))))
    grown.delete(labels.where("toxic = 1").select("doc_id"))
    return fulltext.top(fulltext.search_terms(grown.index(), ["revised", "moron", "entire"], False), 50)


@query
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search_fuzzy(index(spark, sf_dir), "worthles moron", 1)


@query
def fuzzy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fulltext.search(index(spark, sf_dir, True), "disgustingg", 200)
    return hits.select("doc_id", "score", "matched", "match_type", "rank")


@query
def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct().where(F.length("term") >= 3)
    return words.select("term", F.array_join(F.sort_array(T.variant_array(F.col("term"))), ",").alias("variants"))


@query
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.term_array(F.col("text")), " ").alias("terms"))


# vectors


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, 10).select("query_no", "id", "score", "rank")


@query
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return vector.ranked_lists(vector.at_least(rows, query_vectors(rows), 0.2), None).select("query_no", "id", "score", "rank")


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.reciprocal_rank_fusion(nearest(spark, sf_dir, 50)).select("id", "rrf", "score")


def _aggregated(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return vector.aggregated(rows, query_vectors(rows), how, "label")

    return run


_QUERIES |= {f"agg_{how}": _aggregated(how) for how in ("best", "avg_top3", "sum")}


def overlap_chunks(spark: SparkSession, sf_dir: str, text: str, size: int = 4, overlap: int = 1) -> DataFrame:
    """Chunks with a score that SQL can repeat: the cosine of the sets of words of query and chunk."""
    words = sorted(set(text.lower().replace('"', "").split()))
    rows = chunk_table(documents(spark, sf_dir), size=size, overlap=overlap)
    own = F.array_distinct(T.tokens(F.col("text")))
    shared = F.size(F.array_intersect(own, F.array(*map(F.lit, words))))
    return rows.withColumn("score", F.round(F.coalesce(F.try_divide(shared.cast("double"), F.sqrt(F.size(own) * F.lit(float(len(words))))), F.lit(0.0)), 6))


@query
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fulltext.search_terms(index(spark, sf_dir), ["entire", "worthless"], False).withColumn("doc_id", F.col("doc_id").cast("string"))
    return vector.rerank(hits, overlap_chunks(spark, sf_dir, "entire worthless").select("doc_id", "score"))


@query
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    full = fulltext.search_terms(index(spark, sf_dir), ["entire", "moron"], False).withColumn("doc_id", F.col("doc_id").cast("string")).join(docs, "doc_id")
    full = full.select(F.col("doc_id").alias("id"), "doc_id", "text", "score", F.lit(0).cast("long").alias("ordinal"))
    semantic = overlap_chunks(spark, sf_dir, "entire moron").where("score > 0.05").select("id", "doc_id", "text", "score", "is_chunk", F.col("chunk_index").cast("long").alias("ordinal"))
    out = hybrid.merge(semantic, full, "entire moron")
    return P.ranked(out.orderBy(*hybrid.order_of_hybrid()[:3], "id").limit(200), *hybrid.order_of_hybrid()[:3], F.col("id")).select("id", "doc_id", "score", "search_type", "exact", "rank")


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hits of two kinds: full-text ones of one word, semantic ones by shared words of whole documents. And the
    full-text ones alone."""
    docs = documents(spark, sf_dir)
    full = fulltext.search_terms(index(spark, sf_dir), ["moron"]).select("doc_id", "score")
    own = F.array_distinct(T.tokens(F.col("text")))
    words = ["entire", "moron", "with"]
    score = lambda own: F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(own, F.array(*map(F.lit, words)))).cast("double"), F.sqrt(F.size(own) * F.lit(3.0))), F.lit(0.0)), 6)
    semantic = docs.withColumn("score", T.let(own, score)).where("score > 0").withColumn("search_type", F.lit("semantic"))
    columns = ["doc_id", "score", "search_type", "text", "source", "lang"]
    return full.withColumn("search_type", F.lit("fulltext")).join(docs, "doc_id").select(*columns).unionByName(semantic.select(*columns)), full


@query
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_threshold(_hits(spark, sf_dir)[0], 0.3).select("doc_id", "search_type", "score")


@query
def normalized_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, full = _hits(spark, sf_dir)
    hits = P.with_normalized_scores(hits, '"entire moron" moron', full)
    return hits.select("doc_id", "search_type", F.round("normalized_score", 8).alias("normalized_score"))


@query
def prevalence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, full = _hits(spark, sf_dir)
    hits = P.with_normalized_scores(hits, "moron entire", full).withColumn("normalized_score", F.round("normalized_score", 8))
    return P.prevalence_histogram(hits, F.concat("source", "lang"))


@query
def snippet_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", P.snippet(F.col("text"), ["moron", "entire"]).alias("snippet"))


@query
def highlight_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", P.highlighted(P.snippet(F.col("text"), ["moron", "that"]), ["moron", "that"]).alias("html"))


# metadata


def _filter_set(mode: str, specs: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.apply_filters(labelled(spark, sf_dir), specs, mode).select("doc_id", "lang", "source", "quality", "toxic")

    return run


_QUERIES |= {
    "meta_filter_hits": _filter_set("hits", {"lang": {"operator": "not_equals", "value": "EN"}, "quality": {"operator": "includes", "value": ["1"]}, "n_chars": {"operator": "between", "value": [500, 3000]}, "source": {"operator": "contains", "value": "SRC1"}, "toxic": {"operator": "odd", "value": 1}}),
    "meta_filter_strict": _filter_set("strict", {"LANG": "en", "Quality": {"operator": "in", "value": [1]}, "N_CHARS": {"operator": "greater_than", "value": "500"}, "toxic": {"operator": "not_includes", "value": [1]}, "source": {"operator": "not_equals", "value": "src3"}, "doc_id": {"operator": "less_than", "value": 900}}),
}


@query
def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).drop("text")
    return corpus.metadata_fields(rows.select(corpus.metadata_map(rows).alias("metadata")))


@query
def meta_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.metadata_values(documents(spark, sf_dir), "source")


@query
def age_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("p_size") % 3 == 0, F.concat((F.col("p_size") + 10).cast("string"), F.lit("–"), (F.col("p_size") + 20).cast("string"))).when(F.col("p_size") % 3 == 1, (F.col("p_size") + 10).cast("string")).otherwise(F.concat((F.col("p_size") + 10).cast("string"), F.lit("-"), (F.col("p_size") + 30).cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", buckets.age_bucket(age).alias("bucket"))


@query
def income_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    dollars = F.floor(F.abs(F.col("c_acctbal")) * 10).cast("long")
    income = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("$"), F.floor(dollars / 1000).cast("string"), F.lit("k"))).when(F.col("c_custkey") % 4 == 1, dollars.cast("string")).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("under $"), dollars.cast("string"))).otherwise(F.concat(F.lit("$"), dollars.cast("string"), F.lit(" - $"), (dollars + 9999).cast("string")))
    return read(spark, sf_dir, "customer").select("c_custkey", buckets.income_bucket(income).alias("bucket"))


@query
def metadata_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    rows = rows.select("doc_id", corpus.metadata_map(rows.drop("text")).alias("metadata"))
    return filters.apply_filters(rows, {"LANG": "en", "n_Chars": {"operator": "greater_than", "value": 500}}, "strict", "metadata").select("doc_id")


@query
def field_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", buckets.field_key_column(F.concat(F.lit(" _"), "p_type", F.lit("_Key "), "p_brand")).alias("key"))


@query
def normalized_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 10).alias("Head_Age"), (F.col("p_size") * 1800).alias("income usd"))
    meta = corpus.metadata_map(rows, normalize=True)
    return rows.select("p_partkey", meta["Head_Age"].alias("age"), meta["income usd"].alias("income"))


@query
def metadata_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("doc_id", F.lit(" 34 $89k Weekly "), "text")).when(F.col("doc_id") % 3 == 1, F.concat("doc_id", F.lit(" 34 "), "text")).otherwise(F.col("text"))
    return docs.withColumn("text", text).where(~P.has_metadata_prefix(F.col("text"))).select("doc_id")


@query
def longform_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = corpus.conversation_responses(read(spark, sf_dir, "conversations"))
    quote = F.coalesce(F.substring("q3_response", 3, 12), F.substring("q2_response", 2, 12), F.lit("#"))
    return answers.select("conv_id", P.inferred_response(quote, [F.col(f"q{k}_response") for k in range(1, 6)]).alias("response"))


@query
def text_source_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = corpus.conversation_responses(read(spark, sf_dir, "conversations"))
    docs = answers.withColumn("text", F.concat_ws(" ", *[f"q{k}_response" for k in range(1, 6)]))
    return corpus.select_text(docs, "q2").select("conv_id", "text")


@query
def full_text_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chunks = chunk_table(docs).withColumn("participant", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id").cast("long") % 2 == 0, F.col("doc_id")).otherwise(F.concat(F.lit("?"), "doc_id")))
    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").cast("string").alias("participant"))
    return hybrid.with_full_text(chunks, known, ["participant"]).select("id", F.length("full_text").cast("long").alias("n_chars"))


@query
def participant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("quality").alias("participant_number"))
    return rows.select(F.col("id").alias("doc_id"), corpus.participant(rows.select("participant_number"), "id").alias("participant"))


@query
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", sinks.safe_filename(F.concat(F.lit(" My run "), "url")).alias("name"))


# themes over the embeddings: label is the cluster, and a document is a group of vectors


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    cluster = F.when(F.col("vec_id") % 7 == 0, themes.NOISE).otherwise(F.col("label")).cast("int")
    return e.select((F.col("vec_id") % 97).alias("doc_id"), F.col("vec_id").alias("bullet_id"), cluster.alias("cluster_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.concat(F.lit("bullet "), F.col("vec_id")).alias("bullet"), F.col("vec_id").alias("ordinal"))


def cluster_table(spark: SparkSession, ids: range = range(6)) -> DataFrame:
    return spark.createDataFrame([(k, f"theme {k % 4}", f"prompt {k % 4}", 10 * k, k, [k, k + 10]) for k in ids], "cluster_id int, name string, prompt string, n_points int, ordinal int, example_doc_ids array<bigint>")


@query
def doc_theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.doc_theme_scores(points(spark, sf_dir), cluster_table(spark))


@query
def theme_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.theme_prevalence(doc_theme_scores(spark, sf_dir), cluster_table(spark))


@query
def cluster_sizes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.largest_clusters(points(spark, sf_dir), 5)


@query
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.cluster_centroids(points(spark, sf_dir))


@query
def theme_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = themes.representatives(cluster_table(spark), points(spark, sf_dir), True)
    return out.select("cluster_id", F.array_join("bullets", "|").alias("bullets"))


def _answers(p: DataFrame) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, ["A", "b: agree", " c", "D", "E", "Z"])), (F.col("bullet_id") % 6 + 1).cast("int"))
    return p.where("bullet_id % 5 <> 0").select("bullet_id", F.col("cluster_id").alias("concept_id"), letter.alias("answer"), F.lit("why").alias("rationale"), F.concat(F.lit("quote "), "bullet_id").alias("quote"))


@query
def theme_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.range(97).select(F.col("id").alias("doc_id"), F.when((F.col("id") % 3 != 0) & (F.col("id") >= 12), F.array(F.concat(F.lit("quote "), "id"))).otherwise(F.array().cast("array<string>")).alias("quotes"))
    return themes.representative_quotes(cluster_table(spark), docs, points(spark, sf_dir)).select("cluster_id", F.array_join("quotes", "|").alias("quotes"))


@query
def bullet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.with_metadata(points(spark, sf_dir).select("doc_id", "bullet_id"), documents(spark, sf_dir), ["source", "lang", "age"])


@query
def chosen_theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    chosen = cluster_table(spark).join(spark.createDataFrame([(0,), (3,), (99,)], "cluster_id int"), "cluster_id", "left_semi")
    return themes.graded(p, chosen, _answers(p)).select("doc_id", "bullet_id", "concept_id", "score")


@query
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise("none")
    return read(spark, sf_dir, "events").select("event_id", themes.json_object(reply, "k int")["k"].alias("k"))


@query
def clamped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 4 == 0, F.lit("many")).otherwise(F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", themes.clamped_int(asked, 3, 80).alias("n"))


@query
def graded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return themes.graded(p, cluster_table(spark), _answers(p)).select("doc_id", "bullet_id", "concept_id", "score", "rationale", "highlight")


@query
def concept_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    rows = themes.graded(p, cluster_table(spark), _answers(p)).withColumn("ordinal", F.col("bullet_id")).withColumn("text", F.lit("text"))
    return themes.top_matches(rows)


def stand_in_model(prompt: str) -> str:
    """Replies that SQL can repeat: examples are graded by the number in their id, in reverse order, every fifth not
    at all; summaries tell how many examples there are, and the first."""
    if prompt.startswith("Sum up"):
        lines = prompt.partition("Examples:\n")[2].split("\n")
        return json.dumps({"summary": f"{len(lines)} examples, first {lines[0][2:]}"})
    examples, theme, results = json.loads(prompt.partition("Examples: ")[2]), int(re.search(r'concept "theme (\d+)"', prompt)[1]), []
    for e in reversed(examples):
        n = int(e["example_id"])
        if n % 5:
            results.append({"example_id": n, "answer": "ABCDEZ"[(n + theme) % 6] + ": so", "rationale": f" bullet {n} of theme {theme} ", "quote": e["example"] if (n + theme) % 6 < 4 else None})
    return "Sure: " + json.dumps({"results": [*results, {"example_id": "none of them", "answer": "A"}]})


def _graded_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, chosen = points(spark, sf_dir), cluster_table(spark).select("cluster_id", "name", "prompt")
    concepts = chosen.withColumnRenamed("cluster_id", "concept_id")
    answers = grading.graded_replies(some.select("bullet_id", F.col("bullet").alias("text")), concepts, stand_in_model, batch=24, tasks=8)
    return themes.graded(some, chosen, answers)


@query
def graded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded_by_model(spark, sf_dir)


@query
def concept_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded_by_model(spark, sf_dir).withColumn("ordinal", F.col("bullet_id")).withColumn("text", F.concat(F.lit("bullet "), "bullet_id"))
    matches = themes.top_matches(rows).join(cluster_table(spark).select(F.col("cluster_id").alias("concept_id"), "name"), "concept_id")
    return grading.concept_summaries(matches, stand_in_model).select("concept_id", "matches", "summary")


@query
def membership_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.membership_scores(points(spark, sf_dir), cluster_table(spark)).select("doc_id", "bullet_id", "concept_id", "concept_name", "score", "highlight")


@query
def theme_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = themes.distinct_themes(cluster_table(spark, range(10)))
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "cluster_id int")
    return themes.review(found, ids([1]), ids([0, 3, 1]), 2).select("cluster_id", "name", "n_points")


@query
def sink_points_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("quote", F.array("bullet", F.lit("b")))
    return sinks.flat(rows, sinks.POINT_COLUMNS)


@query
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", themes.excerpt(F.col("text")).alias("excerpt"))


@query
def bullet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text"), T.MIN_SENTENCE).alias("quotes"))
    return themes.bullets(quotes, None).select("doc_id", "bullet_no", "bullet", "sentence_count")


# whole runs


@query
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = TextEngine(spark, documents(spark, sf_dir), embedder=HashEmbedder(32)).search_api("moron entire", "hybrid", 0.3, {"lang": "en"})
    return rows.select("id", "doc_id", "search_type", "normalized_score", "snippet", "highlight", "response")


#: Vocabulary of an embedder that SQL can repeat.
API_WORDS = ["moron", "entire", "that", "with"]


def _api(spark: SparkSession, sf_dir: str) -> TextEngine:
    return TextEngine(spark, documents(spark, sf_dir), embedder=VocabularyEmbedder(API_WORDS))


@query
def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _api(spark, sf_dir).search("moron", "hybrid", 50).results.select("id", "doc_id", "search_type", "score", "rank")


@query
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = _api(spark, sf_dir).search_api("moron", "hybrid", 0.3, {"lang": "en"})
    return hits.select("id", "doc_id", "search_type", F.round("normalized_score", 8).alias("normalized_score"), F.length("snippet").cast("long").alias("n_snippet"))


@query
def api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a respondent's answers a hit is found in."""
    answers = corpus.conversation_responses(read(spark, sf_dir, "conversations"))
    columns = [f"q{k}_response" for k in range(1, 6)]
    docs = answers.select(F.col("conv_id").alias("doc_id"), F.concat_ws(" ", *columns).alias("text"), *columns)
    hits, _ = TextEngine(spark, docs, embedder=VocabularyEmbedder(API_WORDS)).search_api("tion", "fulltext")
    return hits.select("id", "response")


@query
def api_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _api(spark, sf_dir).search_api("moron", "hybrid", 0.3, {"lang": "en"})[1]


class _Phrases:
    """An expander that always knows the same other words."""

    def phrases(self, query: str, n: int) -> list[str]:
        return [query, "entire that"]


@query
def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = TextEngine(spark, documents(spark, sf_dir), embedder=VocabularyEmbedder(API_WORDS), expander=_Phrases())
    return engine.search("moron", "semantic", 20).results.select("id", "score", "rank")


@query
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each language, with the number of its points and their table, saved and listed again."""
    path = shared_folder(spark, "runs")
    p = points(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    for r in p.groupBy("lang").count().collect():
        sinks.save_run(spark, path, f"themes of/{r.lang}", {"lang": r.lang, "points": r["count"]}, {"points": p.where(F.col("lang").eqNullSafe(r.lang))})
    sinks.save_run(spark, path, "gone", {})
    sinks.delete_run(spark, path, "gone")
    return sinks.list_runs(spark, path).select("run", "payload")


@query
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = ann.create(rows, shared_folder(spark, "vectors"))
    return ann.search(index, query_vectors(rows), 10).select("query_no", "id", "score", "rank")


def _saved_vectors(spark: SparkSession, sf_dir: str) -> ann.VectorIndex:
    return ann.create(vectors(spark, sf_dir).select("id", "embedding"), shared_folder(spark, "vectors"))


@query
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_clusters(_saved_vectors(spark, sf_dir))


@query
def vector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = _saved_vectors(spark, sf_dir)
    drawn = layout.layout(saved, written(ann.neighbours(saved, density.NEIGHBOURS), "near"))
    return drawn.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def theme_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = TextEngine(spark, documents(spark, sf_dir), embedder=HashEmbedder(32)).themes(ThemeParams(seed="moron entire", max_themes=6, clusters=8))
    return run.prevalence.join(run.themes.select("cluster_id", "name", "n_points"), "cluster_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search, the best 50 of the documents that hold all words."""
    return _QUERIES["bm25_search_and"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)

