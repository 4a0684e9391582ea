"""Search syntax, fusion, merging, themes and the engine on small corpora."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.stem import porter
from textloom.operators import fulltext, hybrid, themes, vector
from textloom.operators.index import build_index, load_index, save_index
from textloom.plans.engine import TextEngine, ThemeParams
from textloom.sources import corpus, sinks

DOCS = [(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, "dogs bark. The dog park"), (4, "birds sing of the cat"), (5, ""), (6, None)]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id long, text string")).cache()


CAT, DOG = fulltext.word("cat"), fulltext.word("Dog")
CONDITIONS = [
    (CAT, {1, 2, 4}), (fulltext.all_of(CAT, DOG), {2}), (fulltext.any_of(CAT, DOG), {1, 2, 3, 4}), (fulltext.all_of(CAT, fulltext.none_of(DOG)), {1, 4}), (fulltext.none_of(CAT), {3}),
    (fulltext.phrase("the cat"), {1, 4}), (fulltext.phrase("cat the"), set()), (fulltext.like("dog*"), {2, 3}), (fulltext.like("d?g"), {2, 3}), (fulltext.like("*ar*"), {3}), (fulltext.like("*"), {1, 2, 3, 4}), (fulltext.like("zz*"), set()),
    (fulltext.all_of(fulltext.any_of(CAT, fulltext.word("bark")), fulltext.none_of(fulltext.word("mat"))), {2, 3, 4}), (fulltext.near("bark"), {3}), (fulltext.near("brk"), {3}), (fulltext.near("birdss", 2), {4}), (fulltext.near("burks", 3), {3, 4}),
    (fulltext.all_of(CAT, fulltext.none_of(DOG, fulltext.word("mat"))), {4}), (fulltext.none_of(fulltext.none_of(CAT)), {1, 2, 4}), (fulltext.between("barj", "bird"), {3}), (fulltext.between("mas", "mb"), {1}), (fulltext.all_of(CAT, fulltext.none_of(fulltext.between("dog", "dogz"))), {1, 4}), (fulltext.between("sinf"), {1, 3, 4}),
    (fulltext.all_of(), set()), (fulltext.phrase("..."), set()), (fulltext.all_of(CAT, fulltext.all_of()), {1, 2, 4}),
]


@pytest.mark.parametrize("condition,wanted", CONDITIONS)
def test_conditions(index, condition, wanted):
    assert {r.doc_id for r in fulltext.search_where(index, condition).collect()} == wanted


@pytest.mark.parametrize("query,wanted", [("cat", {1, 2, 4}), ("cat dog", {2}), ('"the cat"', {1, 4}), ('cat "the dog', set()), ('"cat the"', set()), ("", set()), ("(((", set()), ("cat)", {1, 2, 4})])
def test_typed_words_and_phrases(index, query, wanted):
    assert {r.doc_id for r in fulltext.search_query(index, query).collect()} == wanted


def test_fallback_only_without_exact_hits(index):
    near = fulltext.search(index, "birdz").collect()
    assert [(r.doc_id, r.match_type) for r in near] == [(4, "fuzzy")]
    assert {r.match_type for r in fulltext.search(index, "cat").collect()} == {"exact"}
    assert fulltext.search(index, "zzzzzz").count() == 0
    assert fulltext.search(index, "birdz", fallback=False).count() == 0


def test_index_round_trip(spark, index, tmp_path):
    save_index(index, str(tmp_path))
    assert fulltext.search(load_index(spark, str(tmp_path)), "cat").count() == 3


def test_porter():
    words = "caresses ponies caress cats feed agreed plastered motoring sing conflated hopping falling filing happy sky relational digitizer radically operator feudalism hopefulness triplicate formative electrical allowance adjustable adoption probate rate controll roll"
    stems = "caress poni caress cat feed agre plaster motor sing conflat hop fall file happi sky relat digit radic oper feudal hope triplic form electr allow adjust adopt probat rate control roll"
    assert [porter(w) for w in words.split()] == stems.split()


def test_fusion(spark):
    lists = spark.createDataFrame([(0, "a", 1, 0.9), (0, "b", 2, 0.8), (1, "b", 1, 0.7), (1, "c", 2, 0.6)], "query_no int, id string, rank long, score double")
    found = {r.id: (r.rrf, r.score) for r in vector.reciprocal_rank_fusion(lists).collect()}
    assert found == {"a": (round(1 / 41, 9), 0.9), "b": (round(1 / 42 + 1 / 41, 9), 0.8), "c": (round(1 / 42, 9), 0.6)}
    assert [r.id for r in vector.fused(lists).orderBy("rank").collect()] == ["b", "a", "c"]


def test_aggregation(spark):
    hits = spark.createDataFrame([("d", k, s) for k, s in ((1, 0.9), (2, 0.6), (3, 0.3), (4, 0.1))], "doc_id string, id long, score double")
    scores = {how: vector.aggregate_chunks(hits, how).first().score for how in ("best", "max", "avg_top3", "sum")}
    assert scores == {"best": 0.9, "max": 0.9, "avg_top3": 0.6, "sum": 1.9}
    assert vector.aggregate_chunks(hits, "none").count() == 4
    with pytest.raises(ValueError):
        vector.aggregate_chunks(hits, "median")


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],)], "embedding array<double>")
    assert [r.score for r in vector.similarities(df, [1.0, 0.0]).collect()] == [None, 1.0]


def test_merge_covers_only_with_a_term(spark):
    cols = "id string, doc_id string, text string, score double, ordinal long"
    sem = spark.createDataFrame([("1_0", "1", "a cat", 0.9, 0), ("2_0", "2", "nothing here", 0.8, 1)], cols).withColumn("is_chunk", F.lit(True))
    full = spark.createDataFrame([("1", "1", "a cat", 5.0, 0), ("2", "2", "cats", 4.0, 1)], cols)
    got = hybrid.merge(sem, full, "cat").orderBy(*hybrid.order_of_hybrid()).collect()
    assert [(r.id, r.search_type) for r in got] == [("2", "fulltext"), ("1_0", "semantic"), ("2_0", "semantic")]


def test_shares_and_prevalence(spark):
    points = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, -1), (2, -1)], "doc_id long, cluster_id int")
    labelled = spark.createDataFrame([(1,), (9,)], "cluster_id int")
    scores = themes.doc_theme_scores(points, labelled)
    assert {(r.doc_id, r.cluster_id): r.score for r in scores.collect()} == {(1, 1): round(2 / 3, 6), (1, 9): 0.0}
    assert {r.cluster_id: (r.docs, r.docs_with_any) for r in themes.theme_prevalence(scores, labelled).collect()} == {1: (1, 1), 9: (1, 0)}


def test_answers_and_json(spark):
    df = spark.createDataFrame([("A",), ("b: agree",), (" c",), ("Z",), (None,)], "a string")
    assert [r[0] for r in df.select(themes.answer_score(F.col("a"))).collect()] == [1.0, 0.75, 0.5, 0.0, 0.0]
    replies = spark.createDataFrame([('{"x": 1}',), ('so: {"x": 2} ok',), ("none",), (None,)], "a string")
    assert [r[0] and r[0].x for r in replies.select(themes.json_object(F.col("a"), "x int")).collect()] == [1, 2, None, None]
    numbers = spark.createDataFrame([("7",), ("99",), ("x",), (None,)], "a string")
    assert [r[0] for r in numbers.select(themes.clamped_int(F.col("a"), 3, 80)).collect()] == [7, 80, 3, 3]


def test_review_guards(spark):
    t = spark.createDataFrame([(k, f"n{k}", "p", 10 - k, k) for k in range(4)], "cluster_id int, name string, prompt string, n_points int, ordinal int")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "cluster_id int")
    got = lambda *a: {r.cluster_id for r in themes.review(t, *a).collect()}
    assert got(ids(0), ids(), 2) == {1, 2}
    assert got(ids(0, 1, 2, 3), ids(2), 2) == {2}
    assert got(ids(0), ids(0), 2) == {1, 2}


def test_assembly_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", None, "z", "25–34"), (2, None, None, None, None)], "row int, q1_response string, q2_response string, Q3_Response string, age string")
    docs = {r.id: r for r in corpus.assemble_documents(df, "row", normalize=True).collect()}
    assert docs["1"].text == "q z" and docs["1"].metadata == {"row": "1", "q1_response": "q", "Q3_Response": "z", "age": "18–29"} and docs["2"].text == "" and docs["2"].metadata == {"row": "2"}
    assert {r.column: r.n_nulls for r in corpus.null_profile(df).collect()} == {"row": 0, "q1_response": 1, "q2_response": 2, "Q3_Response": 1, "age": 1}
    folder = str(tmp_path)
    sinks.save_run(spark, folder, "my run/1", {"a": 1}, {"points": spark.createDataFrame([(1, ["a", "b"])], "doc_id int, quote array<string>")})
    assert [r.run for r in sinks.list_runs(spark, folder).collect()] == ["my_run1"] and sinks.load_run(spark, folder, "my run1") == {"a": 1}
    assert sinks.delete_run(spark, folder, "my run1")


def test_engine(spark):
    docs = spark.createDataFrame([(k, f"The cat number {k} sat here. Dogs bark at night in town {k % 3}. Weather was fine today.", "en" if k % 2 else "de") for k in range(30)], "doc_id long, text string, lang string")
    engine = TextEngine(spark, docs)
    found = engine.search("cat", "hybrid", 20, filters={"lang": "en"})
    rows = found.results.collect()
    assert found.status["fulltext"] == found.status["semantic"] == "ok" and rows and all(r.lang == "en" and "The cat" in r.full_text for r in rows)
    hits, histogram = engine.search_api("cat", "fulltext")
    assert all(0 <= r.normalized_score <= 1 and "search-hit" in r.highlight for r in hits.collect()) and sum(r.participants for r in histogram.collect()) == 30
    run = engine.themes(ThemeParams(seed="cat", clusters=3))
    assert run.counts["bullets"] == 30 and run.prevalence.count() == run.themes.count() > 0
    assert [r.value for r in engine.metadata_values("lang").collect()] == ["de", "en"]


def test_no_limit_is_no_cut(spark):
    n = 10_050
    hits = spark.range(n).select(F.col("id"), F.col("id").alias("doc_id"), ((F.col("id") * 7919 % 997) / 997).alias("score"))
    wanted = [r.id for r in sorted(hits.collect(), key=lambda r: (-r.score, r.id))]
    assert fulltext.top(hits, None).count() == n
    assert [r.id for r in vector.top_k(hits, None).orderBy("rank").collect()] == wanted
    assert vector.top_k(hits, None, threshold=0.25).count() == hits.where("score >= 0.25").count()
    lists = vector.ranked_lists(hits.withColumn("query_no", F.lit(0)), None)
    assert [(r.id, r.rank) for r in lists.orderBy("rank").collect()] == [(x, k) for k, x in enumerate(wanted, 1)]
    assert [r.id for r in vector.fused(lists).orderBy("rank").collect()] == wanted


def test_hits_of_other_languages_take_no_place(spark):
    docs = spark.range(10_000, 20_100).select(F.col("id").alias("doc_id"), F.lit("The same old cat.").alias("text"), F.when(F.col("id") < 20_050, "de").otherwise("en").alias("lang"))
    hits, histogram = TextEngine(spark, docs).search_api("cat", "hybrid", 0.1, {"lang": "en"})
    assert {r.doc_id for r in hits.select("doc_id").collect()} == {str(k) for k in range(20_050, 20_100)}
    assert histogram.agg(F.sum("participants")).first()[0] == 50


def test_stream_matches_batch(spark, tmp_path):
    from textloom.operators.segments import GrowingIndex
    from textloom.streaming.ingest import stream_index

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream_index(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(240)
    got = GrowingIndex(spark, f"{tmp_path}/out").index()
    whole = build_index(docs)
    assert {tuple(r) for r in got.postings.select("term", "doc_id", "tf").collect()} == {tuple(r) for r in whole.postings.select("term", "doc_id", "tf").collect()}
    assert {tuple(r) for r in got.term_stats.collect()} == {tuple(r) for r in whole.term_stats.collect()}


def test_requests_keep_postings_of_their_terms_and_no_documents(spark):
    docs = spark.createDataFrame([(k, f"The cat {k} sat there. It saw {k} dogs. The cat left.") for k in range(6)], "doc_id long, text string")
    engine = TextEngine(spark, docs)
    hits, _ = engine.search_api("cat", "hybrid", 0.01)
    texts = {str(r.doc_id): r.text for r in docs.collect()}
    rows = hits.collect()
    assert len(rows) > 6 and all(r.full_text == texts[r.doc_id] for r in rows)
    assert not any("full_text" in k.columns for k in engine._kept)
    postings = [k for k in engine._kept if "tf" in k.columns]
    assert len(postings) == 1 and {r.term for r in postings[0].select("term").distinct().collect()} == {"cat"}
    engine.release()


def test_saving_an_index_tokenises_documents_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(1, "a cat and a dog"), (2, "the cat"), (3, ""), (4, None)], "doc_id long, text string")
    save_index(build_index(docs.withColumn("text", F.udf(counted)("text")), positions=False), f"{tmp_path}/index")
    assert read.value == 4
    saved, plain = load_index(spark, f"{tmp_path}/index"), build_index(docs, positions=False)
    for name in ("postings", "doc_stats", "term_stats"):
        assert sorted(map(tuple, getattr(saved, name).collect())) == sorted(map(tuple, getattr(plain, name).collect()))
