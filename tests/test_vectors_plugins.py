"""The approximate vector index, saved engines, and plugins that call a model."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import plugins
from textloom.operators import ann, vector
from textloom.plans.engine import TextEngine, ThemeParams
from textloom.sources import sinks


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.6 * rnd.normal(size=16)]) for k in range(1500)]
    rows += [(1500, [0.0] * 16), (1501, None)] + [(1600 + k, rows[7][1]) for k in range(300)]  # no direction; many equal ones
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5).cache()


def queries_of(vectors):
    return vectors.where("id % 50 = 0 and id < 1500").select(F.col("id").alias("query_no"), F.col("embedding").alias("query_vector"))


def test_index_holds_every_vector_and_finds_most(spark, vectors, tmp_path):
    queries = queries_of(vectors)
    index = ann.build(vectors)
    assert index.vectors.count() == vectors.count() and len(index.centroids) == round(1800**0.5)
    assert index.vectors.where("list = -1 and code is null").count() == 2
    assert ann.recall(index, queries) >= 0.9 and index.scored < 1500
    assert ann.recall(index, queries, probes=len(index.centroids), scored=2000) == 1.0
    path = f"{tmp_path}/vectors"
    made = []
    again = ann.open_or_create(spark, path, lambda: made.append(1) or index)
    again = ann.open_or_create(spark, path, lambda: made.append(1) or index)
    assert len(made) == 1 and again.vectors.count() == vectors.count() and (again.probes, again.scored) == (index.probes, index.scored)
    found = [{(r.query_no, r.id, r["rank"]) for r in ann.search(i, queries, 5).collect()} for i in (index, again)]
    assert found[0] == found[1] and len(found[0]) == 5 * queries.count()
    assert ann.drop(spark, path) and not ann.exists(spark, path)


def test_recall_holds_without_clusters_and_with_two_steps(spark, tmp_path):
    rnd = np.random.default_rng(11)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rnd.normal(size=(3000, 18)))], "id long, embedding array<double>").repartition(4).cache()
    index = ann.create(rows, f"{tmp_path}/plain", lists=100)
    assert len(index.cells) == 10 and 60 <= len(index.centroids) <= 100 and index.words.shape == (5, 256, 4)
    assert ann.recall(index, queries_of(rows)) >= 0.9 and index.scored < 1000
    loaded = ann.load(spark, f"{tmp_path}/plain")
    assert (loaded.probes, loaded.scored) == (index.probes, index.scored) and np.allclose(loaded.words, index.words)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_holds_on_the_given_vectors(spark, folder, tmp_path):
    from pathlib import Path

    if not Path(folder).exists():
        pytest.skip("no given tables")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.create(rows, f"{tmp_path}/given")
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_no"), F.col("embedding").alias("query_vector"))
    assert ann.recall(index, queries) >= 0.9
    assert ann.recall(index, queries, k=25) >= 0.9


def test_exact_search_in_blocks_is_the_exact_search(spark, vectors, monkeypatch):
    queries = queries_of(vectors)
    pairs = vector.ranked_lists(vector.in_blocks(vectors.where("id not in (1500, 1501)"), queries), 12)
    wanted = {(r.query_no, r.id, r.score, r["rank"]) for r in pairs.collect()}
    got = lambda: {(r.query_no, r.id, r.score, r["rank"]) for r in vector.nearest(vectors, queries, 12).collect()}
    assert got() == wanted
    monkeypatch.setattr(vector, "BLOCK", 7)
    assert got() == wanted
    assert vector.nearest(vectors, queries.where("false"), 3).count() == 0


def test_pairs_that_reach_a_threshold_are_found_by_products(spark, vectors, monkeypatch):
    queries = queries_of(vectors)
    wanted = {(r.query_no, r.id, r.score) for r in vector.in_blocks(vectors, queries).where("score >= 0.3").collect()}
    monkeypatch.setattr(vector, "query_similarities", None)  # no rows for pairs that do not reach it
    got = lambda: sorted((r.query_no, r.id, r.score) for r in vector.at_least(vectors, queries, 0.3).collect())
    assert got() == sorted(wanted)
    monkeypatch.setattr(vector, "BLOCK", 7)
    monkeypatch.setattr(vector, "PIECE", 50)
    assert got() == sorted(wanted)


@pytest.mark.parametrize("how", ["avg_top3", "sum", "best"])
def test_aggregates_of_searches_are_made_in_the_tasks(spark, vectors, how, monkeypatch):
    """Null labels, a label whose vectors have no direction, a query without one, and more labels than a task holds."""
    label = F.when(F.col("id").isin(1500, 1501), -1).when(F.col("id") % 7 > 0, F.col("id") % 7 * F.when(F.col("id") < 60, F.col("id") + 1).otherwise(1)).cast("int")
    rows = vectors.withColumn("label", label)
    queries = queries_of(rows).unionByName(rows.where("id = 1500").select(F.col("id").alias("query_no"), F.col("embedding").alias("query_vector")))
    pairs = vector.aggregate_chunks(vector.in_blocks(rows, queries), how, "label", by=("query_no",))
    columns = ["query_no", "label", "score", "matching_chunks"]
    wanted = sorted(map(tuple, pairs.select(columns).collect()), key=repr)
    monkeypatch.setattr(vector, "query_similarities", None)
    got = lambda: sorted(map(tuple, vector.aggregated(rows, queries, how, "label").select(columns).collect()), key=repr)
    assert got() == wanted and any(r[2] is None for r in wanted)
    monkeypatch.setattr(vector, "BLOCK", 7)
    monkeypatch.setattr(vector, "PIECE", 50)
    assert got() == wanted


def test_few_or_no_vectors(spark):
    schema = "id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.0, 1.0])]):
        queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_no long, query_vector array<double>")
        index = ann.build(spark.createDataFrame(rows, schema))
        assert ann.search(index, queries).count() == (rows == [(1, [0.0, 1.0])])


def replies():
    """A function that is sent to workers as it is, not by its module."""

    def model(prompt):
        """Stands in for a language model: some replies fail, some are no JSON."""
        if "fails" in prompt:
            raise RuntimeError("no")
        if "Copy up to" in prompt:
            return 'Sure: {"quotes": ["The cat sat here.", "Dogs bark at night."]} done'
        if "one short sentence" in prompt:
            return '{"bullet": "It tells of cats."}' if "cat" in prompt.rpartition("Passage:")[2] else "nothing"
        if "How well" in prompt:
            n = prompt.rpartition("Passages:")[2].count("\n")
            return json.dumps({"answers": ["A", "b", "C"][:n]})
        if "Name" in prompt:
            return '{"themes": [{"name": "Cats", "prompt": "About cats?"}, {"name": " "}, 7]}'
        return '{"remove": [99], "select": [0, "x"]}'

    return model


def test_model_annotator(spark):
    a = plugins.ModelAnnotator(replies(), timeout_s=5, batch=3)
    df = spark.createDataFrame([(1, "a cat"), (2, "this fails"), (3, None), (4, "dogs")], "id long, text string").coalesce(1)
    got = {r.id: r for r in df.select("id", a.quotes(F.col("text"), "cat", 3).alias("q"), a.bullet(F.col("text"), "cat").alias("b")).collect()}
    assert got[1].q == ["The cat sat here.", "Dogs bark at night."] and got[2].q == got[3].q == []
    assert (got[1].b, got[2].b, got[3].b, got[4].b) == ("It tells of cats.", "this fails", None, "dogs")
    many = spark.createDataFrame([(k, f"text {k}") for k in range(7)], "id long, text string").coalesce(1)
    answers = [r.a for r in many.orderBy("id").select(a.answer(F.col("text"), F.lit("Cats"), F.lit("p")).alias("a")).collect()]
    assert answers == ["A", "b", "C", "A", "b", "C", "A"]
    assert a.theme(4, ["x"], "cat", 3) == [{"name": "Cats", "prompt": "About cats?"}]
    assert a.theme(4, ["fails"], "cat", 3) == [{"name": "Cluster 4", "prompt": ""}]
    assert a.review([{"cluster_id": 0}, {"cluster_id": 1}], 5) == ([], [0])


def test_calls_are_bounded_in_time_and_number():
    def slow(p):
        time.sleep(3 if p == "slow" else 0.05)
        return p

    began = time.time()
    assert plugins.asked(slow, ["a", "slow", None, "b", "c"], 0.4, 2) == ["a", None, None, "b", "c"]
    assert time.time() - began < 2.5


def test_model_expander():
    asks = lambda reply: plugins.ModelExpander(lambda p: reply)
    assert plugins.expansion_phrases("big cat", asks("Phrases: large feline, Big Cat, cat, huge cat"), 3) == (["big cat", "large feline", "huge cat"], "success")
    assert plugins.expansion_phrases("cat", plugins.ModelExpander(lambda p: 1 / 0)) == (["cat"], "fallback")


def test_prefixes_reach_the_embedder(spark):
    e = plugins.Prefixed(plugins.HashEmbedder(16))
    assert np.allclose(e.encode(["cat", ""])[0], plugins.HashEmbedder(16).encode(["query: cat"])[0])
    row = spark.createDataFrame([("cat",)], "t string").select(e.column(F.col("t")).alias("v")).first()
    assert np.allclose(row.v, plugins.HashEmbedder(16).encode(["passage: cat"])[0], atol=1e-6)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"The cat number {k} sat here. Dogs bark at night in town {k % 3}. Weather was fine today.", "en" if k % 2 else "de", f"p{k // 3}", "west" if k < 9 else None) for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, participant_id string, region_of_residence string").cache()


def test_saved_engine(spark, docs, tmp_path):
    first = TextEngine(spark, docs)
    first.save(str(tmp_path))
    opened = TextEngine.open(spark, docs, str(tmp_path))
    approximate = TextEngine.open(spark, docs, str(tmp_path), probes=0)
    for kind in ("fulltext", "semantic"):
        a, b, c = ([(r.id, r.score) for r in e.search("cat", kind, 10).results.orderBy("rank").collect()] for e in (first, opened, approximate))
        assert a == b and len(a) == len(c) == 10 and [s for _, s in c][:5] == [s for _, s in a][:5]
    phrases = TextEngine.open(spark, docs, str(tmp_path), expander=plugins.ModelExpander(lambda p: "so: feline, dogs"))
    found = phrases.search("cat", "semantic", 5)
    assert found.status["query_expansion"] == "success" and found.results.count() == 5


def test_filters_before_the_search(spark, docs):
    engine = TextEngine(spark, docs)
    for kind in ("hybrid", "fulltext", "semantic"):
        rows = engine.search("cat", kind, 12, filters={"lang": "en"}, filter_stage="pre").results.collect()
        assert len(rows) == 12 and all(r.lang == "en" for r in rows)


def test_participants_of_hits(spark, docs):
    hits, histogram = TextEngine(spark, docs).search_api("cat", "fulltext")
    assert hits.count() == 30 and histogram.agg(F.sum("participants")).first()[0] == 10


def test_a_failing_engine_leaves_the_other(spark, docs):
    class Broken(plugins.HashEmbedder):
        def column(self, text):
            return F.raise_error(F.lit("no vectors")).cast("array<float>")

    found = TextEngine(spark, docs, embedder=Broken()).search("cat", "hybrid", 10)
    assert found.status["semantic"].startswith("error") and found.status["fulltext"] == "ok" and found.results.count() == 10
    assert TextEngine(spark, docs).search("cat", "fulltext").status["fulltext"] == "planned"


def test_theme_runs_carry_quotes_metadata_and_chosen_themes(spark, docs, tmp_path):
    engine = TextEngine(spark, docs)
    params = ThemeParams(seed="cat", clusters=3, candidates_per_cluster=2, metadata_filters={"lang": "en"})
    run = engine.theme_exploration(params)
    rows = run.themes.collect()
    assert run.counts["filtered"] == run.counts["with_text"] == 15 and all(r.representative_quotes for r in rows)
    assert {"participant_id", "region_of_residence"} <= set(run.points.columns)
    wanted = [rows[0].theme_id, rows[-1].theme_id, "none"]
    scores, matches = engine.theme_scoring(run.points, run.themes, params, wanted)
    assert {r.concept_id for r in scores.select("concept_id").distinct().collect()} == set(wanted[:2])
    assert scores.count() == 2 * run.points.count() and set(sinks.SCORE_COLUMNS) <= set(scores.columns)
    whole = engine.themes(params)
    sinks.save_run(spark, str(tmp_path), "r", {"n": 1}, {"points": whole.points, "themes": whole.themes, "scores": whole.scores})
    saved = spark.read.csv(f"{tmp_path}/r_points.csv", header=True)
    assert saved.columns == sinks.POINT_COLUMNS and saved.where("participant_id is null or quote is null").count() == 0
    assert spark.read.csv(f"{tmp_path}/r_themes.csv", header=True).where("representative_quotes is null").count() == 0


def test_results_are_kept_for_a_while(spark, tmp_path):
    from textloom.sources.cache import ResultCache

    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    cache = ResultCache(spark, f"file://{tmp_path}/results", ttl_s=60)
    assert cache.get({"q": "a", "n": 1}, make).count() == cache.get({"n": 1, "q": "a"}, make).count() == 1
    assert cache.get({"q": "b"}, make).count() == 2 and cache.expire() == 0
    stale = ResultCache(spark, f"file://{tmp_path}/results", ttl_s=0)
    assert stale.get({"q": "a", "n": 1}, make).count() == 3 and len(calls) == 3
    assert stale.expire() == 3


def test_saved_index_has_its_schema(spark, docs, tmp_path):
    from textloom.operators.index import build_index, load_index, save_index, schemas

    save_index(build_index(docs), str(tmp_path))
    index = load_index(spark, str(tmp_path))
    for name, schema in schemas("bigint").items():
        assert {(f.name, f.dataType) for f in getattr(index, name).schema} == {(f.name, f.dataType) for f in schema}, name


def test_model_embedder_loads_once_in_each_worker(spark, tmp_path):
    import os
    import uuid

    import numpy as np

    from textloom.plugins import ModelEmbedder, Prefixed

    folder = str(tmp_path)

    def load():
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            open(f"{folder}/call-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return np.array([[len(t), t.count("passage: "), t.count("query: ")] for t in texts], float)

        return model

    embedder = ModelEmbedder(load)
    rows = spark.range(1_000).selectExpr("id", "case when id % 10 = 0 then null when id % 10 = 1 then '' else repeat('x', int(id)) end as text").repartition(3)
    got = {r.id: list(r.v) for r in rows.select("id", Prefixed(embedder).column(F.col("text")).alias("v")).collect()}
    assert got == {k: [0, 0, 0] if k % 10 < 2 else [k + 9, 1, 0] for k in range(1_000)}
    names = os.listdir(folder)
    pids = [n.split("-")[1] for n in names if n.startswith("load-")]
    assert len(pids) == len(set(pids)) <= 3
    calls = [int(n.split("-")[1]) for n in names if n.startswith("call-")]
    assert max(calls) <= 32 and sum(calls) == 1_000
    assert Prefixed(embedder).encode(["cat", ""]).tolist() == [[10, 0, 1], [0, 0, 0]]
    assert embedder.encode([]).shape[0] == 0
