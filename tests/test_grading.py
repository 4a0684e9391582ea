"""Replies to grading prompts, summaries, one bound for all calls, and what the engine makes of them."""

import json
import time

import pytest
from pyspark.sql import functions as F

from textloom import plugins
from textloom.operators import grading, themes
from textloom.plans.engine import TextEngine, ThemeParams


def model_of(folder=None):
    """A function that is sent to workers as it is. It writes when each call begins and ends, if given a folder."""

    def model(prompt):
        import json
        import os
        import re
        import time
        import uuid

        name = f"{folder}/{uuid.uuid4().hex}"
        if folder:
            with open(f"{name}-{time.time():.4f}", "w"):
                time.sleep(0.05)
        try:
            if "How well" in prompt:
                examples = json.loads(prompt.partition("Examples: ")[2])
                if any("fails" in e["example"] for e in examples):
                    raise RuntimeError("no")
                results = [{"example_id": e["example_id"], "answer": "b: mostly", "rationale": " as it says ", "quote": e["example"][:3]} for e in reversed(examples) if "silent" not in e["example"]]
                return "Sure! " + json.dumps({"results": [*results, {"example_id": "other", "answer": "A"}, 7]})
            if "Sum up" in prompt:
                return json.dumps({"summary": f" {prompt.count(chr(10) + '- ')} in {re.search('in (.*?)s what', prompt)[1]} "})
            if "Name" in prompt:
                return json.dumps({"themes": [{"name": "Cats", "prompt": "About cats?", "example_ids": ["4", "nowhere", "2"]}]})
            if "Copy up to" in prompt:
                return json.dumps({"quotes": [prompt.rpartition("Answer:")[2].strip()]})
            return "{}"
        finally:
            if folder:
                with open(f"{name}-end-{time.time():.4f}", "w"):
                    pass

    return model


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"b{k}", "it fails here" if k == 20 else "silent" if k % 7 == 3 else f"text {k}") for k in range(40)]
    return spark.createDataFrame(rows, "bullet_id string, text string").repartition(3)


def test_replies_are_matched_by_id(spark, points):
    concepts = spark.createDataFrame([("1", "Cats", "About cats?"), ("2", "", None)], "concept_id string, name string, prompt string")
    model = model_of()
    quiet = lambda p: plugins.asked(model, [p], 5, 1)[0]
    answers = grading.graded_replies(points, concepts, quiet, batch=4).collect()
    lost = {r.bullet_id for r in points.collect()} - {r.bullet_id for r in answers}
    silent = {f"b{k}" for k in range(40) if k % 7 == 3}
    assert silent <= lost and "b20" in lost and len(lost - silent) <= 4  # a failed call is one batch
    assert all((r.answer, r.rationale, r.quote) == ("b: mostly", "as it says", "tex") for r in answers)
    out = themes.graded(points.withColumn("doc_id", F.lit(1)), concepts.withColumnRenamed("concept_id", "cluster_id"), spark.createDataFrame(answers, grading.ANSWERS.format("string", "string"))).collect()
    assert len(out) == 80 and all((r.score, r.highlight) == ((0.0, "") if r.bullet_id in lost else (0.75, "tex")) for r in out)
    assert grading.graded_replies(points.limit(0), concepts, quiet).count() == 0
    for bad in (None, "no", "[1]", '{"results": 3}', '{"results": [{"example_id": null}]}'):
        assert grading.graded_replies(points.limit(3), concepts, lambda p, bad=bad: bad).count() == 0


def overlapping(folder):
    at = sorted((float(p.name.rpartition("-")[2]), -1 if "-end-" in p.name else 1) for p in folder.iterdir())
    running, most = 0, 0
    for _, d in at:
        running += d
        most = max(most, running)
    return len(at) // 2, most


def test_calls_are_bounded_for_all_tasks_together(spark, points, tmp_path):
    concepts = spark.createDataFrame([(str(k), "Cats", "p") for k in range(3)], "concept_id string, name string, prompt string")
    a = plugins.ModelAnnotator(model_of(str(tmp_path)), concurrency=2, batch=2)
    assert a.grade(points.where("text not like '%fails%'").repartition(9), concepts).count() > 60
    calls, most = overlapping(tmp_path)
    assert calls >= 60 and most <= 2


def test_failed_calls_are_made_again():
    tried = []

    def once(p):
        tried.append(p)
        if tried.count(p) < 2:
            raise RuntimeError("no")
        return p

    assert plugins.asked(once, ["a", None, "b"], 5, 2, retries=1) == ["a", None, "b"] and len(tried) == 4


def test_model_run_has_replies_summaries_and_example_documents(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"The cat number {k} sat here on its own red mat. Dogs bark at night in the old town.") for k in range(12)], "doc_id long, text string")
    engine = TextEngine(spark, docs, annotator=plugins.ModelAnnotator(model_of(), batch=4))
    run = engine.themes(ThemeParams(seed="cat", clusters=2, summary_length="5-9 word"))
    kept = run.themes.collect()
    assert kept and all(r.name == "Cats" for r in kept)
    for r in kept:
        own = {str(p.doc_id): p.bullet for p in run.points.where(F.col("cluster_id") == r.cluster_id).collect()}
        if {"4", "2"} <= set(own):
            assert r.example_doc_ids == ["4", "2"] and r.representative_bullets == [own["4"], own["2"]]
    scores = run.scores.collect()
    assert scores and {(r.score, r.rationale) for r in scores} == {(0.75, "as it says")} and all(r.highlight == r.text[:3] for r in scores)
    assert {r.summary for r in run.summaries.collect()} == {"8 in 5-9 word"}
    engine.release()


def test_offline_grades_leave_no_highlight_without_a_match(spark):
    docs = spark.createDataFrame([(k, f"The cat number {k} sat here. Weather was fine today.") for k in range(20)] + [(k, "Dogs bark at night in town. Rain fell on the hills.") for k in range(20, 40)], "doc_id long, text string")
    engine = TextEngine(spark, docs)
    run = engine.themes(ThemeParams(seed="cat dogs", clusters=2))
    rows = run.scores.collect()
    assert rows and all((r.highlight != "") == (r.rationale != "") == (r.score > 0) for r in rows) and {r.score > 0 for r in rows} == {True, False}
    assert all(r.summary and r.matches.startswith(f"- {r.summary}") for r in run.summaries.collect())


def test_response_of_any_matching_sentence(spark):
    rows = [(1, "Nothing here. Nor there.", "A cat sat. The dog ran. One more cat came."), (2, "The cat sat.", None), (3, None, "No cats, a cat.")]
    docs = spark.createDataFrame(rows, "doc_id long, q1_response string, q2_response string").withColumn("text", F.concat_ws(" ", "q1_response", "q2_response"))
    hits, _ = TextEngine(spark, docs).search_api("cat", "fulltext")
    assert {r.doc_id: r.response for r in hits.collect()} == {"1": 2, "2": 1, "3": 2}


def test_theme_run_by_density(spark):
    topics = ["The cat sat on the red mat near the warm stove", "Dogs bark at night in the old town beyond the hill", "Rain fell on the green fields all week and then stopped"]
    docs = spark.createDataFrame([(k, f"{topics[k % 3]} {'again ' * (k % 4)}number{k}.") for k in range(120)], "doc_id long, text string")
    engine = TextEngine(spark, docs)
    run = engine.themes(ThemeParams(seed="cat dogs rain", cluster_method="density"))
    points = run.points.select("doc_id", "cluster_id", "x", "y").collect()
    assert len(points) == 120 and len({(p.x, p.y) for p in points}) > 60
    for k in range(3):  # a topic's points are of one cluster, or noise
        own = [p.cluster_id for p in points if p.doc_id % 3 == k and p.cluster_id != -1]
        assert len(own) >= 20
    mixed = {}
    for p in points:
        if p.cluster_id != -1:
            mixed.setdefault(p.cluster_id, set()).add(p.doc_id % 3)
    assert len(mixed) >= 3 and all(len(t) == 1 for t in mixed.values())
    assert run.themes.count() > 0 and run.prevalence.count() == run.themes.count()
    engine.release()
