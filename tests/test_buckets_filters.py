"""Bucket tables, filter algebra and presentation rules."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import buckets as B
from textloom.functions import filters as M
from textloom.functions import present as P


def test_age(spark):
    wanted = {"17": "17", "18": "18–29", "29": "18–29", "30": "30–44", "44": "30–44", "45": "45–59", "59": "45–59", "60": "60+", "25-34": "25-34", "25–34": "18–29", "30 - 44": "30–44", "unknown": "unknown", "": "", "60+": "60+"}
    df = spark.createDataFrame([(k,) for k in wanted] + [(None,)], "v string").select("v", B.age_bucket(F.col("v")).alias("b"))
    assert {r.v: r.b for r in df.collect()} == wanted | {None: None}


def test_income(spark):
    wanted = {"$89k": "$25k–$49k", "25k": "Under $25k", "$100k+": "$75k+", "$25,000 - $49,999": "$25k–$49k", "25000-49999": "Under $25k", "25-49": "Under $25k", "under $25k": "Under $25k", "$75k+": "$75k+", "none": "none", "60000": "$50k–$74k"}
    df = spark.createDataFrame([(k,) for k in wanted], "v string").select("v", B.income_bucket(F.col("v")).alias("b"))
    assert {r.v: r.b for r in df.collect()} == wanted


ROWS = [("a", "5"), ("B", "x"), (None, None)]
CASES = [
    ({"operator": "equals", "value": "A"}, [True, False, False], [True, False, False]),
    ({"operator": "not_equals", "value": "A"}, [False, True, True], [False, True, True]),
    ({"operator": "contains", "value": "b"}, [False, True, False], [False, True, False]),
    ({"operator": "in", "value": ["A", "c"]}, [True, False, False], [True, False, False]),
    ({"operator": "includes", "value": "a"}, [True, False, True], [True, False, False]),
    ({"operator": "not_includes", "value": ["a"]}, [False, True, True], [False, True, True]),
    ({"operator": "odd", "value": 1}, [True, True, True], [False, False, True]),
    ("a", [True, False, False], [True, False, False]),
    ("", [True] * 3, [True] * 3),
    ({"operator": "equals", "value": []}, [True] * 3, [True] * 3),
]


@pytest.mark.parametrize("spec,hits,strict", CASES)
def test_filter_on_text(spark, spec, hits, strict):
    df = spark.createDataFrame(ROWS, "f string, n string")
    for mode, wanted in (("hits", hits), ("strict", strict)):
        kept = [(r.f, r.n) for r in M.apply_filters(df, {"f": spec}, mode).collect()]
        assert kept == [r for r, w in zip(ROWS, wanted, strict=True) if w], mode


@pytest.mark.parametrize("spec,hits,strict", [
    ({"operator": "greater_than", "value": "4"}, [True, False, False], [True, False, False]),
    ({"operator": "less_than", "value": 4}, [False, False, False], [False, False, False]),
    ({"operator": "between", "value": [1, 5]}, [True, False, True], [True, False, True]),
    ({"operator": "between", "value": ["1", "5"]}, [False, False, True], [True, False, True]),
])
def test_filter_on_numbers(spark, spec, hits, strict):
    df = spark.createDataFrame(ROWS, "f string, n string")
    for mode, wanted in (("hits", hits), ("strict", strict)):
        kept = [(r.f, r.n) for r in M.apply_filters(df, {"n": spec}, mode).collect()]
        assert kept == [r for r, w in zip(ROWS, wanted, strict=True) if w], mode


def test_field_names(spark):
    df = spark.createDataFrame([("a",)], "Lang string")
    assert M.apply_filters(df, {"lang": "a"}, "strict").count() == 1
    assert M.apply_filters(df, {"lang": "a"}, "hits").count() == 0
    meta = df.select(F.create_map(F.lit("Lang"), F.col("Lang")).alias("m"))
    assert M.apply_filters(meta, {"lang": "a"}, "strict", "m").count() == 1
    assert M.apply_filters(meta, {"lang": "a"}, "hits", "m").count() == 0


def test_highlight_is_escaped_once(spark):
    df = spark.createDataFrame([("Berries & berry's <b>",)], "t string")
    assert df.select(P.highlighted(F.col("t"), ["berry"])).first()[0] == '<mark class="search-hit">Berries</mark> &amp; <mark class="search-hit">berry</mark>&#x27;s &lt;b&gt;'


def test_metadata_prefix(spark):
    wanted = {"12 34 $89k story": True, "12 34 story": False, "x 12 34 Weekly": False, "12 34 Western": False, "12 34 in West now": True, "": False}
    df = spark.createDataFrame([(k,) for k in wanted], "t string").select("t", P.has_metadata_prefix(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == wanted


def test_histogram(spark):
    hits = spark.createDataFrame([("a", 0.0), ("b", 0.0334), ("c", 0.999), ("d", 1.0), ("d", 0.2), (None, 0.5)], "k string, normalized_score double")
    found = {r.bin: r.participants for r in P.prevalence_histogram(hits, F.col("k")).collect()}
    assert len(found) == 30 and {k: n for k, n in found.items() if n} == {0: 1, 1: 1, 29: 2}


def test_threshold_holds_for_fulltext(spark):
    hits = spark.createDataFrame([("fulltext", 10.0), ("fulltext", 2.0), ("semantic", 0.4), ("semantic", 0.1)], "search_type string, score double")
    assert {r.score for r in P.score_threshold(hits, 0.3).collect()} == {10.0, 0.4}
    assert P.score_threshold(hits, 0).count() == 4
