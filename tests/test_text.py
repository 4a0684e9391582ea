"""Splitting and term rules against plain Python."""

import random
import re

from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def test_sentences(spark):
    assert len(one(spark, T.sentences, "Hi there. Ça va?  Oui!\nNext one. Énd")) == 5
    assert one(spark, lambda c: T.sentences(c, 10), "Ok. This is long enough.") == ["This is long enough."]
    for empty in (None, "", "  \n"):
        assert one(spark, T.sentences, empty) == []


def plain_windows(s, w, o):
    step = w - min(o, max(0, w - 1))
    if not s:
        return []
    if len(s) < w:
        return [" ".join(s)]
    out, i = [], 0
    while True:
        out.append(" ".join(s[i : i + w]))
        if i + w >= len(s):
            return out
        i += step


def test_windows_match_a_loop(spark):
    cases = [(n, w, o) for n in range(0, 12) for w in range(1, 5) for o in range(0, 4)]
    for w, o in {(w, o) for _, w, o in cases}:
        df = spark.createDataFrame([(n, [f"s{i}" for i in range(n)]) for n in range(12)], "n int, s array<string>")
        for r in df.select("n", T.windows(F.col("s"), w, o).alias("c")).collect():
            assert [c.text for c in r.c] == plain_windows([f"s{i}" for i in range(r.n)], w, o), (r.n, w, o)


def test_chunks_of_two_and_three(spark):
    df = spark.createDataFrame([(n, [f"s{i}" for i in range(n)]) for n in range(40)], "n int, s array<string>")
    sizes = {r.n: [c.sentence_count for c in r.c] for r in df.select("n", T.chunks_2_3(F.col("s"), None).alias("c")).collect()}
    assert [sizes[n] for n in range(1, 8)] == [[1], [2], [3], [2, 2], [3, 2], [3, 3], [3, 2, 2]]
    for n, found in sizes.items():
        assert sum(found) == n and (n == 1 or set(found) <= {2, 3})
    rows = spark.range(1, 40).selectExpr("cast(id as int) n", "explode(sequence(0, cast(id as int) - 1)) i")
    counts = {(r.n, r.k): r["count"] for r in rows.groupBy("n", T.chunk_of(F.col("i"), F.col("n")).alias("k")).count().collect()}
    assert all(counts[n, k] == size for n in range(1, 40) for k, size in enumerate(sizes[n]))


def test_variants(spark):
    wanted = {"pineapples": {"pineapples", "pineapple", "pineappl"}, "berries": {"berries", "berry", "berri", "berrie"}, "dishes": {"dishes", "dish", "dishe"}, "berry": {"berry", "berrys", "berries"}, "bus": {"bus"}}
    for t, v in wanted.items():
        assert set(T.variants(t)) == v
        assert set(one(spark, T.variant_array, t)) == v


def test_query_terms_and_phrases():
    assert T.query_words("The Bread of my Dreams is it") == ["bread", "dreams"]
    assert T.query_words("the bread", stop_words=False) == ["the", "bread"]
    assert T.quoted_phrases('"a b" x " c " ""') == ["a b", "c"]


def test_tokens_like_a_regular_expression(spark):
    rnd = random.Random(5)
    for _ in range(20):
        text = "".join(rnd.choice("aÉß9_ .-'\n日") for _ in range(30))
        assert one(spark, T.tokens, text) == re.findall(r"\w+", text.lower())


def test_phrase_match_has_word_edges(spark):
    hit = lambda text, p: one(spark, lambda c: T.phrase_match(c, [p]), text)
    assert hit("I like Deep Dish.", "deep dish") and not hit("deep dishes", "deep dish") and not hit(None, "x")


def test_batches(spark):
    assert [r[0] for r in spark.range(5).select(T.batch_number(F.col("id"), 2)).collect()] == [0, 0, 1, 1, 2]
    assert {r[0] for r in spark.range(5).select(T.batch_number(F.col("id"), 0)).collect()} == {0}
