"""Resampling, filter audit and shards against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from textloom.llm import filter_audit, resampling, sharding
from textloom.llm.common import fresh_path, join_copies, numbered

WORDS = ["alpha", "Beta", "gamma", "été", "日本", "x1", "the", "of", "#tag", "DELTA"]


def texts(n, seed=3):
    rng = random.Random(seed)
    out = [" ".join(rng.choices(WORDS, k=rng.choice([0, 3, 25, 60, 260]))) for _ in range(n)]
    # a third of all rows are one text
    return [(k, out[0] if k % 3 == 0 else out[k], rng.choice(["a", "b", None, ""])) for k in range(n)] + [(n, None, "a"), (n + 1, "word " * 50_000, "long")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = texts(200)
    # columns that clash with names used inside
    extra = [F.lit("x").alias(c) for c in ("row", "at", "digest", "copies", "w", "score", "place", "id", "part", "A", "shard", "slot", "key", "tie", "size", "rs_rank", "__key", "__common")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).select("*", *extra)


def lower_words(text, n=(1, 1)):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i : i + k]) for k in range(n[0], n[1] + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("params", [resampling.Resampling(), resampling.Resampling((1, 2), 64, 35, 0, 5)])
def test_resampling_is_plain_python_s(spark, corpus, params):
    rows, docs = corpus
    items = [(1, "alpha beta x1 x1"), (2, None), (3, "été 日本 beta")]
    target = spark.createDataFrame(items, "item_id long, text string")
    found = {k: lower_words(t, params.ngrams) for k, t, _ in rows}
    bucket = lambda f: zlib.crc32(f.encode()) % params.buckets
    s, t = Counter(bucket(f) for _, fs in found.values() for f in fs), Counter(bucket(f) for _, x in items for f in lower_words(x, params.ngrams)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + params.buckets) / ((s[b] + 1) * (t.total() + params.buckets)))) for b in range(params.buckets)}
    expected = {}
    for k, (words, features) in found.items():
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{params.seed}:{k}".encode()).hexdigest()[:8], 16)
        expected[k] = [len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
    open_ = sorted((k for k in expected if expected[k][0] >= params.min_words), key=lambda k: (-expected[k][3], k))
    for rank, k in enumerate(open_[: len(open_) * params.percent // 100]):
        expected[k][4] = rank + 1
    got = resampling.resample(docs, target, params)
    assert set(docs.columns) <= set(got.columns)
    assert {r.doc_id: [r.rs_words, r.rs_features, r.rs_weight, r.rs_score, r.rs_rank] for r in got.collect()} == expected


def test_resampling_of_edge_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (1, ""), (2, "a b c"), (2, "a b c")]
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    params = resampling.Resampling(min_words=3, percent=100)
    got = resampling.resample(docs, docs, params).collect()
    assert len(got) == 6 and sorted(r.rs_rank for r in got if r.rs_rank) == [1, 2, 3, 4] and all(r.rs_weight == 0 for r in got)
    assert resampling.resample(none, docs, params).count() == 0
    assert sum(r.rs_rank is not None for r in resampling.resample(docs, none, params).collect()) == 4


def test_copies_are_joined_and_numbered(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    out = join_copies(rows, values, "k")
    assert out.count() == 5000 and out.where("k = 'hot'").agg(F.sum("least")).first()[0] == 0 and out.where("k <> 'hot' and id <> least").count() == 0
    placed = numbered(rows.repartition(7), [F.desc("id")], "test").select("row.id", "place").collect()
    assert all(r.place == 4999 - r.id for r in placed) and len(placed) == 5000


def plain_audit(rows, labels):
    first, good, toxic = {}, {k for k, q, _ in labels if q == 1}, {k for k, _, x in labels if x == 1}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    judged = []
    for k, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and first[t] < k}
        judged.append((part or "", {f for f in fails if fails[f]}, k in good, k in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own, removals = [j for j in judged if j[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [j for j in left if f in j[1]], [j for j in left if f not in j[1]]
                removals[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in j[1] for j in own) - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = removals[out[key][6]]
    return out


def test_audit_counts_what_each_order_removes(spark, corpus):
    rows, docs = corpus
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 200, 3)] + [(1, None, 1), (1, 1, None), (None, 1, 1)]
    got = filter_audit.audit_texts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = plain_audit(rows, labels)
    assert len(got) == len(expected) == 600 * 4
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == expected


def test_audit_of_edge_rows(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (2, "a"), (2, "a"), (1, None), (4, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    verdicts = filter_audit.text_verdicts(docs, labels)
    assert verdicts.where("E").count() == 2  # 3, whose text 2 has, and 4, which is as empty as 1
    assert {r.part for r in filter_audit.audit_texts(docs, labels).select("part").distinct().collect()} == {""}
    assert filter_audit.audit_texts(docs.limit(0), labels).count() == 0
    assert {r.removed for r in filter_audit.audit_texts(docs, labels).where("filter_order = 'EABCD' and step = 1").collect()} == {2}


def test_states_are_shared():
    edges = filter_audit.trie_edges(["A", "B", "C"])
    assert len(edges) == 12 and len({s for s, _ in edges}) == 7


def plain_shards(rows, n):
    """(id, size) in order: the shard of each."""
    total, before, out = sum(s for _, s in rows), 0, {}
    for k, s in rows:
        out[k] = min(n - 1, (2 * before + s) * n // (2 * total))
        before += s
    return out


@pytest.mark.parametrize("exact_rows", [sharding.EXACT_ROWS, 5])
def test_shards_have_equal_bytes(spark, corpus, monkeypatch, exact_rows):
    monkeypatch.setattr(sharding, "EXACT_ROWS", exact_rows)
    rng = random.Random(1)
    rows = [(k, "é" * rng.choice([0, 5, 200, 900])) for k in range(3000)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("shard", F.lit("theirs")), fresh_path(spark, "test")
    sharding.write_shards(docs, path)
    got = sharding.read_shards(spark, path, docs).select("row.doc_id", "row.text", "shard", "slot", "size", F.col("row.shard").alias("theirs")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows) and {r.theirs for r in got} == {"theirs"}
    assert {r.doc_id: r.shard for r in got} == plain_shards([(k, 2 * len(t) + 1) for k, t in rows], 16)
    for n in range(16):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == n)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    sizes = [sum(r.size for r in got if r.shard == n) for n in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 1801


def test_shards_of_edge_rows(spark, corpus):
    rows, docs = corpus
    path = fresh_path(spark, "test")
    sharding.write_shards(docs, path)  # one record has most of the bytes
    got = sharding.read_shards(spark, path, docs).select("row.doc_id", "shard", "slot", "size").collect()
    assert {r.doc_id: r.shard for r in got} == plain_shards(sorted((k, len((t or "").encode()) + 1) for k, t, _ in rows), 16)
    # one key has all rows; null keys and repeated rows
    path, hot = fresh_path(spark, "test"), spark.range(4000).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("text"))
    sharding.write_shards(hot, path, 4, key_col="k")
    sizes = [r.b for r in sharding.read_shards(spark, path, hot).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 10
    path, same = fresh_path(spark, "test"), spark.createDataFrame([(None, "x"), ("k", "x"), ("k", "x"), (None, None)] * 3, "k string, text string")
    sharding.write_shards(same, path, 3, key_col="k")
    got = sharding.read_shards(spark, path, same).select("row.*", "shard", "slot").collect()
    assert len(got) == 12 and len({r.shard for r in got if r.k == "k"}) == 1
    path, none = fresh_path(spark, "test"), docs.limit(0)
    sharding.write_shards(none, path)
    assert sharding.read_shards(spark, path, none).count() == 0
