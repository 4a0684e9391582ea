"""Edge cases that hold for all operators: nulls, empty and long texts, repeated rows, empty tables, clashes."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import bitplane, decontaminate, line_dedup, ngram_join, packing, quality_bayes, quality_rules, secrets, url_graph, warc
from textloom.llm.common import fresh_path

pytest.importorskip("public_tokenizers")
DOCS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "a text without an id that is here"), (4, " \n\t\n "), (5, "word " * 30_000)]
EXTRA = ", ".join(f"{c} string" for c in ("dc_spans", "qb_odds", "ld_lines", "n_words", "node", "key", "line", "h", "t", "id", "doc", "stratum", "__lost", "n", "s", "row", "lost", "near", "bad"))


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    extra = [F.lit("x").alias(c.split()[0]) for c in EXTRA.split(", ")]
    return df.withColumns({"lang": F.when(F.col("doc_id") == 2, None).otherwise("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}).select("*", *extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "beta gamma delta"), (2, None), (None, ""), (3, "no such words at all in any of the texts here")], "item_id long, text string")


def run_all(spark, docs, labels, benchmark):
    path = fresh_path(spark, "test")
    bitplane.write_token_files(docs, path)
    return {
        "classify": quality_bayes.classify(docs, labels), "matches": decontaminate.find_matches(docs, benchmark), "clean": decontaminate.decontaminate(docs, benchmark), "near": ngram_join.near_duplicates(docs),
        "secrets": secrets.digest(secrets.find_secrets(docs)), "lines": line_dedup.dedup_lines(docs), "rules": quality_rules.apply_rules(docs, labels), "tokens": bitplane.token_documents(bitplane.read_token_files(spark, path)), "pack": packing.pack(docs),
    }


def test_edge_rows(spark, docs, labels, benchmark):
    found = {k: df.collect() for k, df in run_all(spark, docs, labels, benchmark).items()}
    for name in ("classify", "matches", "near", "secrets", "lines", "rules", "tokens"):
        assert len(found[name]) == len(DOCS), name
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in found["near"]}
    assert near == {1: (2, 1), 2: (0, 2), 3: (0, 3), None: (4, None), 4: (0, 4), 5: (1, 5)}
    assert {r.doc_id: r.qb_kept for r in found["classify"] if r.doc_id in (2, 3, 4)} == {2: False, 3: False, 4: False}
    assert all(set(docs.columns) <= set(r.asDict()) for r in found["classify"] + found["lines"] + found["matches"])
    hit = {r.doc_id: r.dc_items for r in found["matches"]}
    assert hit[1] == ["1"] and hit[2] == hit[3] == []
    assert sorted(r.text for r in found["clean"] if r.doc_id == 1) == ["alpha  epsilon zeta"] * 2
    tokens = {r.doc_id: r.n_tokens for r in found["tokens"]}
    assert tokens[2] == tokens[3] == 1 and sum(r.length for r in found["pack"]) == sum(r.n_tokens for r in found["tokens"])
    assert [r.start for r in found["tokens"]][0] == 0


def test_empty_tables(spark, docs, labels, benchmark):
    none = docs.limit(0)
    for name, df in run_all(spark, none, labels.limit(0), benchmark.limit(0)).items():
        assert df.count() == 0, name
    assert quality_bayes.classify(docs, labels.limit(0)).where("qb_kept").count() == 4
    assert quality_rules.apply_rules(docs, labels.limit(0)).count() == len(DOCS)
    assert decontaminate.find_matches(docs, benchmark.limit(0)).where("size(dc_spans) > 0").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_graph.filter_urls(pages).count() == 0
    path = fresh_path(spark, "test")
    warc.write_archive(pages, path)
    assert warc.read_archive(spark, path).count() == 0


def test_release_deletes_what_was_made(spark):
    from pathlib import Path

    from textloom.llm import common

    common.release(spark)
    common.materialize(spark.range(3), "test").count()
    (path,) = (Path(p.removeprefix("file:").replace("//", "/")) for p in common._made)
    assert path.exists()
    common.release(spark)
    assert not path.exists() and not common._made


def test_scratch_deletes_all_but_what_is_kept(spark):
    from textloom.llm import common

    common.release(spark)
    before = common.materialize(spark.range(1), "before")
    with common.scratch(spark) as keep:
        common.materialize(spark.range(2), "step")
        kept = keep(common.materialize(spark.range(3), "result"))
        common.materialize(spark.range(4), "step")
    assert kept.count() == 3 and before.count() == 1 and len(common._made) == 2
    common.release(spark)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from textloom.llm import common

    conf = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
    assert common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/y/"))) == "hdfs://x/y"
