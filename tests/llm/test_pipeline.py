"""The pipeline's stages on documents made for them."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    vocabulary = [f"w{k}" for k in range(3000)]
    sentence = lambda n=90: " ".join(rnd.choice(vocabulary) for _ in range(n)) + "."
    item, line = sentence(25), sentence(60)
    docs = [[f"{sentence()}\n{sentence()}"] for _ in range(120)]
    for k in (3, 9):
        docs[k] = [" ".join(w + "$$$" for w in sentence(150).split())]
    for k in (20, 21, 22):
        docs[k] = [f"{line}\n{sentence()}"]
    docs[30] = [docs[29][0].replace(docs[29][0].split()[7], "changed", 1).replace("\n", " ")]
    docs[40] = [f"{sentence(60)} {item} {sentence(60)}"]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, (t,) in enumerate(docs)] + [(200, docs[50][0], "en", "src0", 0), (201, None, "en", None, None)]
    train = [(1000 + k, " ".join(w + "$$$" for w in sentence(80).split()) if k % 2 else sentence(80), "en", "src1", 0) for k in range(60)]
    spark.createDataFrame(rows + train, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + k, int(not k % 2), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item, line


def test_stages(spark, folder):
    path, item, line = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        seen[name] = {r.doc_id: r for r in docs.where(F.col("doc_id") < 1000).collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    quality, lines, near, clean, packed = seen.values()
    assert set(range(120)) - {3, 9} | {200} == set(quality)
    assert line in lines[20].text and line not in lines[21].text and line not in lines[22].text
    assert 200 not in lines and lines[21].n_chars == len(lines[21].text)
    assert set(lines) - set(near) == {30}
    assert item in near[40].text and item not in clean[40].text and set(clean) == set(near)
    assert all(clean[k].text == near[k].text for k in near if k != 40)
    assert set(packed) == set(clean)


def test_run_packs_every_token(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_doc.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_line_stage_drops_documents_without_words_only(spark):
    header = "Licensed under the terms of the header"
    rows = [(1, f"{header}\none\ntwo"), (2, f"{header}\n一二三"), (3, header), (4, f"{header}\n--"), (5, ""), (6, None), (7, "=="), (8, "--")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {1: rows[0][1], 2: "一二三", 5: "", 6: None, 7: "=="}
