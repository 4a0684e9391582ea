"""Registered queries cover whole texts and tables."""

from pyspark.sql import functions as F

from textloom.operators import hybrid
from textloom.plans import catalogue


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ascii_safe_reads_past_200_characters(spark, tmp_path):
    path = tables(spark, tmp_path, documents=([(1, "x" * 250 + "“a”…")], "doc_id long, text string"))
    assert catalogue.queries()["ascii_safe"](spark, path).first().safe == '"' + "x" * 250 + '"a"..."--\''


def test_vector_searches_take_every_query_and_every_row(spark, tmp_path):
    rows = [(k, [1.0, k / 1000], k % 3) for k in range(160)]
    path = tables(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    found = {name: catalogue.queries()[name](spark, path) for name in ("cosine_threshold", "cosine_topk", "agg_best", "agg_avg_top3", "agg_sum")}
    counts = {name: {r.query_no: r["count"] for r in df.groupBy("query_no").count().collect()} for name, df in found.items()}
    each = lambda n: {0: n, 50: n, 100: n, 150: n}
    assert counts == {"cosine_threshold": each(160), "cosine_topk": each(10), "agg_best": each(3), "agg_avg_top3": each(3), "agg_sum": each(3)}
    assert sorted(r["rank"] for r in found["cosine_threshold"].where("query_no = 50").collect()) == list(range(1, 161))
    # the lists of 150 and 100 have rows that those of 0 to 2 do not
    assert {50, 100, 150} <= {r.id for r in catalogue.queries()["rrf_fusion"](spark, path).collect()}


def test_every_chunk_gets_its_full_text(spark, tmp_path):
    texts = {1: "One sentence only here.", 2: "A first sentence. A second sentence. A third sentence.", 3: "?"}
    path = tables(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))
    got = {r.id: r.n_chars for r in catalogue.queries()["full_text_enrich"](spark, path).collect()}
    assert got == {f"{d}_chunk_{k}": len(texts[d]) for d, n in ((1, 1), (2, 3), (3, 1)) for k in range(n)}


def test_full_texts_are_joined_after_the_last_shuffle_of_hits(spark):
    docs = spark.createDataFrame([("1", "a b", "x"), ("2", None, "y"), ("3", "c", "y"), ("0", "d", "z")], "doc_id string, text string, participant string")
    hits = spark.createDataFrame([("h1", "1", "z"), ("h2", "2", "z"), ("h3", "?", "y"), ("3", None, "x"), ("h5", "?", None), ("h6", "1", "q")], "id string, doc_id string, participant string")
    found = hybrid.with_full_text(hits, docs, ["participant"])
    # a document without a text counts as none; that of the smallest id speaks for a participant
    assert {r.id: r.full_text for r in found.collect()} == {"h1": "a b", "h2": "d", "h3": None, "3": "c", "h5": None, "h6": "a b"}
    joins, node = [], found._jdf.queryExecution().optimizedPlan()
    while node.children().size():
        if node.nodeName() == "Join":
            joins.append("full_text" in node.left().output().toString())
        node = node.children().apply(0)
    assert len(joins) == 3 and not any(joins)


def test_chunks_and_bullets_cover_long_documents(spark, tmp_path):
    text = " ".join(f"This is sentence {k}." for k in range(201))
    path = tables(spark, tmp_path, documents=([(1, text)], "doc_id long, text string"))
    rows = catalogue.queries()["chunks_2_3"](spark, path).orderBy("chunk_no").collect()
    assert len(rows) == 67 and " ".join(r.text for r in rows) == text
    assert catalogue.queries()["bullet_rows"](spark, path).agg(F.sum("sentence_count")).first()[0] == 201
