"""The dictionary of terms and the growing index, against indexes without them and rebuilt ones."""

import random

import pytest
from pyspark.sql import functions as F
from test_search_themes import CONDITIONS, DOCS

from textloom.operators import dictionary, fulltext
from textloom.operators.index import build_index, load_index, save_index
from textloom.operators.segments import GrowingIndex

SCHEMA = "doc_id long, text string"


def found(index, condition):
    return sorted(tuple(r) for r in fulltext.search_where(index, condition).select("doc_id", "score", "matched").collect())


def scores(index, query, fuzzy=None):
    hits = fulltext.search_fuzzy(index, query, fuzzy) if fuzzy else fulltext.search_query(index, query)
    return sorted((r.doc_id, r.score, r.matched) for r in hits.collect())


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dictionary"))
    save_index(build_index(spark.createDataFrame(DOCS, SCHEMA)), path, dictionary=True)
    return path


@pytest.mark.parametrize("condition,wanted", CONDITIONS)
def test_conditions_with_a_dictionary(spark, saved, condition, wanted):
    assert {r[0] for r in found(load_index(spark, saved, dictionary=True), condition)} == wanted


def words(rng, n, least=1, most=12):
    return ["".join(rng.choices("abc", k=rng.randint(least, most))) for _ in range(n)]


def test_terms_by_edits_and_masks_equal_a_scan(spark, tmp_path):
    rng = random.Random(5)
    terms = sorted({*words(rng, 3_000), "a", "äöü", "äöüß"})
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    dictionary.save_dictionary(frame, str(tmp_path))
    tables = dictionary.load_dictionary(spark, str(tmp_path))
    for word, distance in [*((w, d) for w in words(rng, 12) for d in (0, 1, 2)), ("äöu", 1), ("", 2)]:
        leaf = fulltext.near(word, distance)
        scan = sorted(r.term for r in frame.where(leaf.terms(frame.term)).collect())
        assert tables.terms(leaf.terms, None, leaf.fuzzy) == scan, (word, distance)
    for mask in ("abc*", "*abca*", "a?bcab*", "*ccc", "äöü?", "abc"):
        leaf = fulltext.like(mask)
        assert tables.terms(leaf.terms, mask) == sorted(r.term for r in frame.where(leaf.terms(frame.term)).collect()), mask


def test_where_the_dictionary_does_not_help(spark, saved, monkeypatch):
    tables = load_index(spark, saved, dictionary=True).dictionary
    for leaf in (fulltext.near("cat", 3), fulltext.like("*a*"), fulltext.between("a", "b")):
        assert tables.terms(leaf.terms, leaf.mask, leaf.fuzzy) is None
    monkeypatch.setattr(dictionary, "MAX_TERMS", 1)
    leaf = fulltext.near("dog", 1)
    assert tables.terms(leaf.terms, None, leaf.fuzzy) is None  # dog and dogs
    assert {r[0] for r in found(load_index(spark, saved, dictionary=True), leaf)} == {2, 3}


def test_dictionary_reads_are_pushed_down(spark, saved):
    tables = load_index(spark, saved, dictionary=True).dictionary
    from textloom.operators.dictionary import _keys_of

    plan = tables.variants.where(tables.variants.key.isin(_keys_of("dogs", 1)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key" in plan


def test_growing_index_equals_a_rebuilt_one(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: " ".join(words(rng, rng.randint(0, 30), 1, 4)) or None
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    now: dict = {}
    grown = GrowingIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        grown.index()
    grown.delete(frame([(1, None)]))  # nothing there yet

    def same():
        got, whole = grown.index(), build_index(frame(list(now.items())))
        assert {tuple(r) for r in got.term_stats.collect()} == {tuple(r) for r in whole.term_stats.collect()}
        assert {tuple(r) for r in got.doc_stats.collect()} == {tuple(r) for r in whole.doc_stats.collect()}
        for query in ("ab", "a b", '"a b"', '"c a b"'):
            assert scores(got, query) == scores(whole, query)
        assert scores(got, "abca", 1) == scores(whole, "abca", 1)
        assert found(got, fulltext.like("*abc")) == found(whole, fulltext.like("*abc"))

    def append(ids, **kw):
        batch = {k: text() for k in ids}
        now.update(batch)
        grown.append(frame([*batch.items(), (None, "ab")]), **kw)

    append(range(60))
    append(range(60, 100), batch=1)
    grown.append(frame([(1, "never")]), batch=1)  # a batch that runs again
    same()
    append([*range(5, 20), 200])  # replaced ones and a new one
    now[21] = ""
    grown.append(frame([(21, "")]))  # replaced by nothing
    same()
    gone = [*range(40, 50), 999]
    for k in gone:
        now.pop(k, None)
    grown.delete(frame([*[(k, None) for k in gone], (None, None)]))
    same()
    append([45])  # back again
    # what a failed writer leaves is not read
    frame([(7, "zz")]).selectExpr("text as term", "doc_id", "1L as tf", "array(0) as positions").write.parquet(str(tmp_path / "index/postings/segment=7"))
    same()
    grown.merge()
    same()
    grown.clean()
    assert [r.n for r in grown._commits()] == [7]
    same()
    append([300], batch=1)  # known before the merge
    now.pop(300)
    append([301], batch=2)
    same()


def test_empty_batches(spark, tmp_path):
    grown = GrowingIndex(spark, str(tmp_path))
    grown.append(spark.createDataFrame([], SCHEMA))
    assert grown.index().postings.count() == 0
    grown.append(spark.createDataFrame([(1, None), (2, "a cat"), (2, "a dog")], SCHEMA))
    assert {tuple(r) for r in grown.index().term_stats.collect()} == {("a", 1), ("cat", 1), ("dog", 1)}


@pytest.mark.parametrize("analyzer", ["plain", "porter"])
def test_postings_are_grouped_where_texts_are_read(spark, analyzer, monkeypatch):
    from textloom.operators import index

    monkeypatch.setattr(index, "GROUPED_DOCS", 2)
    rows = [*DOCS, (50, None), (51, ""), (52, "of the a"), (53, "Cats running, cats ran of cats; ÄÖ äö"), (None, "lost")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = index.document_postings(docs, analyzer=analyzer)
    row = lambda r: (r.term, r.doc_id, r.tf, tuple(r.positions))
    assert sorted(map(row, got.collect())) == sorted(map(row, index.build_postings(index.term_rows(docs, analyzer=analyzer), True).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_variants_are_those_of_all_deletions(spark):
    one = lambda s: {s[:i] + s[i + 1 :] for i in range(max(len(s), 1))}
    terms = ["", "a", "ab", "aab", "äöü", "äöüßxyz", "aaaaaaaaa", "abcdefg", "abcdefgh"]
    for r in spark.createDataFrame([(t,) for t in terms], "term string").select("term", dictionary.variant_keys(F.col("term")).alias("keys")).collect():
        some = one(r.term[:7])
        assert sorted(r.keys) == sorted({r.term[:7], *some, *(y for x in some for y in one(x))})
    plan = spark.range(1).select(dictionary.variant_keys(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # compiled


@pytest.mark.parametrize("analyzer", ["plain", "porter"])
def test_vocabulary_is_counted_without_postings(spark, analyzer):
    from textloom.operators.index import term_rows, vocabulary

    docs = spark.createDataFrame([*DOCS, (50, None), (51, "of the a"), (53, "Cats running, cats ran"), (None, "lost")], SCHEMA)
    plan = vocabulary(docs, analyzer=analyzer)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in plan.split("Exchange")[0] and "Join" not in plan
    assert "Join" not in term_rows(docs, analyzer=analyzer)._jdf.queryExecution().executedPlan().toString()
    for some in (docs, docs.union(spark.createDataFrame([(53, "cats and dogs"), (53, "dogs")], SCHEMA)), docs.limit(0)):
        wanted = {}
        for r in some.where("doc_id is not null").collect():
            for w in fulltext.query_terms(r.text or "", analyzer):
                wanted.setdefault(w, set()).add(r.doc_id)
        assert {tuple(r) for r in vocabulary(some, analyzer=analyzer).collect()} == {(w, len(ids)) for w, ids in wanted.items()}
