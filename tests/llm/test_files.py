"""Token files, packing, WARC and URL filters: exact round trips and small cases."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from textloom.llm import bitplane, packing, url_graph, warc
from textloom.llm.common import fresh_path

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_shard_round_trip(planes):
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000, 4097):
        ids = rnd.integers(0, 2**32, n).astype("<u4")
        blob = bitplane.encode_shard(ids, planes, chunk_ids=1000)
        assert np.array_equal(bitplane.decode_shard(blob), ids)
        for start, stop in ((0, 5), (990, 1010), (n - 1, n + 5), (4, 2)):
            assert np.array_equal(bitplane.decode_shard(blob, max(0, start), stop), ids[max(0, start) : stop])
    with pytest.raises(ValueError):
        bitplane.decode_shard(b"x" * 100)


def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(["the", "Énd,", "x\n\ny", "日本", "don't", "  "]) for _ in range(rnd.randrange(0, 200)))) for k in rnd.sample(range(1000), 60)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = fresh_path(spark, "test")
    bitplane.write_token_files(docs, path, shard_ids=500, chunk_ids=128)
    got, at = {r.doc_id: r for r in bitplane.token_documents(bitplane.read_token_files(spark, path)).collect()}, 0
    for k, text in sorted(rows):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = packing.pack(docs, window=64, block_ids=2000, with_ids=True).collect()
    by_doc = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id] = by_doc.get(r.doc_id, b"") + bytes(r.ids)
    assert by_doc == {k: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for k, t in rows}


def test_plans_fill_windows():
    rnd = np.random.default_rng(2)
    for case in range(30):
        lengths = rnd.integers(1, [50, 64, 300, 3][case % 4] + 1, rnd.integers(1, 400))
        doc, start, length, sequence, offset, n = packing.plan_block(lengths, 64)
        assert np.array_equal(np.bincount(doc, length, len(lengths)).astype(int), lengths) and length.min() > 0
        by = np.lexsort((start, doc))
        ends = (start + length)[by]
        assert all(s == (0 if k == 0 or doc[by][k] != doc[by][k - 1] else ends[k - 1]) for k, s in enumerate(start[by]))
        fill = np.bincount(sequence, length, n)
        assert (fill <= 64).all() and (fill < 64).sum() <= 1
        by = np.lexsort((offset, sequence))
        ends = (offset + length)[by]
        assert all(o == (0 if k == 0 or sequence[by][k] != sequence[by][k - 1] else ends[k - 1]) for k, o in enumerate(offset[by]))


def test_least_squares_is_optimal():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        a, h = rnd.integers(0, 3, (12, 40)).astype(float), rnd.integers(0, 50, 12).astype(float)
        x = packing.solve_nnls(a, h)
        slope = a.T @ (a @ x - h)
        assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope @ x) < 1e-5 and (x > 0).sum() <= 12
    assert len(packing.combinations(64)) == 1 + 32 + sum(1 for a in range(1, 64) for b in range(1, a + 1) if 1 <= 64 - a - b <= b)


def test_the_plan_places_most_rests():
    rnd = np.random.default_rng(6)
    for lengths in (rnd.integers(1, 2048, 4000), np.minimum(2047, rnd.lognormal(6.3, 0.9, 4000).astype(np.int64) + 1), rnd.integers(1, 2048, 250)):
        windows, gaps = packing.plan_rests(lengths, 2048)
        assert (windows >= 0).sum() > 0.6 * len(lengths) and (gaps >= 0).all()


def test_padding_over_many_partitions(spark):
    """Small partitions do not leave a short sequence each, and the pieces are whole."""
    rnd = random.Random(17)
    rows = [(k, " ".join(rnd.choice(["the", "Énd,", "of", "x1", "日本"]) for _ in range(rnd.randrange(0, 900)))) for k in range(1500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(211)).collect()
    by_doc, fill = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == by_doc.get(r.doc_id, 0) and r.length > 0
        by_doc[r.doc_id] = r.start + r.length
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in got) and len(by_doc) == 1500
    assert max(fill.values()) <= 2048 and sum(f < 2048 for f in fill.values()) <= 1
    assert 1 - sum(fill.values()) / (2048 * len(fill)) < 0.01


def test_chunked_framing():
    rnd = random.Random(1)
    for n in (0, 1, 5, 8192, 30_000):
        body = "".join(rnd.choice("aé日🙂\r\n") for _ in range(n)).encode()
        framed = warc.chunked(body, 100)
        framed.decode()
        assert warc.unchunked(framed) == body
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_archive_round_trip(spark):
    big = "x" * 70_000 + "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(3, "http://a/", "same"), (1, "http://b/", "same"), (1, "http://b/", "same"), (2, None, None), (5, "u\nv", ""), (9, "r", big), (4, "é", "日本" * 50_000)]
    path = fresh_path(spark, "test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.error) for r in warc.read_archive(spark, path).collect())
    digest = lambda t: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), None)
    wanted = [(1, "response", None, *digest("same")), (1, "revisit", 1, *digest("same")), (2, "response", None, *digest("")), (3, "revisit", 1, *digest("same")), (4, "response", None, *digest("日本" * 50_000)), (5, "revisit", 2, *digest("")), (9, "response", None, *digest(big))]
    assert got == sorted(wanted, key=repr) or got == wanted


def test_foreign_archives_and_broken_segments():
    parts = list(warc.records(7, "http://x/", b"hello" * 1000, None, False, "urn:x", 400))
    one = b"".join(gzip.compress(p + b"\r\n\r\n") for p in parts)
    found = list(warc.parse(one))
    assert len(found) == len(parts) > 2
    segments = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f, b) for f, b in found]
    random.Random(1).shuffle(segments)
    assert warc.reassemble(segments)["payload"] == b"hello" * 1000
    assert "missing" in warc.reassemble([s for s in segments if s[0] != 2])["error"]
    assert "bytes" in warc.reassemble([(n, t and t + 1, f, b) for n, t, f, b in segments])["error"]
    for cut in (parts[0][:-5], one[:-12], gzip.compress(b"".join(parts))[:-40]):
        with pytest.raises(ValueError):
            list(warc.parse(cut))


def test_archives_are_decompressed_as_a_stream():
    """A file of 200 MB that lies in a few KB: a record is held at a time, not the file."""
    import tracemalloc

    record = next(warc.records(7, "http://x/", b"h" * 1_000_000, None, False, "urn:x", 1 << 30))
    data = gzip.compress((record + b"\r\n\r\n") * 200)
    tracemalloc.start()
    assert sum(1 for _ in warc.parse(data)) == 200
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_rules_and_walks(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [
        (1, "http://GOOD.com/a?b#c", link("//friend.org/x", "/local")), (2, "http://friend.org/x", link("https://other.org/")), (3, "http://other.org", ""),
        (4, "http://bad.net/es/1", ""), (5, "http://bad.net/fr/2", ""), (6, "http://linker.org/1", link("http://bad.net/es/1", "http://BAD.net/x")), (7, "http://half.org/", link("http://bad.net/", "http://good.com/")),
        (8, None, None), (9, "no scheme", None), (10, "https://www.example.com/en/1", ""), (11, "https://a.example.com/en/1", ""), (12, "https://notcom/en", ""), (13, "http://x.com", ""),
    ]
    got = {r.page_id: r for r in url_graph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("good.com", "/a", "com/", "allow")
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "allow", 13: "allow"}
    assert got[13].rule is None and got[10].rule == "www.example.com/en/" and got[11].rule == "example.com/en/" and got[8].host == got[9].path == ""
    assert got[6].host_mass == pytest.approx(0.85 * 2 / 3, abs=1e-6) and got[2].host_mass < 0 and got[3].host_mass < 0


def test_walks_match_a_dense_solve(spark):
    """Random graphs with cycles and a hub: both walks, hubs cut into pieces, and the SQL's steps."""
    import duckdb

    from textloom.llm import queries

    rnd = random.Random(31)
    hosts = [f"h{k}.org" for k in range(25)] + ["good.com", "www.example.com", "bad.net", "worse.net"]
    rows = []
    for page in range(150):
        src = rnd.choice(hosts)
        to = [rnd.choice(hosts) for _ in range(rnd.randrange(0, 5))] + (["h0.org"] if rnd.random() < 0.3 else [])
        rows.append((page, f"http://{src}{rnd.choice(['/a', '/es/x', '/fr/', '/en/y'])}", "".join(f"<a href='https://{h}/z'>t</a>" for h in to)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    links = url_graph.host_links(pages)
    at = {h: i for i, h in enumerate(hosts)}
    n = np.zeros((len(hosts), len(hosts)))
    for r in links.collect():
        n[at[r.src], at[r.dst]] = r.n
    seeds = {h: (rnd.random(), rnd.random()) for h in hosts[10:]}
    frame = spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, allowed double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in url_graph.propagate(frame, links, damping=0.5, tolerance=1e-7, piece=3).collect()}
    for walk, m in enumerate((n, n.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        seed = np.array([seeds.get(h, (0, 0))[walk] for h in hosts])
        x = np.linalg.solve(np.eye(len(hosts)) - 0.5 * share.T, 0.5 * seed)
        assert np.allclose([got.get(h, (0, 0))[walk] for h in hosts], x, atol=1e-6)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    wanted = sorted(con.execute(f"SELECT page_id, verdict, host_mass FROM ({queries._oracle_op4()})").fetchall())
    found = sorted((r.page_id, r.verdict, r.host_mass) for r in url_graph.filter_urls(pages).collect())
    assert [x[:2] for x in found] == [x[:2] for x in wanted] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(found, wanted, strict=True))
    assert len({x[1] for x in found}) == 2


def test_pages_with_edges(spark):
    """Repeated rows, very long html and columns of clashing names for the two operators on pages."""
    long = "<a href='http://bad.net/'>x</a>" * 50_000
    rows = [(1, "http://bad.net/es/", ""), (1, "http://bad.net/es/", ""), (2, "http://long.org/", long), (None, "http://other.org/", None)]
    names = ["id", "host", "path", "found", "n", "sha", "first", "kind", "payload", "url_", "head", "heads", "walk", "x"]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("z").alias(c) for c in names])
    got = sorted(url_graph.filter_urls(pages).collect(), key=lambda r: (r.page_id or 0, r.host))
    assert [(r.page_id, r.verdict) for r in got] == [(None, "allow"), (1, "block"), (1, "block"), (2, "block")]
    path = fresh_path(spark, "test")
    warc.write_archive(pages, path)
    kinds = sorted((r.page_id or 0, r.record_type, r.payload_bytes) for r in warc.read_archive(spark, path).collect())
    assert [k for k in kinds if k[0]] == [(1, "response", 0), (1, "revisit", 0), (2, "response", len(long))] and len(kinds) == 4


def test_scratch_tables_belong_to_a_call(spark):
    """Tables that another thread makes meanwhile stay, and so does what is kept; all else goes, also after an error."""
    import threading

    from textloom.llm.common import materialize, release, scratch

    df, other = spark.range(3), {}
    with scratch(spark) as keep:
        lost = materialize(df, "lost")
        t = threading.Thread(target=lambda: other.update(df=materialize(df, "other")))
        t.start()
        t.join()
        with scratch(spark) as inner:
            kept = inner(materialize(df, "kept"))
        keep(kept)
    assert kept.count() == 3 and other["df"].count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        lost.count()
    with pytest.raises(KeyError), scratch(spark):
        failed = materialize(df, "failed")
        raise KeyError
    with pytest.raises(Exception, match="(?i)exist"):
        failed.count()
    release(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        kept.count()
