"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bitplane, decontaminate, filter_audit, line_dedup, ngram_join, packing, quality_bayes, quality_rules, resampling, secrets, sharding, url_graph, warc
from textloom.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", *[F.round(f"qb_{c}", 6).alias(f"p_{c}") for c in ("document", "host", "path", "bad")], F.col("qb_kept").alias("kept"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_matches(docs, benchmark)
    n_hit = decontaminate.hit_words(F.col("dc_spans"))
    return found.select(
        "doc_id", F.col("dc_words").alias("n_words"), n_hit.alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("links_found")


def op4_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.filter_urls(table(spark, sf_dir, "pages"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op6_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_exact").alias("n_exact"), F.col("ld_near").alias("n_near"), "text")


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op9_token_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    bitplane.write_token_files(table(spark, sf_dir, "documents"), path)
    return bitplane.token_documents(bitplane.read_token_files(spark, path))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", *[F.col(f"rs_{c}").alias(f"n_{c}" if c == "features" else c) for c in ("features", "weight", "score", "rank")])


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = fresh_path(spark, "shards"), table(spark, sf_dir, "documents")
    sharding.write_shards(docs, path)
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    return sharding.read_shards(spark, path, docs).select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hierarchical_quality, op2_benchmark_decontamination, op3_ngram_jaccard, op4_link_graph_filter, op5_warc_segments, op6_secret_linking, op7_line_dedup, op8_risk_controlled_rules, op9_token_bitplanes, op10_nnls_packing, op11_importance_resampling, op12_filter_interactions, op13_range_shards)}


#: Word pattern of decontamination: anything but ASCII characters other than 0-9 and a-z.
ORACLE_OP2 = r"""
WITH bench AS (
  SELECT item_id, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM bench, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> ''), []) AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM docs, lens, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hits AS (SELECT rid, i, grams.n, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


ORACLE_OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id)
"""


def _oracle_op4() -> str:
    """The walks step by step, up to the step that carries too little."""
    host = lambda url: rf"translate(regexp_extract(CASE WHEN contains({url}, '://') THEN substring({url}, strpos({url}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', {len(r)})" for v, r in url_graph.RULES)
    d = url_graph.DAMPING
    link = url_graph._LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html, coalesce({host('url')}, '') AS host,
    coalesce(regexp_extract(CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule, rhost, rpath, size) AS (VALUES {rules}),
found AS (SELECT page_id, host, path, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
targets AS (SELECT host AS src, {host("CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM p)),
links AS (SELECT src, dst, count(*) AS n FROM targets WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
directed AS (SELECT 'trust' AS walk, src AS a, dst AS b, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
edges AS (SELECT walk, a, b, n / CAST(sum(n) OVER (PARTITION BY walk, a) AS DOUBLE) AS w FROM directed),
shares AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM found WHERE host <> '' GROUP BY host),
x0 AS (SELECT 'trust' AS walk, host, {1 - d} * allowed AS x FROM shares WHERE allowed > 0 UNION ALL SELECT 'distrust', host, {1 - d} * blocked FROM shares WHERE blocked > 0),
steps AS (SELECT 0 AS k, walk, host, x FROM x0
  UNION ALL SELECT k + 1, e.walk, e.b, sum({d} * w * x) FROM steps s JOIN edges e ON e.walk = s.walk AND e.a = s.host WHERE k < {url_graph.steps_at_most()} GROUP BY k, e.walk, e.b),
carried AS (SELECT k, walk, sum(x) AS x FROM steps GROUP BY k, walk),
last AS (SELECT min(k) AS k FROM (SELECT c.k, max(c.x / s.x) AS share FROM carried c JOIN carried s ON s.walk = c.walk AND s.k = 0 GROUP BY c.k) WHERE share <= {url_graph.TOLERANCE}),
mass AS (SELECT host, sum(CASE WHEN walk = 'distrust' THEN x ELSE -x END) / {1 - d} AS m FROM steps WHERE k <= coalesce((SELECT k FROM last), 1000000) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN m > {url_graph.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(m, 6) AS host_mass
FROM found LEFT JOIN mass USING (host)
"""


#: Base32 of a SHA-1: five hexadecimal digits are four characters.
ORACLE_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS sha, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substring(sha, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM s)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[j // 4 + 1] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d
"""


def _oracle_op6() -> str:
    """Spans from the lengths of matches and of what lies between them. RE2 has no look-around: weak parts are
    runs of their characters, filtered afterwards, which is the same."""
    spans = []
    for k, (pattern, group, ok) in enumerate([
        (secrets.ASSIGN, 2, "length(g) >= 6"), (secrets.ACCESS, 0, "length(g) >= 20"), (secrets.HEX, 0, "true"), (r"\b[A-Z][A-Z0-9]{15,}\b", 0, "regexp_matches(g, '[0-9]')"),
        (r"[A-Za-z0-9+/_-]{32,}", 0, "regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Za-z]')"), (secrets.ENDPOINT, 0, "true"),
    ]):
        p = pattern.replace("'", "''")
        total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
        spans.append(f"""SELECT rid, {k} AS k, s, s + length(m) AS e FROM (SELECT rid, CAST({total('parts[1:i]')} + {total('found[1:i - 1]')} AS BIGINT) AS s, found[i] AS m, grp[i] AS g
  FROM (SELECT rid, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {group}) AS grp FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(found) + 1)) AS r(i)) WHERE {ok}""")
    near = lambda kinds: f"EXISTS (SELECT 1 FROM spans p WHERE p.rid = w.rid AND abs(p.s - w.s) <= {secrets.SCOPE} AND p.k IN ({kinds}))"
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(spans)}),
kept AS (SELECT * FROM spans WHERE k < 3 UNION ALL SELECT * FROM spans w WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.rid = w.rid AND b.k < 3 AND b.s < w.e AND b.e > w.s) AND {near('1, 3')} AND {near('0, 2, 4')}),
listed AS (SELECT rid, string_agg({kinds}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, string_agg({kinds}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
  count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2 FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(l.spans, '') AS spans FROM d LEFT JOIN listed l USING (rid)
"""


#: All deletion variants of all long lines, with the place of the deletion.
ORACLE_OP7 = f"""
WITH lines AS (SELECT doc_id, p AS pos, string_split(text, chr(10))[p] AS raw, trim(string_split(text, chr(10))[p], ' ' || chr(9) || chr(13)) AS y FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(p)),
firsts AS (SELECT y, min((doc_id, pos)) AS f FROM lines WHERE y <> '' GROUP BY y),
long AS (SELECT y, f, length(y) AS n FROM firsts WHERE length(y) >= {line_dedup.NEAR_CHARS}),
without AS (SELECT y, f, i, left(y, i - 1) || substring(y, i + 1) AS v FROM long, unnest(range(1, n + 1)) AS r(i)),
later AS (SELECT a.y FROM without a JOIN without b ON a.v = b.v AND a.i = b.i WHERE b.f < a.f
  UNION SELECT a.y FROM without a JOIN long b ON a.v = b.y WHERE b.f < a.f UNION SELECT b.y FROM without a JOIN long b ON a.v = b.y WHERE a.f < b.f),
judged AS (SELECT doc_id, pos, raw, l.y <> '' AND t.y IS NOT NULL AND (doc_id, pos) = f AS near, l.y <> '' AND (doc_id, pos) <> f AS again FROM lines l LEFT JOIN firsts USING (y) LEFT JOIN later t USING (y)),
summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (again) AS n_exact, count(*) FILTER (near) AS n_near, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT coalesce(near OR again, false)) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, CASE WHEN n_exact + n_near > 0 THEN coalesce(kept, '') ELSE text END AS text FROM documents LEFT JOIN summed USING (doc_id)
"""


def _oracle_op8() -> str:
    """Cutoffs by the exact distribution, from logarithms of binomial coefficients."""
    names = quality_rules.RULES
    alpha, delta, scale = quality_rules.MAX_FALSE_REJECTION / len(names), quality_rules.DELTA, quality_rules.SCALE
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE CAST(floor({scale} * {a} / CAST({b} AS DOUBLE)) AS BIGINT) END"
    value = {"symbols": f"least({ratio('n_symbols', 'word_chars')}, {scale})", "duplicate_lines": ratio("n_dup_lines", "n_lines"), "repeated_words": ratio("n_repeat_words", "n_words")}
    value["long_words"] = f"CAST(floor(least(({ratio('word_chars', 'n_words')}) / 100.0, {scale})) AS BIGINT)"
    value["short_words"] = f"-({value['long_words']})"
    values = ", ".join(f"{value[n]} AS {n}" for n in names)
    failed = ", ".join(f"CASE WHEN {n} > cut_{n} THEN '{n}' END" for n in names)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
base AS (SELECT rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {values} FROM base),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0),
holdout AS (UNPIVOT (SELECT rid, stratum, {", ".join(names)} FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)) ON {", ".join(names)} INTO NAME rule VALUE v),
tests AS (SELECT {len(names)} * count(DISTINCT stratum) AS m FROM holdout),
sizes AS (SELECT stratum, rule, count(*) AS n FROM holdout GROUP BY 1, 2),
terms AS (SELECT stratum, rule, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})) AS p FROM sizes, unnest(range(0, CAST(floor(n * {alpha}) AS BIGINT) + 1)) AS r(j)),
sums AS (SELECT stratum, rule, j, sum(p) OVER (PARTITION BY stratum, rule ORDER BY j) AS s FROM terms),
allowed AS (SELECT stratum, rule, coalesce(max(j) FILTER (s <= {delta} / m), -1) AS k FROM sums, tests GROUP BY 1, 2),
above AS (SELECT stratum, rule, v, coalesce(sum(count(*)) OVER (PARTITION BY stratum, rule ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM holdout GROUP BY 1, 2, 3),
cut AS (SELECT stratum, {", ".join(f"min(v) FILTER (rule = '{n}' AND a <= k) AS cut_{n}" for n in names)} FROM above JOIN allowed USING (stratum, rule) GROUP BY stratum),
result AS (SELECT j.*, list_filter([{failed}], lambda x: x IS NOT NULL) AS f FROM judged j LEFT JOIN cut USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(f) = 0 AS kept, array_to_string(f, ',') AS failed_rules FROM result
"""


#: CRC-32 of single octets, from the polynomial.
CRC_TABLE = """SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM (SELECT unnest(range(256)) AS i)"""


def _crc32(octets: str) -> str:
    """CRC-32 of a list of octets, with a column ``crc_table``."""
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"


def _oracle_op11() -> str:
    """Gains from the counts of all words; each different word's CRC-32 is taken once."""
    p = resampling.Resampling()
    lower = lambda t: f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda t: rf"list_filter(string_split(regexp_replace({lower(t)}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
    octets = "list_transform(range(1, strlen(w) + 1), lambda i: CAST('0x' || hex(encode(w))[2 * i - 1:2 * i] AS BIGINT))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT rid, unnest(w) AS w FROM d), y AS (SELECT unnest({words("coalesce(text, '')")}) AS w FROM benchmark),
hashed AS (SELECT w, {_crc32(octets)} % {p.buckets} AS bucket FROM (SELECT w FROM x UNION SELECT w FROM y), ({CRC_TABLE})),
s AS (SELECT bucket, count(*) AS n FROM x JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM y JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS all_s, (SELECT coalesce(sum(n), 0) FROM t) AS all_t),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (all_s + {p.buckets}) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * (all_t + {p.buckets}) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({p.buckets})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
weights AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM x JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substring(sha256('{p.seed}:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (rid)),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {p.min_words}),
drawn AS (SELECT * FROM ranked WHERE rank <= (SELECT {p.percent} * count(*) // 100 FROM ranked))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (rid)
"""


def _oracle_op12() -> str:
    """Every order by itself: a document is removed at the first step that it fails."""
    letters = "['A', 'B', 'C', 'D', 'E']"
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT rid, doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda k: {letters}[k]), '') AS filter_order, step, o[step] AS own FROM orders, unnest(range(1, 6)) AS s(step)),
judged AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fails, coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), false) AS gone, NOT coalesce(list_bool_or(list_transform(list_filter(o, lambda k: k <> own), lambda k: fails[k])), false) AS alone FROM kinds, steps),
counted AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""


def _oracle_op13() -> str:
    """Exact prefix sums in the order of ids: no sample, the same shards."""
    octets = "list_transform(range(1, strlen(t) + 1), lambda i: CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT))"
    n = sharding.SHARDS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
crcs AS (SELECT t, {_crc32(octets)} AS text_crc32 FROM (SELECT DISTINCT t, h FROM d), ({CRC_TABLE})),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM d),
dealt AS (SELECT doc_id, t, size, CAST(least({n - 1}, (2 * before + size) * {n} // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt JOIN crcs USING (t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": ORACLE_OP2, "op3_ngram_jaccard": ORACLE_OP3, "op4_link_graph_filter": _oracle_op4(), "op5_warc_segments": ORACLE_OP5, "op6_secret_linking": _oracle_op6(), "op7_line_dedup": ORACLE_OP7, "op8_risk_controlled_rules": _oracle_op8(), "op11_importance_resampling": _oracle_op11(), "op12_filter_interactions": _oracle_op12(), "op13_range_shards": _oracle_op13()}
