"""DuckDB SQL that gives the same rows as the catalogue's queries."""

from __future__ import annotations

from textloom.functions.buckets import AGE_LABELS, INCOME_LABELS
from textloom.functions.text import STOP_WORDS
from textloom.sources.sinks import POINT_COLUMNS


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def _sentences(x: str, least: int = 1) -> str:
    # RE2 has no lookbehind: a separator is put after each end of a sentence first
    return rf"list_filter(list_transform(string_split(regexp_replace({_strip(x)}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: {_strip('s')}), lambda s: length(s) >= {least})"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _variants(t: str) -> str:
    return f"""list_filter([{t}, CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' END,
      CASE WHEN length({t}) > 4 AND {t} LIKE '%es' THEN left({t}, length({t}) - 2) END, CASE WHEN length({t}) > 3 AND {t} LIKE '%s' THEN left({t}, length({t}) - 1) END,
      CASE WHEN length({t}) > 2 AND {t} NOT LIKE '%s' THEN {t} || 's' END, CASE WHEN length({t}) > 2 AND {t} LIKE '%y' THEN left({t}, length({t}) - 1) || 'ies' END], lambda v: v IS NOT NULL AND length(v) >= 3)"""


LABELLED = "labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
ANSWERS = """numbered AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id, max(CASE WHEN k = 1 THEN text END) AS q1, max(CASE WHEN k = 2 THEN text END) AS q2, max(CASE WHEN k = 3 THEN text END) AS q3,
  max(CASE WHEN k = 4 THEN text END) AS q4, max(CASE WHEN k = 5 THEN text END) AS q5 FROM numbered WHERE k <= 5 GROUP BY conv_id)"""
INDEX = f"""postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term, doc_id),
lengths AS (SELECT doc_id, sum(tf) AS dl FROM postings GROUP BY doc_id), terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
bm25 AS (SELECT doc_id, term, (ln(n / CAST(df + 1 AS DOUBLE)) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id), size)"""
POINTS = """points AS (SELECT vec_id % 97 AS doc_id, vec_id AS bullet_id, CAST(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS INTEGER) AS cluster_id,
  CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 'bullet ' || vec_id AS bullet FROM embeddings)"""
THEMES = "themes AS (SELECT CAST(k AS INTEGER) AS cluster_id, 'theme ' || (k % 4) AS name, [k, k + 10] AS example_doc_ids FROM range(6) AS r(k))"
SCORES = f"""{POINTS}, {THEMES}, counts AS (SELECT doc_id, cluster_id, count(*) AS n FROM points WHERE cluster_id <> -1 GROUP BY ALL),
totals AS (SELECT doc_id, sum(n) AS t FROM counts GROUP BY doc_id),
scores AS (SELECT doc_id, cluster_id, round(coalesce(n, 0) / CAST(t AS DOUBLE), 6) AS score, CAST(coalesce(n, 0) AS BIGINT) AS n_bullets_in_theme, CAST(t AS BIGINT) AS n_bullets_total
  FROM totals CROSS JOIN themes LEFT JOIN counts USING (doc_id, cluster_id))"""
ANSWERED = f"""{POINTS}, {THEMES}, graded AS (SELECT p.doc_id, p.bullet_id, t.cluster_id AS concept_id, p.bullet_id % 5 <> 0 AND p.cluster_id = t.cluster_id AS known,
  CASE WHEN p.bullet_id % 5 <> 0 AND p.cluster_id = t.cluster_id THEN [1.0, 0.75, 0.5, 0.25, 0.0, 0.0][p.bullet_id % 6 + 1] ELSE 0.0 END AS score FROM points p CROSS JOIN themes t)"""

#: Points graded by the number in their id: not at all where 5 divides it, with a quote for the four best answers.
REPLIES = f"""{POINTS}, {THEMES}, graded AS (SELECT doc_id, bullet_id, concept_id, CAST(CASE WHEN known THEN [1.0, 0.75, 0.5, 0.25, 0.0, 0.0][k + 1] ELSE 0.0 END AS DOUBLE) AS score,
  CASE WHEN known THEN 'bullet ' || bullet_id || ' of ' || name ELSE '' END AS rationale, CASE WHEN known AND k < 4 THEN bullet ELSE '' END AS highlight
  FROM (SELECT p.*, t.cluster_id AS concept_id, name, p.bullet_id % 5 <> 0 AS known, (p.bullet_id + t.cluster_id % 4) % 6 AS k FROM points p CROSS JOIN themes t))"""


def _windows(size: int, overlap: int) -> str:
    step = size - min(overlap, max(0, size - 1))
    return f"""parts AS (SELECT doc_id, {_sentences('text', 10)} AS s FROM documents),
windows AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, s, len(s) AS n, i * {step} AS a, least(i * {step} + {size}, len(s)) AS e
  FROM parts, unnest(range(0, CASE WHEN len(s) = 0 THEN 0 WHEN len(s) < {size} THEN 1 ELSE CAST(ceil((len(s) - {size}) / {float(step)}) AS BIGINT) + 1 END)) AS r(i))"""


def _chunks(size: int, overlap: int) -> str:
    return f"WITH {_windows(size, overlap)} SELECT doc_id, chunk_index, array_to_string(s[a + 1:e], ' ') AS text, CAST(a AS INTEGER) AS start_sentence_idx, CAST(e - 1 AS INTEGER) AS end_sentence_idx, CAST(e - a AS INTEGER) AS sentence_count FROM windows"


def _pieces(text: str, source: str) -> str:
    """Chunks of two and three sentences; text is an expression over source."""
    spaced = rf"regexp_replace({text}, '\s+', ' ', 'g')"
    return f"""parts AS (SELECT doc_id, {_sentences(spaced)} AS s FROM {source}),
numbered AS (SELECT doc_id, i, s[i + 1] AS t, CASE WHEN len(s) % 3 = 1 AND len(s) >= 4 AND i >= len(s) - 4 THEN (len(s) - 4) // 3 + (i - (len(s) - 4)) // 2 ELSE i // 3 END AS k FROM parts, unnest(range(0, len(s))) AS r(i)),
pieces AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, string_agg(t, ' ' ORDER BY i) AS text, CAST(min(i) AS INTEGER) AS start_sentence_idx, CAST(max(i) AS INTEGER) AS end_sentence_idx, CAST(count(*) AS INTEGER) AS sentence_count FROM numbered GROUP BY doc_id, k)"""


def _found(where: str, having: str = "") -> str:
    return f"WITH {INDEX} SELECT doc_id, round(sum(s), 6) AS score, count(*) AS matched FROM bm25 WHERE {where} GROUP BY doc_id {having}"


def _top(where: str, having: str = "") -> str:
    return f"SELECT * FROM ({_found(where, having)}) ORDER BY score DESC, doc_id LIMIT 50"


def _highlight(words: list[str]) -> str:
    """Escaped snippets, taken apart into words and what lies between them."""
    escaped = "snippet"
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        escaped = f"replace({escaped}, '{char}', '{entity}')"
    variants = _list([v for w in words for v in (w, w + "s")])
    parts = rf"regexp_extract_all({escaped}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    mark = f"CASE WHEN list_contains({variants}, lower(x)) THEN '<mark class=\"search-hit\">' || x || '</mark>' ELSE x END"
    return f"SELECT doc_id, array_to_string(list_transform({parts}, lambda x: {mark}), '') AS html FROM ({_snippet(words)})"


#: Every vector with its score for each query vector: those whose id 50 divides.
SEARCHES = """scored AS (SELECT q.vec_id AS query_no, e.vec_id AS id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q)"""


def _searched(where: str) -> str:
    ranked = "SELECT query_no, id, score, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, id) AS rank"
    return f"WITH {SEARCHES} SELECT * FROM ({ranked} FROM scored) WHERE {where}"


def _by_label(value: str) -> str:
    return f"WITH {SEARCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_no, label ORDER BY score DESC, id) AS k FROM scored) SELECT query_no, label, {value} AS score, count(*) AS matching_chunks FROM r GROUP BY query_no, label"


def _excerpt(x: str) -> str:
    return rf"CASE WHEN length({x}) > 220 THEN regexp_replace(left({x}, 217), '\s+$', '') || '...' ELSE {x} END"


def _overlap(words: str, n: int) -> str:
    """Chunks of four sentences with the cosine of word sets; documents without sentences are one chunk."""
    return f"""{_windows(4, 1)}, chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, array_to_string(s[a + 1:e], ' ') AS text FROM windows
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM windows)),
scored AS (SELECT doc_id || '_chunk_' || chunk_index AS id, doc_id, text, w, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_intersect(w, {words})) / sqrt(len(w) * {float(n)}), 6) END AS score
  FROM (SELECT *, list_distinct({_tokens('text')}) AS w FROM chunks))"""


HITS = f"""{INDEX}, full_hits AS (SELECT doc_id, round(sum(s), 6) AS score, 'fulltext' AS search_type FROM bm25 WHERE term = 'moron' GROUP BY doc_id),
semantic AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_intersect(w, ['entire', 'moron', 'with'])) / sqrt(len(w) * 3.0), 6) END AS score, 'semantic' AS search_type
  FROM (SELECT doc_id, list_distinct({_tokens('text')}) AS w FROM documents)),
hits AS (SELECT h.*, d.text, d.source, d.lang, {_tokens('d.text')} AS w FROM (SELECT * FROM full_hits UNION ALL SELECT * FROM semantic WHERE score > 0) h JOIN documents d USING (doc_id)),
best AS (SELECT coalesce(max(score) FILTER (search_type = 'fulltext'), 1.0) AS m FROM hits)"""


def _normalized(terms: list[str], phrase: str | None) -> str:
    """normalized AS (... ns): terms are singular words without y, so their variants are the word and its plural."""
    hit = " + ".join(f"CAST(list_has_any(w, ['{t}', '{t}s']) AS INTEGER)" for t in terms)
    phrases = rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){phrase}($|[^\p{{L}}\p{{N}}_])')" if phrase else "false"
    single = len(terms) == 1 and not phrase
    return f"""flagged AS (SELECT *, {hit} AS h, {phrases} AS p, least(1.0, greatest(0.0, CASE WHEN search_type = 'semantic' THEN score ELSE score / m END)) AS base FROM hits, best),
normalized AS (SELECT *, round(least(1.0, greatest(0.0, base * CASE WHEN h = 0 AND NOT p THEN CASE search_type WHEN 'semantic' THEN {0.55 if single else 0.75} ELSE {0.45 if single else 0.7} END ELSE 1.0 END
  + CASE WHEN p THEN 0.25 WHEN h = {len(terms)} THEN 0.18 WHEN h > 0 THEN 0.10 ELSE 0.0 END + CASE WHEN search_type = 'fulltext' THEN 0.03 ELSE 0.0 END)), 8) AS ns FROM flagged)"""


def _api(limit: int | None) -> str:
    """merged AS (id, doc_id, text, score, search_type, exact, ordinal): a search for the word moron in both engines;
    vectors count four words, so the cosine with the query is the share of the first."""
    count = lambda w: f"len(list_filter(w, lambda x: x = '{w}'))"
    counts = ", ".join(f"{count(w)} AS c{k}" for k, w in enumerate(["moron", "entire", "that", "with"]))
    cut = lambda n: f" WHERE ordinal <= {n}" if limit else ""
    return f"""{INDEX}, {_windows(1, 0)}, chunks AS (
  SELECT doc_id || '_chunk_' || chunk_index AS id, CAST(doc_id AS VARCHAR) AS doc_id, s[a + 1] AS text FROM windows
  UNION ALL SELECT doc_id || '_chunk_0', CAST(doc_id AS VARCHAR), text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM windows)),
counted AS (SELECT id, doc_id, text, w, {counts} FROM (SELECT *, {_tokens('text')} AS w FROM chunks)),
scored AS (SELECT *, CASE WHEN c0 + c1 + c2 + c3 = 0 THEN NULL ELSE round(c0 / sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3), 6) END AS score FROM counted),
sem AS (SELECT * FROM (SELECT id, doc_id, text, score, 'semantic' AS search_type, list_has_any(w, ['moron', 'morons']) AS exact, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS ordinal FROM scored){cut(limit)}),
found AS (SELECT doc_id AS d, round(sum(s), 6) AS score FROM bm25 WHERE term = 'moron' GROUP BY doc_id),
ful AS (SELECT CAST(d AS VARCHAR) AS id, CAST(d AS VARCHAR) AS doc_id, text, score, 'fulltext' AS search_type, true AS exact, ordinal FROM (SELECT *, row_number() OVER (ORDER BY score DESC, d) AS ordinal FROM found) JOIN documents ON d = documents.doc_id{cut(2 * (limit or 0))}),
merged AS (SELECT * FROM sem UNION ALL SELECT * FROM ful WHERE id NOT IN (SELECT id FROM sem) AND id NOT IN (SELECT doc_id FROM sem WHERE exact))"""


#: Excerpts that start as concatenated metadata.
METADATA = r"regexp_matches(left(text, 140), '^\d+\s+\d+') AND regexp_matches(left(text, 140), '\$\d+k?|Weekly|Monthly|No food restrictions|\b(California|West)\b')"


def _responses(word: str) -> str:
    """Hits of a word, and the first answer that holds their snippet or one of the sentences with the word."""
    there = lambda k: f"len({_strip(f'coalesce(q{k}, {chr(39) * 2})')}) > 0 AND (contains({_strip(f'q{k}')}, {_strip('snippet')}) OR len(list_filter(found, lambda s: contains({_strip(f'q{k}')}, {_strip('s')}))) > 0)"
    return f"""WITH {ANSWERS}, d AS (SELECT *, concat_ws(' ', q1, q2, q3, q4, q5) AS text FROM answers),
f AS (SELECT *, list_filter({_sentences('text')}, lambda s: list_has_any({_tokens('s')}, ['{word}', '{word}s', '{word[:-1] if word.endswith("s") else word}'])) AS found FROM d WHERE list_contains({_tokens('text')}, '{word}')),
n AS (SELECT *, array_to_string(found[1:5], ' ') AS snippet FROM f WHERE NOT ({METADATA}))
SELECT CAST(conv_id AS VARCHAR) AS id, CASE {' '.join(f'WHEN {there(k)} THEN {k}' for k in range(1, 6))} END AS response FROM n"""


def _api_normalized() -> str:
    kept = f"SELECT * FROM merged WHERE (search_type = 'fulltext' OR score >= 0.3) AND NOT ({METADATA})"
    english = "doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lower(lang) = 'en')"
    return f"""{_api(None)}, listed AS (SELECT *, max(score) FILTER (search_type = 'fulltext') OVER () AS top FROM ({kept}) WHERE {english}),
hits AS (SELECT id, doc_id, text, score, search_type, {_tokens('text')} AS w FROM listed WHERE search_type = 'semantic' OR score / top >= 0.3),
best AS (SELECT coalesce(max(score) FILTER (search_type = 'fulltext'), 1.0) AS m FROM hits), {_normalized(['moron'], None)}"""


def _expanded() -> str:
    """Two phrases, their lists of 20 fused by rank."""
    norm = "sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3)"
    lists = " UNION ALL ".join(f"SELECT {k} AS q, id, CASE WHEN c0 + c1 + c2 + c3 > 0 THEN round({x} / {norm}, 6) END AS score FROM counted" for k, x in enumerate(["c0", "(c1 + c2) / sqrt(2.0)"]))
    return f"""WITH {_api(None)}, lists AS ({lists}), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC NULLS LAST, id) AS r FROM lists),
fused AS (SELECT id, round(sum(1 / (40.0 + r)), 9) AS rrf, max(score) AS score, min((q, r)) AS seen FROM ranked WHERE r <= 20 GROUP BY id),
best AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, seen, id) AS rank FROM fused)
SELECT id, score, rank FROM best JOIN chunks USING (id) WHERE rank <= 20 AND NOT ({METADATA})"""


def _age() -> str:
    a, n = AGE_LABELS, "CASE p_size % 3 WHEN 0 THEN p_size + 15.0 WHEN 1 THEN p_size + 10.0 ELSE (p_size + 10.0 - (p_size + 30.0)) / 2 END"
    raw = "CASE p_size % 3 WHEN 0 THEN (p_size + 10) || '–' || (p_size + 20) WHEN 1 THEN CAST(p_size + 10 AS VARCHAR) ELSE (p_size + 10) || '-' || (p_size + 30) END"
    labels = _list(a)
    return f"""WITH v AS (SELECT p_partkey, {n} AS n, {raw} AS raw FROM part)
SELECT p_partkey, CASE WHEN list_contains({labels}, replace(raw, '-', '–')) THEN replace(raw, '-', '–') WHEN n < 18 THEN raw WHEN n < 30 THEN '{a[0]}' WHEN n < 45 THEN '{a[1]}' WHEN n < 60 THEN '{a[2]}' ELSE '{a[3]}' END AS bucket FROM v"""


def _normalized_metadata() -> str:
    a, i = AGE_LABELS, INCOME_LABELS
    return f"""SELECT p_partkey, CASE WHEN p_size + 10 < 18 THEN CAST(p_size + 10 AS VARCHAR) WHEN p_size + 10 < 30 THEN '{a[0]}' WHEN p_size + 10 < 45 THEN '{a[1]}' WHEN p_size + 10 < 60 THEN '{a[2]}' ELSE '{a[3]}' END AS age,
  CASE WHEN p_size * 1800 < 25000 THEN '{i[0]}' WHEN p_size * 1800 < 50000 THEN '{i[1]}' WHEN p_size * 1800 < 75000 THEN '{i[2]}' ELSE '{i[3]}' END AS income FROM part"""


def _income() -> str:
    i = INCOME_LABELS
    k = "floor(d / 1000.0)"
    return f"""WITH v AS (SELECT c_custkey, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS d FROM customer),
n AS (SELECT c_custkey, CASE c_custkey % 4
  WHEN 0 THEN CASE WHEN {k} * 1000 < 1000 THEN ({k} * 1000 * 1000 + {k} * 1000) / 2 ELSE ({k} * 1000 + {k}) / 2 END
  WHEN 1 THEN d
  WHEN 2 THEN CASE WHEN d < 1000 THEN d * 1000 - 1 ELSE d - 1 END
  ELSE (d + d + 9999) / 2.0 END AS r FROM v)
SELECT c_custkey, CASE WHEN r < 25000 THEN '{i[0]}' WHEN r < 50000 THEN '{i[1]}' WHEN r < 75000 THEN '{i[2]}' ELSE '{i[3]}' END AS bucket FROM n"""


def _snippet(words: list[str]) -> str:
    variants = _list([v for w in words for v in (w, w + "s")])
    return f"""WITH s AS (SELECT doc_id, text, {_sentences('text')} AS every FROM documents),
m AS (SELECT *, list_filter(every, lambda x: list_has_any({_tokens('x')}, {variants})) AS found FROM s)
SELECT doc_id, CASE WHEN len(found) > 0 THEN array_to_string(found[1:5], ' ') WHEN len(every) >= 2 THEN array_to_string(every[1:2], ' ')
  ELSE left(text, 400) || CASE WHEN length(text) > 400 THEN '...' ELSE '' END END AS snippet FROM m"""


def oracle_sql() -> dict[str, str]:
    entire = "['entire', 'entires', 'moron', 'morons']"
    profile = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM labelled" for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))
    out = {
        "doc_assembly": f"WITH {ANSWERS} SELECT CAST(conv_id AS VARCHAR) AS id, concat_ws(' ', q1, q2, q3, q4, q5) AS text, conv_id AS row_index, CAST(1 + (q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT + (q3 IS NOT NULL)::INT + (q4 IS NOT NULL)::INT + (q5 IS NOT NULL)::INT AS BIGINT) AS n_metadata FROM answers",
        "data_profile_nulls": f"WITH {LABELLED} {profile}",
        "sentence_split": f"WITH parts AS (SELECT doc_id, {_sentences('text', 10)} AS s FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS idx, s[i + 1] AS sentence FROM parts, unnest(range(0, len(s))) AS r(i)",
        "sentence_windows_w1": _chunks(1, 0),
        "sentence_windows_w2o1": _chunks(2, 1),
        "sentence_windows_w4o1": _chunks(4, 1),
        "multi_level_chunks": f"SELECT doc_id, count(*) AS n_chunks, CAST(sum(sentence_count) AS BIGINT) AS n_sentences, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT * FROM ({_chunks(2, 1)}) UNION ALL SELECT * FROM ({_chunks(4, 1)})) GROUP BY doc_id",
        "chunk_records": f"WITH {_windows(1, 0)} SELECT doc_id || '_chunk_' || chunk_index AS id, CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, s[a + 1] AS text, true AS is_chunk FROM windows UNION ALL SELECT doc_id || '_chunk_0', CAST(doc_id AS VARCHAR), 0, text, true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM windows)",
        "chunks_2_3": f"WITH {_pieces('text', 'documents')} SELECT * FROM pieces",
        "ascii_safe": "SELECT doc_id, replace(replace(translate('“' || text || '”–—’', '‘’“”–—', '''''\"\"--'), '…', '...'), chr(160), ' ') AS safe FROM documents",
        "text_batches": "SELECT doc_id, doc_id // 6 AS batch FROM documents",
        "prefixed_text": "SELECT doc_id, CASE WHEN length(text) > 0 THEN 'passage: ' || text ELSE text END AS passage FROM documents",
        "postings_build": f"WITH {INDEX} SELECT term, doc_id, tf FROM postings",
        "term_stats": f"WITH {INDEX} SELECT term, df FROM terms",
        "bm25_search_and": _top("term IN ('the', 'that', 'with')", "HAVING count(*) = 3"),
        "bm25_search_or": _top("term IN ('entire', 'worthless', 'anes')"),
        "boolean_not_search": _found("term IN ('the', 'der', 'with')", "HAVING bool_or(term IN ('the', 'der')) AND NOT bool_or(term = 'with')"),
        "prefix_search": _found("term LIKE 'worth%'"),
        "wildcard_search": _found("term LIKE 'th_t' OR term = 'of'", "HAVING bool_or(term LIKE 'th_t') AND bool_or(term = 'of')"),
        "boosted_search": f"WITH {INDEX} SELECT doc_id, round(sum(s * CASE WHEN term = 'idiot' THEN 2 ELSE 1 END), 6) AS score, count(*) AS matched FROM bm25 WHERE term IN ('idiot', 'moron') GROUP BY doc_id",
        "phrase_search": f"SELECT * FROM ({_found('''term IN ('of', 'the')''')}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE ' ' || array_to_string({_tokens('text')}, ' ') || ' ' LIKE '% of the %')",
        "field_search": _found("term IN ('moron', 'entire')"),
        "range_search": _found("term BETWEEN 'worthless' AND 'worthy'"),
        "saved_index_search": _top("term IN ('the', 'that', 'with')", "HAVING count(*) = 3"),
        "growing_index_search": _top("term IN ('revised', 'moron', 'entire')").replace("FROM documents)", "FROM (SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) THEN concat_ws(' ', d.text, 'revised') ELSE d.text END AS text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)))"),
        "dictionary_wildcard_search": _found("term LIKE 'th_t' OR term = 'of'", "HAVING bool_or(term LIKE 'th_t') AND bool_or(term = 'of')"),
        "fuzzy_search": f"WITH {INDEX}, near AS (SELECT term, q FROM terms, unnest(['worthles', 'moron']) AS w(q) WHERE levenshtein(term, q) <= 1) SELECT doc_id, round(sum(s), 6) AS score, count(DISTINCT q) AS matched FROM bm25 JOIN near USING (term) GROUP BY doc_id HAVING count(DISTINCT q) = 2",
        "fuzzy_fallback": f"WITH {INDEX}, near AS (SELECT term FROM terms WHERE levenshtein(term, 'disgustingg') <= 2), f AS (SELECT doc_id, round(sum(s), 6) AS score FROM bm25 JOIN near USING (term) GROUP BY doc_id) SELECT doc_id, score, CAST(1 AS BIGINT) AS matched, 'fuzzy' AS match_type, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f ORDER BY score DESC, doc_id LIMIT 200",
        "term_variants": f"WITH t AS (SELECT DISTINCT term FROM (SELECT unnest({_tokens('text')}) AS term FROM benchmark) WHERE length(term) >= 3) SELECT term, array_to_string(list_sort(list_distinct({_variants('term')})), ',') AS variants FROM t",
        "query_terms": f"SELECT item_id, array_to_string(list_filter({_tokens('text')}, lambda t: length(t) >= 3 AND NOT list_contains({_list(STOP_WORDS)}, t)), ' ') AS terms FROM benchmark",
        "cosine_topk": _searched("rank <= 10"),
        "cosine_threshold": _searched("score >= 0.2"),
        "rrf_fusion": f"SELECT id, round(sum(1 / (40.0 + rank)), 9) AS rrf, max(score) AS score FROM ({_searched('rank <= 50')}) GROUP BY id",
        "agg_best": _by_label("max(score)"),
        "agg_avg_top3": _by_label("round(avg(score) FILTER (k <= 3), 6)"),
        "agg_sum": _by_label("round(sum(score), 6)"),
        "hybrid_rerank": f"WITH {INDEX}, {_overlap('''['entire', 'worthless']''', 2)}, f AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, round(sum(s), 6) AS score FROM bm25 WHERE term IN ('entire', 'worthless') GROUP BY 1), b AS (SELECT doc_id, max(score) AS s FROM scored GROUP BY doc_id), j AS (SELECT f.doc_id, CASE WHEN f.score > 1 THEN least(f.score / 10, 1.0) ELSE f.score END AS l, greatest(coalesce(s, 0.0), 0.0) AS m FROM f LEFT JOIN b USING (doc_id)) SELECT doc_id, round(l, 6) AS fulltext_score, m AS semantic_score, round(0.5 * l + 0.5 * m, 6) AS combined_score FROM j",
        "hybrid_merge": f"""WITH {INDEX}, {_overlap('''['entire', 'moron']''', 2)}, sem AS (SELECT id, doc_id, score, 'semantic' AS search_type, list_has_any({_tokens('text')}, {entire}) AS exact FROM scored WHERE score > 0.05),
f AS (SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(s), 6) AS score FROM bm25 WHERE term IN ('entire', 'moron') GROUP BY 1),
u AS (SELECT * FROM sem UNION ALL SELECT id, id, score, 'fulltext', true FROM f WHERE id NOT IN (SELECT doc_id FROM sem WHERE exact) AND id NOT IN (SELECT id FROM sem))
SELECT *, row_number() OVER (ORDER BY exact DESC, search_type = 'fulltext' DESC, score DESC, id) AS rank FROM u ORDER BY rank LIMIT 200""",
        "score_threshold": f"WITH {HITS} SELECT doc_id, search_type, score FROM hits, best WHERE CASE WHEN search_type = 'fulltext' THEN score / m ELSE least(1.0, greatest(0.0, score)) END >= 0.3",
        "normalized_score": f"WITH {HITS}, {_normalized(['entire', 'moron', 'moron'], 'entire moron')} SELECT doc_id, search_type, ns AS normalized_score FROM normalized",
        "prevalence_histogram": f"WITH {HITS}, {_normalized(['moron', 'entire'], None)}, b AS (SELECT source || lang AS k, greatest(max(ns), 0.0) AS s FROM normalized GROUP BY 1), c AS (SELECT CAST(least(floor(s * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1) SELECT r.bin, round(r.bin / 30.0, 6) AS low, round((r.bin + 1) / 30.0, 6) AS high, coalesce(n, 0) AS participants FROM range(30) AS r(bin) LEFT JOIN c USING (bin)",
        "snippet_extract": _snippet(["moron", "entire"]),
        "highlight_html": _highlight(["moron", "that"]),
        "meta_filter_hits": f"WITH {LABELLED} SELECT doc_id, lang, source, quality, toxic FROM labelled WHERE lower(lang) <> 'en' AND (quality IS NULL OR quality = 1) AND n_chars BETWEEN 500 AND 3000 AND lower(source) LIKE '%src1%'",
        "meta_filter_strict": f"WITH {LABELLED} SELECT doc_id, lang, source, quality, toxic FROM labelled WHERE lang = 'en' AND quality = 1 AND n_chars > 500 AND (toxic IS NULL OR toxic <> 1) AND source <> 'src3' AND doc_id < 900",
        "meta_fields": "SELECT unnest(['doc_id', 'lang', 'n_chars', 'quality', 'source', 'toxic']) AS field",
        "meta_values": "SELECT DISTINCT source AS value FROM documents ORDER BY value LIMIT 100",
        "age_bucket": _age(),
        "income_bucket": _income(),
        "metadata_map_filter": "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500",
        "field_keys": r"SELECT p_partkey, regexp_replace(lower(' _' || p_type || '_Key ' || p_brand), '[_\s]+', '', 'g') AS key FROM part",
        "normalized_metadata": _normalized_metadata(),
        "metadata_prefix_filter": r"SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND NOT (doc_id % 3 = 1 AND regexp_matches(left(doc_id || ' 34 ' || text, 140), '\$\d+k?|Weekly|Monthly|No food restrictions|\b(California|West)\b')) AND NOT (doc_id % 3 = 2 AND regexp_matches(left(text, 140), '^\d+\s+\d+') AND regexp_matches(left(text, 140), '\$\d+k?|Weekly|Monthly|No food restrictions|\b(California|West)\b'))",
        "workbook_rows": f"WITH {ANSWERS} SELECT conv_id, {', '.join(f"nullif(q{k}, '') AS q{k}_response" for k in range(1, 6))} FROM answers",
        "workbook_types": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
        "longform_inference": f"WITH {ANSWERS}, q AS (SELECT *, {_strip('''coalesce(substring(q3, 3, 12), substring(q2, 2, 12), '#')''')} AS q FROM answers) SELECT conv_id, CASE {' '.join(f'WHEN length(trim(q{k})) > 0 AND contains(q{k}, q) THEN {k}' for k in range(1, 6))} END AS response FROM q",
        "text_source_select": f"WITH {ANSWERS} SELECT conv_id, {_strip('q2')} AS text FROM answers WHERE length({_strip('''coalesce(q2, '')''')}) > 0",
        "full_text_enrich": f"""WITH {_windows(1, 0)}, c AS (SELECT doc_id, chunk_index FROM windows UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM windows))
SELECT doc_id || '_chunk_' || chunk_index AS id, CAST(length(text) AS BIGINT) AS n_chars FROM c JOIN documents USING (doc_id)""",
        "participant_keys": f"WITH {LABELLED} SELECT doc_id, coalesce(CAST(quality AS VARCHAR), CAST(doc_id AS VARCHAR)) AS participant FROM labelled",
        "safe_filenames": r"SELECT page_id, left(replace(trim(regexp_replace(' My run ' || url, '[^\p{L}\p{N}\-_. ]', '', 'g')), ' ', '_'), 120) AS name FROM pages",
        "doc_theme_scores": f"WITH {SCORES} SELECT * FROM scores",
        "theme_prevalence": f"WITH {SCORES} SELECT t.cluster_id, count(s.doc_id) AS docs, round(coalesce(avg(score), 0), 6) AS mean_score, count(*) FILTER (score > 0) AS docs_with_any FROM themes t LEFT JOIN scores s USING (cluster_id) GROUP BY t.cluster_id",
        "cluster_sizes_topk": f"WITH {POINTS} SELECT cluster_id, count(*) AS n FROM points WHERE cluster_id <> -1 GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 5",
        "cluster_centroids": f"WITH {POINTS} SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM points GROUP BY 1",
        "theme_representatives": f"""WITH {POINTS}, {THEMES}, f AS (SELECT cluster_id, string_agg(bullet, '|' ORDER BY bullet_id) AS b FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY bullet_id) AS k FROM points) WHERE k <= 6 GROUP BY 1),
w AS (SELECT t.cluster_id, bullet, row_number() OVER (PARTITION BY t.cluster_id ORDER BY pos, bullet_id) AS k FROM (SELECT cluster_id, unnest(example_doc_ids) AS doc_id, generate_subscripts(example_doc_ids, 1) AS pos FROM themes) t JOIN points p ON p.cluster_id = t.cluster_id AND p.doc_id = t.doc_id),
c AS (SELECT cluster_id, string_agg(bullet, '|' ORDER BY k) AS b FROM w WHERE k <= 6 GROUP BY 1)
SELECT cluster_id, coalesce(c.b, f.b, '') AS bullets FROM themes LEFT JOIN f USING (cluster_id) LEFT JOIN c USING (cluster_id)""",
        "theme_quotes": f"""WITH {POINTS}, {THEMES}, known AS (SELECT doc_id, 'quote ' || doc_id AS quote FROM range(97) AS r(doc_id) WHERE doc_id % 3 <> 0 AND doc_id >= 12),
wanted AS (SELECT cluster_id, pos, quote FROM (SELECT cluster_id, unnest(example_doc_ids) AS doc_id, generate_subscripts(example_doc_ids, 1) AS pos FROM themes) JOIN known USING (doc_id)),
firsts AS (SELECT cluster_id, min(bullet_id) AS pos, any_value(quote) AS quote FROM points JOIN known USING (doc_id) GROUP BY cluster_id, doc_id),
u AS (SELECT * FROM wanted UNION ALL SELECT * FROM firsts WHERE cluster_id NOT IN (SELECT cluster_id FROM wanted)),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS k FROM u)
SELECT cluster_id, string_agg(quote, '|' ORDER BY k) AS quotes FROM k WHERE k <= 4 GROUP BY cluster_id""",
        "bullet_metadata": f"WITH {POINTS} SELECT doc_id, bullet_id, source, lang FROM points LEFT JOIN documents USING (doc_id)",
        "chosen_theme_scores": f"WITH {ANSWERED} SELECT doc_id, bullet_id, concept_id, CAST(score AS DOUBLE) AS score FROM graded WHERE concept_id IN (0, 3)",
        "lenient_json": r"SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(regexp_extract(props, '\"k\": *(-?\d+)', 1) AS INTEGER) END AS k FROM events",
        "clamped_numbers": "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 3 ELSE least(greatest(user_id, 3), 80) END AS INTEGER) AS n FROM events",
        "expanded_search": _expanded(),
        "saved_runs": f"""WITH {POINTS} SELECT 'themes_of' || lang AS run, '{{"lang": "' || lang || '", "points": ' || count(*) || '}}' AS payload FROM points JOIN documents USING (doc_id) GROUP BY lang""",
        "graded_scores": f"WITH {ANSWERED} SELECT doc_id, bullet_id, concept_id, CAST(score AS DOUBLE) AS score, CASE WHEN known THEN 'why' ELSE '' END AS rationale, CASE WHEN known THEN 'quote ' || bullet_id ELSE '' END AS highlight FROM graded",
        "concept_top_matches": f"WITH {ANSWERED}, k AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, bullet_id) AS r FROM graded WHERE score >= 0.75) SELECT concept_id, string_agg('- quote ' || bullet_id, chr(10) ORDER BY r) AS matches FROM k WHERE r <= 8 GROUP BY concept_id",
        "graded_replies": f"WITH {REPLIES} SELECT doc_id, bullet_id, concept_id, score, rationale, highlight FROM graded",
        "concept_summaries": f"""WITH {REPLIES}, k AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, bullet_id) AS r FROM graded WHERE score >= 0.75)
SELECT concept_id, string_agg('- ' || highlight, chr(10) ORDER BY r) AS matches, count(*) || ' examples, first ' || min(highlight) FILTER (r = 1) AS summary FROM k WHERE r <= 8 GROUP BY concept_id""",
        "api_responses": _responses("tion"),
        "membership_scores": f"WITH {POINTS}, {THEMES} SELECT doc_id, bullet_id, CAST(t.cluster_id AS VARCHAR) AS concept_id, name AS concept_name, CASE WHEN t.cluster_id = p.cluster_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, bullet AS highlight FROM points p CROSS JOIN themes t",
        "theme_selection": "SELECT CAST(k AS INTEGER) AS cluster_id, 'theme ' || (k % 4) AS name, CAST(10 * k AS INTEGER) AS n_points FROM unnest([0, 3]) AS r(k)",
        "tool_search": f"WITH {_api(50)}, r AS (SELECT id, doc_id, search_type, score, text, row_number() OVER (ORDER BY exact DESC, search_type = 'fulltext' DESC, score DESC NULLS LAST, ordinal, id) AS rank FROM merged) SELECT id, doc_id, search_type, score, rank FROM r WHERE rank <= 50 AND NOT ({METADATA})",
        "api_search": f"""WITH {_api_normalized()}, s AS (SELECT n.*, d.text AS whole, {_sentences('d.text')} AS every FROM normalized n JOIN documents d ON CAST(d.doc_id AS VARCHAR) = n.doc_id),
m AS (SELECT *, list_filter(every, lambda x: list_has_any({_tokens('x')}, ['moron', 'morons'])) AS found FROM s)
SELECT id, doc_id, search_type, ns AS normalized_score, CAST(length(CASE WHEN search_type = 'semantic' THEN text WHEN len(found) > 0 THEN array_to_string(found[1:5], ' ') WHEN len(every) >= 2 THEN array_to_string(every[1:2], ' ') ELSE left(whole, 400) || CASE WHEN length(whole) > 400 THEN '...' ELSE '' END END) AS BIGINT) AS n_snippet FROM m""",
        "api_histogram": f"WITH {_api_normalized()}, b AS (SELECT doc_id AS k, greatest(max(ns), 0.0) AS s FROM normalized GROUP BY 1), c AS (SELECT CAST(least(floor(s * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1) SELECT r.bin, round(r.bin / 30.0, 6) AS low, round((r.bin + 1) / 30.0, 6) AS high, coalesce(n, 0) AS participants FROM range(30) AS r(bin) LEFT JOIN c USING (bin)",
        "sink_points_csv": f"WITH {POINTS} SELECT doc_id, bullet_id, cluster_id, x, y, bullet, bullet || ' | b' AS quote, {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in POINT_COLUMNS[7:])} FROM points",
        "excerpts": f"SELECT doc_id, {_excerpt('text')} AS excerpt FROM documents",
        "bullet_rows": f"""WITH joined AS (SELECT doc_id, array_to_string({_sentences('text', 10)}, ' ') AS t FROM documents WHERE len({_sentences('text', 10)}) > 0), {_pieces('t', 'joined')}
SELECT doc_id, chunk_no AS bullet_no, {_excerpt('text')} AS bullet, sentence_count FROM pieces""",
    }
    out["dictionary_fuzzy_search"] = out["fuzzy_search"]
    return out
