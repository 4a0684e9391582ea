"""Splitting, tokenising and term rules as Column expressions.

Patterns are Unicode-aware, and word characters are ``[\\p{L}\\p{N}_]``. Null text gives null or an empty
array, as each function says.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not searched for.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by",
    "for", "from", "has", "have", "he", "her", "hers", "him", "his",
    "i", "if", "in", "into", "is", "it", "its",
    "me", "my", "of", "on", "or", "our", "ours", "she", "so",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "was", "we", "were", "what", "when", "where", "which", "who", "why", "with", "you", "your",
]
WORD = r"[\p{L}\p{N}_]+"
#: Unicode white space, as characters and as a class: quicker than a pattern that asks for the property.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
MIN_SENTENCE, MAX_CHUNKS, MAX_PHRASES = 10, 50, 5


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` removes spaces only)."""
    return F.trim(c, F.lit(SPACES))


def sentences(c: Column, min_length: int = 0) -> Column:
    """Sentences, cut at white space after ``.``, ``!`` or ``?``; those shorter than ``min_length`` code points
    are left out. Null or blank text has none. A cut takes all white space around it, so parts need no strip."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), f"(?<=[.!?]){SPACE}+")
    return F.filter(parts, lambda s: F.length(s) >= max(1, min_length))


def theme_sentences(c: Column) -> Column:
    """Like ``sentences``, but runs of white space become one space first."""
    return sentences(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside a lambda of a higher-order function an expression would
    be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_CHUNK = "struct<text:string,start_sentence_idx:int,end_sentence_idx:int,sentence_count:int>"


def windows(parts: Column, size: int, overlap: int) -> Column:
    """Sliding windows over an array of sentences: structs of text, first and last index, and count. Fewer
    sentences than ``size`` make one window; the last one may be short."""
    return let(parts, lambda p: _windows(p, size, size - min(overlap, max(0, size - 1))))


def _windows(parts: Column, size: int, step: int) -> Column:
    n = F.size(parts)
    count = F.when(n < size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)

    def window(i: Column) -> Column:
        start = i * step
        end = F.least(start + size, n)
        return F.struct(F.array_join(F.slice(parts, start + 1, F.lit(size)), " ").alias("text"), start.alias("start_sentence_idx"), (end - 1).alias("end_sentence_idx"), (end - start).alias("sentence_count"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), window)).otherwise(F.array().cast(f"array<{_CHUNK}>"))


def chunks(c: Column, size: int = 1, overlap: int = 0, min_length: int = MIN_SENTENCE) -> Column:
    """A document's windows of sentences."""
    return windows(sentences(c, min_length), size, overlap)


def chunks_or_whole(c: Column, size: int = 1, overlap: int = 0, min_length: int = MIN_SENTENCE) -> Column:
    """``chunks``; a text without sentences is one chunk as it is."""
    whole = F.array(F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lit(0).alias("start_sentence_idx"), F.lit(0).alias("end_sentence_idx"), F.lit(1).alias("sentence_count")))
    return let(chunks(c, size, overlap, min_length), lambda found: F.when(F.size(found) == 0, whole).otherwise(found))


def multi_level_chunks(c: Column, small: int = 2, large: int = 4, overlap: int = 1) -> Column:
    """Small windows, then large ones."""
    return F.concat(chunks(c, small, overlap), chunks(c, large, overlap))


def chunk_of(i: Column, n: Column) -> Column:
    """Which chunk of two or three sentences holds sentence i of n: threes, but a rest of four is two twos."""
    tail = n - 4
    return F.when((n % 3 == 1) & (n >= 4) & (i >= tail), F.floor(tail / 3) + F.floor((i - tail) / 2)).otherwise(F.floor(i / 3)).cast("int")


def chunks_2_3(parts: Column, limit: int | None = MAX_CHUNKS) -> Column:
    """Disjoint chunks of two or three sentences (one if there is only one): text, first and last index,
    count. At most ``limit`` chunks."""
    return let(parts, lambda p: _chunks_2_3(p, limit))


def _chunks_2_3(parts: Column, limit: int | None) -> Column:
    n = F.size(parts)
    rest = n % 3
    twos = (rest == 1) & (n >= 4)
    count = F.when(n <= 3, 1).when(twos, F.floor((n - 4) / 3) + 2).otherwise(F.ceil(n / 3)).cast("int")
    threes = F.when(twos, F.floor((n - 4) / 3)).otherwise(F.floor(n / 3)).cast("int")

    def chunk(k: Column) -> Column:
        start = F.when(k <= threes, k * 3).otherwise(threes * 3 + (k - threes) * 2)
        size = F.when(k < threes, 3).otherwise(F.least(F.when(twos, 2).otherwise(3), n - start))
        return F.struct(F.array_join(F.slice(parts, start + 1, size), " ").alias("text"), start.cast("int").alias("start_sentence_idx"), (start + size - 1).cast("int").alias("end_sentence_idx"), size.cast("int").alias("sentence_count"))

    found = F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), chunk)).otherwise(F.array().cast(f"array<{_CHUNK}>"))
    return F.slice(found, 1, limit) if limit else found


def tokens(c: Column) -> Column:
    """Lower-case words, in order. Null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), 1)


def ascii_safe(c: Column) -> Column:
    """Curly quotes and dashes as ASCII."""
    c = F.translate(c, "‘’“”–—", "''\"\"--")
    return F.regexp_replace(F.regexp_replace(c, "…", "..."), " ", " ")


def prefixed(c: Column, is_query: bool, enabled: bool = False) -> Column:
    """With the prefix that some embedding models expect, for texts that are not empty."""
    return F.when(F.length(c) > 0, F.concat(F.lit("query: " if is_query else "passage: "), c)).otherwise(c) if enabled else c


_LEAST_TERM = 3


def query_words(query: str | None, stop_words: bool = True) -> list[str]:
    """A query's terms: lower-case words of three or more characters; without the stop words, if asked."""
    skipped = frozenset(STOP_WORDS) if stop_words else frozenset()
    return [m.group().lower() for m in re.finditer(rf"\w{{{_LEAST_TERM},}}", query or "") if m.group().lower() not in skipped]


def term_array(c: Column) -> Column:
    """``query_words`` of a column of queries."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= _LEAST_TERM) & ~t.isin(STOP_WORDS))


def quoted_phrases(query: str | None) -> list[str]:
    """Phrases in double quotes that are not blank, the first MAX_PHRASES."""
    between = (query or "").split('"')[1::2]
    if (query or "").count('"') % 2:
        between = between[:-1]  # the last quote is not closed
    return list(filter(None, map(str.strip, between)))[:MAX_PHRASES]


def _endings() -> list[tuple[int, str, str]]:
    """How a term's number changes: (a length that the term must exceed, its end, what stands for that)."""
    return [(4, "ies", "y"), (4, "es", ""), (3, "s", ""), (2, "y", "ies")]


def variant_array(t: Column) -> Column:
    """Singular and plural variants of a lower-case term, itself first; none shorter than three."""
    n = F.length(t)
    changed = [F.when((n > least) & t.endswith(end), F.concat(F.left(t, F.greatest(n - len(end), F.lit(0))), F.lit(to))) for least, end, to in _endings()]
    found = F.array(t, *changed, F.when((n > 2) & ~t.endswith("s"), F.concat(t, F.lit("s"))))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (F.length(v) >= _LEAST_TERM)))


def variants(term: str) -> list[str]:
    """``variant_array`` for a term of the query, on the driver."""
    t = term.lower().strip()
    found = {t} | {t.removesuffix(end) + to for least, end, to in _endings() if len(t) > least and t.endswith(end)}
    if len(t) > 2 and not t.endswith("s"):
        found.add(t + "s")
    return sorted(v for v in found if len(v) >= _LEAST_TERM)


def has_any(words: Column, term: str) -> Column:
    """Does a token array hold a variant of the term?"""
    return F.arrays_overlap(words, F.array(*map(F.lit, variants(term) or [term])))


def match_count(words: Column, terms: list[str]) -> Column:
    """How many of the terms have a variant among the tokens."""
    return sum((has_any(words, t).cast("int") for t in terms), F.lit(0))


def phrase_match(c: Column, phrases: list[str]) -> Column:
    """Does the text hold one of the phrases, between word boundaries, in any case?"""
    out = F.lit(False)
    for p in phrases:
        safe = re.sub(r"([^\w\s])", r"\\\1", p.lower())
        out = out | F.lower(c).rlike(rf"(?<![\p{{L}}\p{{N}}_]){safe}(?![\p{{L}}\p{{N}}_])")
    return F.coalesce(out, F.lit(False))


def batch_number(row: Column, size: int) -> Column:
    """Batch of a row counted from 0; a size of 0 or less makes one batch."""
    return F.floor(row / size).cast("int") if size > 0 else F.lit(0)
