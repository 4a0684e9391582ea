"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Items are dealt into blocks of about ``block_words`` words, and each block's automaton is built in a task.
Blocks are a fixed size, so a few automata are small enough to broadcast: training words stream through
PASS_BLOCKS of them at once, and a larger benchmark takes a further pass for as many blocks more. At each
word the length of the longest match that ends there is known; where it reaches the window's length, the
window's words are hit.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

WINDOW = 10
#: Words of a block of items: an automaton of at most twice as many states, some 60 MB.
BLOCK_WORDS = 100_000
#: Automata that are broadcast together.
PASS_BLOCKS = 4
#: Word characters of UTF-8 text are 0-9, a-z, A-Z (lower-cased) and all bytes from 0x80.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._add(last, w)
        #: The state, among this one and its suffixes, that holds the window's words.
        self.at_window = [self._up(v) for v in range(len(self.next))]
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded:
            v = 0
            for i, w in enumerate(ids):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.items.setdefault(self.at_window[v], set()).add(item)
            if len(ids) < window:
                while self.length[self.link[v]] >= len(ids):
                    v = self.link[v]
                short.setdefault(v, []).append((len(ids), item))
        #: Whole short items that may end at a state: its own and those of its suffixes.
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                if found := short.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = found
        self.least = min([window, *(len(ids) for _, ids in coded)])

    def _up(self, v: int) -> int:
        while v > 0 and self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that p and w make."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) spans of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        if not self.vocabulary or not words:
            return spans, found
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        # Only a stretch of known words can hold a window: the match length is 0 at any other word.
        for begin, end in known.reshape(-1, 2).tolist():
            if end - begin >= self.least:
                self._stretch(ids[begin:end].tolist(), begin, spans, found)
        return spans, found

    def _stretch(self, ids: list[int], base: int, spans: list[list[int]], found: set[str]) -> None:
        edges, link, lengths, window, short = self.next, self.link, self.length, self.window, self.short
        v = size = 0
        for i, w in enumerate(ids, base + 1):
            while v > 0 and w not in edges[v]:
                v = link[v]
                size = lengths[v]
            to = edges[v].get(w)
            if to is None:
                continue
            v, size = to, size + 1
            hit = 0
            if size >= window:
                hit = window
                found |= self.items[self.at_window[v]]
            for m, item in short.get(v, ()):
                if m <= size:
                    hit = max(hit, m)
                    found.add(item)
            if hit:
                begin = i - hit
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = i
                else:
                    spans.append([begin, i])


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, automaton: the benchmark's automata, built in tasks. An item longer than a block is cut into
    stretches that share window - 1 words, which keeps all its windows."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                cut = [words[at : at + block_words + window - 1] for at in range(0, max(1, len(words) - window + 1), block_words)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut)), pa.array([len(c) for c in cut], pa.int64()), pa.array([b" ".join(c) for c in cut], pa.binary())], ["item", "n", "words"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).dropna()
    rows = materialize(rows.mapInArrow(stretches, "item string, n long, words binary").where("n > 0"), "items")
    blocks = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // block_words))

    def build(part: pa.Table) -> pa.Table:
        own = SuffixAutomaton([(item, words.split()) for item, words in zip(part.column("item").to_pylist(), part.column("words").to_pylist(), strict=True)], window)
        return pa.table({"block": part.column("block")[:1], "automaton": pa.array([pickle.dumps(own)], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int").alias("block"), "item", "words")
    return materialize(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"), "automata")


def _passes(made: DataFrame) -> list[list[int]]:
    """Numbers of the automata (``automata``), PASS_BLOCKS at a time; one empty list without any."""
    numbers = sorted(r.block for r in made.select("block").collect())
    return [numbers[at : at + PASS_BLOCKS] for at in range(0, max(1, len(numbers)), PASS_BLOCKS)]


def _shared(made: DataFrame, numbers: list[int]) -> Broadcast:
    """These automata, broadcast. Of several passes each is made when it starts and destroyed when its table is
    written, so the driver and the executors hold one pass at a time."""
    some = [r.automaton for r in made.where(F.col("block").isin(numbers)).select("automaton").collect()] if numbers else []
    return made.sparkSession.sparkContext.broadcast([pickle.loads(bytes(x)) for x in some])


def search_all(found_by: list[SuffixAutomaton], words: list[bytes]) -> tuple[list[list[int]], set[str]]:
    """What ``search`` finds with several automata."""
    spans, items = [], set()
    for automaton in found_by:
        hit, found = automaton.search(words)
        spans += hit
        items |= found
    return spans if len(found_by) == 1 else _merged(spans), items


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


#: Columns that ``find_matches`` adds.
MATCHES = "dc_words long, dc_spans array<array<bigint>>, dc_items array<string>"


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and dc_words (number of words), dc_spans (hit words as merged
    [start, end) pairs), dc_items (sorted ids of the items whose windows occur). Columns of these names
    are replaced. A null or empty text has no words; null item ids count as the empty string; an empty
    benchmark hits nothing. Narrow work on each row: no shuffle, and repeated rows stay."""
    kept = [c for c in docs.columns if c not in ("dc_words", "dc_spans", "dc_items")]
    out = docs.select(*kept)
    made = automata(benchmark, item_col, item_text_col, window, block_words)
    *earlier, last = _passes(made)
    for k, numbers in enumerate(earlier):
        shared = _shared(made, numbers)
        out = materialize(_scan(out, kept, text_col, shared, k > 0), "decontaminate")
        shared.destroy()
    return _scan(out, kept, text_col, _shared(made, last), bool(earlier))


def _scan(docs: DataFrame, kept: list[str], text_col: str, shared, more: bool) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    text_at = len(docs.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, spans, items = [], [], []
                old = zip(batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2).to_pylist(), strict=True) if more else None
                for text in batch.column(text_at).to_pylist():
                    words = words_of(text or b"")
                    hit, found = search_all(found_by, words)
                    if old:
                        hit0, found0 = next(old)
                        hit, found = _merged(hit + hit0), found.union(found0)
                    counts.append(len(words))
                    spans.append(hit)
                    items.append(sorted(found))
                columns = [batch.column(i) for i in range(len(kept))]
                columns += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "dc_words", "dc_spans", "dc_items"])

    return docs.withColumn("__dc_text", F.col(text_col).cast("string").cast("binary")).mapInArrow(scan, f"{fields}, {MATCHES}" if fields else MATCHES)


def hit_words(spans) -> F.Column:
    """Number of words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of each span and what lies between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def cleaned(text: bytes, found_by: list[SuffixAutomaton]) -> tuple[bytes, int]:
    """The text without hit spans, again until no window is left, and how many words that took."""
    lost = 0
    while spans := search_all(found_by, words_of(text))[0]:
        text = cut_spans(text, spans)
        lost += sum(b - a for a, b in spans)
    return text, lost


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", max_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without the benchmark's passages, in the columns of ``docs``.

    Hit spans are cut out of the text, again until no window is left. A document that loses more than
    ``max_coverage`` of its words goes. ``chars_col``, if present, is set to the new length where text was
    cut. Documents without hits, null and empty texts stay as they are. One pass over the rows for each
    PASS_BLOCKS blocks of items, without a shuffle; where there are more, passes go on until none cuts."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"), F.lit(None).cast("long").alias("words"), F.lit(0).cast("long").alias("lost"))
    row = out.schema["row"].dataType.simpleString()

    def scanned(rows: DataFrame, shared) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    texts, words, lost = [], [], []
                    for text, n, before in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                        new, cut = (None, 0) if text is None else cleaned(text, shared.value)
                        texts.append(new)
                        words.append(len(words_of(text or b"")) if n is None else n)
                        lost.append(before + cut)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(words, pa.int64()), pa.array(lost, pa.int64())], ["row", "text", "words", "lost"])

        return rows.mapInArrow(scan, f"row {row}, text binary, words long, lost long")

    made = automata(benchmark, "item_id", "text", window, block_words)
    passes, total, before = _passes(made), 0, -1
    if len(passes) == 1:
        out = scanned(out, _shared(made, passes[0]))
    while len(passes) > 1 and total != before:  # a cut can join words to a passage of an earlier pass
        for numbers in passes:
            shared = _shared(made, numbers)
            out = materialize(scanned(out, shared), "decontaminate")
            shared.destroy()
        before, total = total, out.agg(F.sum("lost")).first()[0] or 0
    hit = F.col("lost") > 0
    out = out.where(~hit | (F.col("lost") <= max_coverage * F.col("words"))).withColumn("text", F.col("text").cast("string"))

    def cell(c: str) -> F.Column:
        old = F.col("row")[c]
        new = F.col("text") if c == text_col else F.length("text").cast(docs.schema[c].dataType) if c == chars_col else None
        return (old if new is None else F.when(hit, new).otherwise(old)).alias(c)

    return out.select(*map(cell, docs.columns))
