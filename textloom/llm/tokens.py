"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two white-space characters in a row, or one at the end: then a piece may not start at each space.
_WHITE = r"[\t-\r\x1c-\x20\x85\pZ]"
_RUN = f"{_WHITE}{_WHITE}|{_WHITE}$"
_SPACE = re.compile(r"\s")
#: A token never spans a white-space character that follows another character.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Longer pieces are encoded but not kept.
_KEEP_CHARS = 64
#: Punctuation after a letter starts a token. Letters up to here are letters in every Unicode version.
_TAIL, _LATIN_END = ".,!?;:#$%&*|", "\u0250"
#: New pieces that are encoded as one text.
_JOINED = 20_000
#: Bytes of texts that are worked on together (at least one text).
_TOGETHER = 8 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Encodes texts with a byte-level BPE file whose pre-tokeniser starts a token at a white-space
    character that follows a non-space one. So the ids of a text are those of its pieces, joined, and a
    piece met before needs no second encoding. Results are little-endian unsigned 32-bit ids.

    Texts are cut at single spaces and line feeds, equal pieces of some MB of texts are found by Arrow, and
    ids are put together by numpy; Python sees each distinct piece once for these MB. A line feed between two
    other characters is a token of its own. New pieces without white space inside are encoded together, a
    line each, and their ids cut apart again. Texts with runs of white space are cut one by one.

    ``capacity``: new pieces after which those not met since the last turn are forgotten (so at most twice
    as many are kept, of some 200 bytes each).
    """

    def __init__(self, path: str, capacity: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._capacity = capacity
        feed = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._feed = feed[0] if len(feed) == 1 else None
        self._between = np.array(feed, "<u4").tobytes()
        self._tails: dict[str, bytes] = {}
        self._plain: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}  # by the piece without the space before it
        self._old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without special tokens; a null text has none."""
        ids, at = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``encode`` for stretches of a column: number of the first text, ids, and bounds."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TOGETHER, "right")))
            yield (at, *self.encode(texts.slice(at, end - at)))
            at = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and bounds: text k has those from bounds[k] to bounds[k + 1]."""
        if len(self._plain) + len(self._spaced) > self._capacity:
            self._old = (self._plain, self._spaced)
            self._plain, self._spaced, self._tails = {}, {}, {}
        texts = pc.fill_null(texts, "")
        runs = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False) if self._feed is not None else np.ones(len(texts), bool)
        if not runs.any():
            return self._cut_together(texts)
        plain = self._cut_together(texts.filter(pa.array(~runs)))
        others = iter(self._cut_by_runs(texts.filter(pa.array(runs)).to_pylist()))
        at = zip(plain[1][:-1].tolist(), plain[1][1:].tolist(), strict=True)
        parts = [np.frombuffer(next(others), "<u4") if run else plain[0][slice(*next(at))] for run in runs.tolist()]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _cut_together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without runs of white space. A line's first piece keeps the line feed before it; each text gets
        one more in front, whose id is left out again."""
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        pieces = lists.flatten().dictionary_encode()
        fed = pc.starts_with(pieces.dictionary, "\n")
        after = self._ids(pieces.dictionary.filter(pc.invert(fed)).to_pylist(), 1)
        first = self._ids(pc.utf8_slice_codeunits(pieces.dictionary.filter(fed), 1).to_pylist(), 0)
        found = [*after, *(self._between + x for x in first)]
        place = np.empty(len(found), np.int64)  # of each distinct piece among those found
        fed = fed.to_numpy(zero_copy_only=False)
        place[~fed], place[fed] = np.arange(len(after)), np.arange(len(after), len(found))
        known = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = place[pieces.indices.to_numpy()]
        own = sizes[codes]
        ends = np.cumsum(own)
        begins = ends - own
        shift = np.int32 if max(len(known), ends[-1]) < 1 << 31 else np.int64
        ids = known[np.repeat(((np.cumsum(sizes) - sizes)[codes] - begins).astype(shift), own) + np.arange(ends[-1], dtype=shift)]
        starts = begins[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
        keep = np.ones(len(ids), bool)
        keep[starts] = False
        return ids[keep], np.concatenate([starts, ends[-1:]]) - np.arange(len(texts) + 1)

    def _cut_by_runs(self, texts: list[str]) -> list[bytes]:
        split = [_CUT.split(t) for t in texts]
        words = list({p for pieces in split for p in pieces})
        known = dict(zip(words, self._ids(words, 0), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def _ids(self, words: list[str], spaced: int) -> list[bytes]:
        """Ids of distinct pieces, after a space or as they are."""
        known, old = (self._plain, self._spaced)[spaced], self._old[spaced]
        found = list(map(known.get, words))
        places = [i for i, x in enumerate(found) if x is None]
        if places:
            new = [words[i] for i in places]
            if old:
                met = {p: x for p, x in zip(new, map(old.get, new), strict=True) if x is not None}
                known.update(met)
                rest = [p for p in new if p not in met]
            else:
                rest = new
            self._learn(rest, known, " " * spaced)
            for i, p in zip(places, new, strict=True):
                found[i] = known[p]
            for p in rest:
                if len(p) > _KEEP_CHARS:
                    del known[p]
        return found

    def rest(self) -> None:
        """To be called at a task's end: a worker lives on, and shares its executor's memory with other steps."""
        self._old = ({}, {})

    def _learn(self, new: list[str], known: dict[str, bytes], before: str) -> None:
        """Adds the ids of pieces that are not known."""
        tails: list[tuple[str, str]] = []
        lines: set[str] = set()
        if self._feed is not None:
            for p in new:
                if p.isalnum():
                    lines.add(p)
                elif p:
                    core = p.rstrip(_TAIL)
                    if core and core is not p and core[-1] < _LATIN_END and core[-1].isalpha():
                        tails.append((p, core))
                        p = core
                    if p.isalnum() or not _SPACE.search(p):
                        lines.add(p)
        todo = [p for p in lines if p not in known]
        for at in range(0, len(todo), _JOINED):
            some = todo[at : at + _JOINED]
            text = before + f"\n{before}".join(some)
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ids == self._feed) * 4).tolist()
            if len(cuts) != len(some) - 1:
                raise ValueError("this tokenizer joins line feeds with other characters")
            octets = ids.tobytes()
            known.update(zip(some, [octets[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(octets)], strict=True)], strict=True))
        for p, core in tails:
            if core in known:
                tail = p[len(core) :]
                if tail not in self._tails:
                    self._tails[tail] = np.array(self._tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
                known[p] = known[core] + self._tails[tail]
        other = [p for p in new if p not in known]
        if other:
            found = self._tokenizer.encode_batch_fast([before + p for p in other], add_special_tokens=False)
            known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(other, found, strict=True))


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of texts with one more id at the end of each."""
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for this file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
