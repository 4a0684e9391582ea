"""Porter's stemming algorithm (1980), applied once to each distinct term of a batch that a task has not met before."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
_M0 = re.compile(f"^({_CS})?{_VS}{_CS}")
_M1 = re.compile(f"^({_CS})?{_VS}{_CS}({_VS})?$")
_M2 = re.compile(f"^({_CS})?{_VS}{_CS}{_VS}{_CS}")
_VOWEL = re.compile(f"^({_CS})?{_V}")
_CVC = re.compile(f"^{_CS}{_V}[^aeiouwxy]$")
# Suffixes of the published algorithm's steps 2, 3 and 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.partition(":")[::2]) for x in text.split()), key=lambda p: -len(p[0]))


_TABLES = [_pairs(_STEP2), _pairs(_STEP3)]
_ENDS = sorted(_STEP4.split(), key=len, reverse=True)


def porter(w: str) -> str:
    """The stem of a lower-case word of ASCII letters; other words stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    w = "Y" + w[1:] if w[0] == "y" else w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M0.match(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _VOWEL.match(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")) or _CVC.match(w):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in _TABLES:
        for end, to in table:
            if w.endswith(end):
                w = w[: -len(end)] + to if _M0.match(w[: -len(end)]) else w
                break
    for end in [*_ENDS, "ion"]:
        stem = w[: -len(end)]
        if w.endswith(end) and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem if _M2.match(stem) else w
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _M2.match(stem) or (_M1.match(stem) and not _CVC.match(stem)):
            w = stem
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return w.lower()


#: Stems that a task remembers.
KEPT = 1 << 17


def stemmed(words: Column, least: int, skipped: list[str]) -> Column:
    """The stems of an array of words, in their places; null for the ``skipped`` ones and those shorter than ``least``."""
    others = frozenset(skipped)

    @F.arrow_udf("array<string>")
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stem = lru_cache(KEPT)(lambda w: None if len(w) < least or w in others else porter(w))
        for batch in batches:
            flat, offsets = batch.flatten().dictionary_encode(), batch.offsets.to_numpy()
            to = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
            yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), to.take(flat.indices))

    return stems(words)
