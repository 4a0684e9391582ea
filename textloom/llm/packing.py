"""Packing into fixed windows: non-negative least squares over shallow length combinations.

Texts are encoded and gathered in blocks of some million ids. In a block, each document gives its full
windows and a rest shorter than the window. Rests are counted in length classes of ``window // CLASSES`` ids.
All combinations of up to ``PARTS`` classes whose upper ends add up to the window are enumerated, so any rests
of these classes fit. Their repeat counts are the non-negative least squares solution against the histogram,
rounded to the nearest number within supply, and solved again for what is left. The residue is packed
greedily, the longest first: its ids fill the gaps that planned windows leave, then further windows, and are
cut where a window ends. So only the last sequence of a block can be short.

A block is a stretch of one input partition, so its memory does not grow with the corpus. The short sequences
of all blocks are then packed together, the same way: there are at most as many as blocks, and one in
some thousands of those stays short, however many partitions the input has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.tokens import default_path, encoder, with_ends

#: Ids of a block: 16 MB, about 2,000 windows.
BLOCK_IDS = 1 << 22
#: Length classes of a window, and rests that a combination has at most.
CLASSES, PARTS = 64, 3
#: Times that the counts are solved for what rounding left.
TURNS = 3
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(classes: int, parts: int = PARTS) -> np.ndarray:
    """Every way to write ``classes`` as a sum of at most ``parts`` numbers, largest first (0: no further)."""
    found: list[list[int]] = []

    def extend(head: list[int], left: int) -> None:
        if left == 0:
            found.append(head + [0] * (parts - len(head)))
        elif len(head) < parts:
            for v in range(min(left, head[-1] if head else left), 0, -1):
                extend([*head, v], left - v)

    extend([], classes)
    return np.array(found, np.int64)


def solve_nnls(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|^2, by the active-set method of Lawson and Hanson. At most as
    many entries as ``matrix`` has rows are above 0, so few counts are lost by rounding."""
    n = matrix.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * n):
        slope = np.where(free, -np.inf, matrix.T @ (target - matrix @ x))
        if not n or slope.max() <= small:
            break
        free[slope.argmax()] = True
        while True:
            full = np.zeros(n)
            full[free] = np.linalg.lstsq(matrix[:, free], target, rcond=None)[0]
            low = free & (full <= small)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - full[low], 1e-300)).min()
            x = x + step * (full - x)
            free &= x > small
            x[~free] = 0
        x = full
    return x


def plan_rests(rest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that the least-squares counts make: positions of their rests (a row each; -1: none) and ids
    that each leaves free. As many as the residue can fill up, those with the least gaps first."""
    grain = max(1, window // CLASSES)
    classes = window // grain
    patterns = combinations(classes)
    matrix = np.stack([(patterns == c).sum(1) for c in range(1, classes + 1)]).astype(float)
    of = -(-rest // grain)
    order = np.lexsort((np.arange(len(rest)), -rest, of))
    order = order[(of[order] > 0) & (of[order] <= classes)]
    at = np.searchsorted(of[order], np.arange(1, classes + 2))
    next_of, left = at[:-1].copy(), np.diff(at)
    made = []
    for _ in range(TURNS):
        usable = ~(matrix[left == 0] > 0).any(0)
        x = np.zeros(len(patterns))
        x[usable] = solve_nnls(matrix[:, usable], left.astype(float))
        before = len(made)
        for k in np.argsort(-x, kind="stable"):
            need = matrix[:, k].astype(np.int64)
            times = min([int(x[k] + 0.5), *(left[need > 0] // need[need > 0]).tolist()])
            if x[k] < 0.5:
                break
            if times < 1:
                continue
            rows = np.full((times, PARTS), -1, np.int64)
            for j, c in enumerate(patterns[k][patterns[k] > 0] - 1):
                rows[:, j] = order[next_of[c] : next_of[c] + times]
                next_of[c] += times
            left -= times * need
            made.append(rows)
        if len(made) == before:
            break
    windows = np.concatenate([*made, np.zeros((0, PARTS), np.int64)])
    used = np.where(windows >= 0, rest[windows], 0).sum(1) if len(rest) else np.zeros(0, np.int64)
    by = np.argsort(window - used, kind="stable")
    windows, gaps = windows[by], (window - used)[by]
    enough = np.cumsum(gaps) <= rest.sum() - np.cumsum(window - gaps)
    n = len(gaps) if enough.all() else int(enough.argmin())
    return windows[:n], gaps[:n]


def plan_block(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of a block's documents: arrays doc (position), start, length, sequence, offset; and the
    number of sequences."""
    n = len(lengths)
    full, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(n), full)
    first = np.cumsum(full) - full
    start = (np.arange(len(doc)) - np.repeat(first, full)) * window
    out = [[doc, start, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)]]
    sequences = int(full.sum())

    windows, gaps = plan_rests(rest, window)
    numbers, offset = sequences + np.arange(len(windows)), np.zeros(len(windows), np.int64)
    for j in range(PARTS):
        some = windows[:, j] >= 0
        docs = windows[some, j]
        out.append([docs, full[docs] * window, rest[docs], numbers[some], offset[some]])
        offset[some] += rest[docs]
    sequences += len(windows)

    # The residue: longest first, laid end to end over the gaps and then over further windows.
    residue = np.ones(n, bool)
    residue[windows[windows >= 0]] = False
    docs = np.flatnonzero(residue & (rest > 0))
    docs = docs[np.argsort(-rest[docs], kind="stable")]
    ends, room_ends = np.cumsum(rest[docs]), np.cumsum(gaps)
    total, within = int(ends[-1]) if len(ends) else 0, int(room_ends[-1]) if len(room_ends) else 0
    room_ends = np.concatenate([room_ends, np.arange(within + window, total + window, window)])
    cuts = np.unique(np.concatenate([[0], ends, room_ends[room_ends < total]])).astype(np.int64)
    begin, length = cuts[:-1], np.diff(cuts)
    which, room = np.searchsorted(ends, begin, "right"), np.searchsorted(room_ends, begin, "right")
    room_begin = np.concatenate([[0], room_ends])[room]
    into = np.concatenate([window - gaps, np.zeros(len(room_ends) - len(gaps), np.int64)])[room]
    out.append([docs[which], full[docs[which]] * window + begin - (ends - rest[docs])[which], length, sequences - len(windows) + room, into + begin - room_begin])
    sequences += -(-max(0, total - within) // window)
    return (*(np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(5)), sequences)


def _pieces(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray, starts: np.ndarray, totals: np.ndarray, window: int, base: int, with_ids: bool, last: bool) -> tuple[pa.RecordBatch, int]:
    """Rows of a block's pieces, and its number of sequences. Entry k has the ids from at[k] to at[k + 1];
    ``starts``, ``totals``: where it lies in its document, and that one's length. Unless ``last``, pieces of
    short sequences are marked and keep their ids."""
    doc, start, length, sequence, offset, n = plan_block(np.diff(at), window)
    by = np.lexsort((offset, sequence))
    doc, start, length, sequence, offset = (a[by] for a in (doc, start, length, sequence, offset))
    octets, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (at[doc] + start)
    parts = [octets[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
    short = (np.bincount(sequence, length, n) < window)[sequence] & (not last)
    kept = [bytes(p) if with_ids or s else None for p, s in zip(parts, short.tolist(), strict=True)]
    arrays = [doc_ids.take(pa.array(doc)), pa.array(starts[doc] + start), pa.array(length), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(totals[doc]), pa.array(base + sequence), pa.array(offset), pa.array(short), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, _NAMES), n


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "short", "ids"]
_PIECES = SCHEMA + ", short boolean, ids binary"
#: Sequence ids hold a partition's number above these bits; packed remainders follow those of all partitions.
_PART_BITS, _REMAINDERS = 36, 1 << 26


def pack(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with
    ``with_ids`` also ``ids``, the piece's ids as little-endian unsigned 32-bit integers.

    Every id of every text, and its ``end_id``, lies in exactly one piece. A null text counts as empty
    (one piece with the end id), a null id stays null, repeated rows are packed as often as they come,
    an empty table gives no rows, and other columns are ignored. A sequence id holds the input partition
    (upper bits) and the sequence's number there. A document longer than a block makes a block alone.
    """
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _PART_BITS
        doc_ids, held, sizes, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal base
            totals = np.concatenate(sizes)
            at = np.concatenate([[0], np.cumsum(totals)])
            rows, n = _pieces(pa.concat_arrays(doc_ids), np.concatenate(held), at, np.zeros_like(totals), totals, window, base, with_ids, False)
            base += n
            return rows

        tok = encoder(tokenizer)
        for batch in batches:
            for first, ids, at in tok.batches(batch.column(1)):
                ids, at = with_ends(ids, at, end_id)
                done = 0
                while done < len(at) - 1:
                    # up to the document that fills the block
                    end = min(len(at) - 1, int(np.searchsorted(at, at[done] + block_ids - size, "left")))
                    held.append(ids[at[done] : at[end]])
                    doc_ids.append(batch.column(0).slice(first + done, end - done))
                    sizes.append(np.diff(at[done : end + 1]))
                    size, done = size + int(at[end] - at[done]), end
                    if size >= block_ids:
                        yield block()
                        doc_ids, held, sizes, size = [], [], [], 0
        if held:
            yield block()
        tok.rest()

    keyed = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    made = materialize(keyed.mapInArrow(run, _PIECES), "pieces")

    def remainders(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        base = (_REMAINDERS + rows.column("part")[0].as_py()) << _PART_BITS
        held = rows.column("ids").to_pylist()
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])])
        starts, totals = (rows.column(c).to_numpy() for c in ("start", "doc_tokens"))
        found, _ = _pieces(rows.column("doc_id").combine_chunks(), np.frombuffer(b"".join(held), "<u4"), at, starts, totals, window, base, with_ids, True)
        return pa.Table.from_batches([found])

    short = made.where("short")
    groups = max(1, -(-(short.agg(F.sum("length")).first()[0] or 0) // block_ids))
    part = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int").alias("part")
    again = short.select(part, "doc_id", "start", "doc_tokens", "ids").groupBy("part").applyInArrow(remainders, _PIECES)
    names = _NAMES[:7] + (["ids"] if with_ids else [])
    return made.where("not short").select(*names).unionByName(again.select(*names))
