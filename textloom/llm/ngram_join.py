"""N-gram Jaccard join: which documents have shingle sets with a Jaccard similarity of 3/4 or more.

Documents with equal sets are one node. A pair of linked nodes shares one of the rarest n // 4 + 1 shingles
of either set, in any order of shingles that holds for all; the order here is by a count sketch of the whole
corpus, so passages that many documents share come last and make no candidates by themselves. Nodes that
share such a key form a block. Each block first links its nodes to a pivot (within a task, across tasks,
then, large ones, to other pivots where components are left), which settles groups of copies in linear work. Only where a
block is left with nodes of different components are pairs compared: shingles hash into groups, a node's
group counts are a point, and an R-tree over the points gives the pairs whose summed coordinate minima allow
the overlap; nodes of the block's largest component are compared with the others only. Nodes in such pairs, not
the pairs, leave the task; their whole sets are then compared block by block, and of the links found as many are
kept as join the block's components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, materialize, small_or_shuffled
from textloom.llm.components import components

SHINGLE = 5
#: Jaccard of at least 3/4: 7 * intersection >= 3 * (sum of the sizes).
#: Buckets of the count sketch, 2 ** SKETCH_BITS: 16 MB whatever the corpus holds.
SKETCH_BITS = 22
_SKETCH_BLOCK = 1 << 16
#: Shingles that a task gathers before it counts them: 8 MB.
_SEEN = 1 << 20
#: Groups that shingles are hashed into, the coordinates of a point: a power of two, the set's size or up to
#: twice that, as chance overlap of group counts is told from real overlap only by a few a group. A point with
#: twice the groups folds onto one with fewer by adding its halves; the tree holds points folded by COARSE.
LEAST_GROUPS, MOST_GROUPS, COARSE = 32, 1 << 14, 4
_FULL = 255
#: Keys that a task gathers before it looks for shared ones: 24 MB.
LOCAL_KEYS = 1_000_000
#: Rows of a side that are compared in one go; larger blocks are cut into a grid.
PIECE = 4_096
#: Rounds in which unresolved blocks are linked to other pivots before pairs are compared.
PIVOT_TURNS = 2
#: Blocks of more nodes get these rounds; those up to here stay out of them and are compared at once.
PIVOT_ROWS = 64
#: Cells of at most so many pairs are compared many at a time, without a tree.
FEW_PAIRS = 4_096
#: Elements of the sets on a side that are compared in one go: 8 MB. A larger set is compared by itself.
ELEMENTS = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: Bytes of texts whose words are hashed at once (a longer text by itself): arrays of some 15 MB.
_WINDOW = 1 << 20
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64
_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and a 64-bit hash of each: of its bytes, eight at a time, and their number. ``data``
    begins with a space and ends with eight."""
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, np.uint8)])) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # at each byte
    h = _mixed((sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[starts] & _MASKS[np.minimum(sizes, 8)]))
    more, at = np.flatnonzero(sizes > 8), 8
    while len(more) and at < _LONG_WORD:
        h[more] = _mixed(h[more] ^ (eight[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)]))
        at += 8
        more = more[sizes[more] > at]
    for k in more:
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return starts, h


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s += h[i : i + n] * _MULTIPLIERS[i]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(29)
    return s


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; with fewer words, of the whole sequence."""

    def sets(some: list[bytes]) -> Iterator[np.ndarray]:
        # for bytes: A-Z, and white space 09-0D and 20
        starts, h = _word_hashes(b" %b%b" % (b" ".join(some).lower(), b" " * 8))
        every = _shingles(h, SHINGLE) if len(h) >= SHINGLE else h
        cuts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in some)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < SHINGLE:
                yield _shingles(h[a:b], b - a) if b > a else np.empty(0, np.uint64)
                continue
            s = np.sort(every[a : b - SHINGLE + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]

    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size >= _WINDOW:
            yield from sets(held)
            held, size = [], 0
    if held:
        yield from sets(held)


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _point(s: np.ndarray) -> bytes:
    groups = min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (len(s) - 1).bit_length()))
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), _FULL).astype("u1").tobytes()


def _coordinates(points) -> np.ndarray:
    """Points of one length as rows of an array."""
    points = list(points)
    return np.frombuffer(b"".join(points), "u1").reshape(len(points), -1)


def _folded(points: np.ndarray, groups: int) -> np.ndarray:
    return points if points.shape[1] == groups else points.reshape(len(points), -1, groups).sum(1, dtype=np.uint32)


def _overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The most that sets can overlap: summed coordinate minima. Only sets of millions fill a coordinate."""
    return np.minimum(p, q).sum(-1, dtype=np.int64)


def _bounds(ps: pd.Series, qs: pd.Series) -> np.ndarray:
    """The most that each pair of points can overlap. A point with a full coordinate bounds nothing."""
    out = np.zeros(len(ps), np.int64)
    for (a, b), at in pd.Series(range(len(ps))).groupby([ps.map(len).to_numpy(), qs.map(len).to_numpy()]):
        for k in range(0, len(at), 256):
            i = at.to_numpy()[k : k + 256]
            groups, p, q = min(a, b), _coordinates(ps.iloc[i]), _coordinates(qs.iloc[i])
            full = (p == _FULL).any(1) | (q == _FULL).any(1)
            out[i] = np.where(full, 1 << 60, _overlap(_folded(p, groups), _folded(q, groups)))
    return out


def linked(size_a, size_b, both):
    return 7 * both >= 3 * (size_a + size_b)


class CountTree:
    """R-tree over group-count points, bulk-loaded by size. A node keeps its points' largest coordinates:
    the overlap of a query with any of them is at most the sum of the smaller coordinates."""

    LEAF, FAN = 32, 8

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        spread = points[:256].std(0).argmax() if len(points) else 0
        self.order = np.lexsort((points[:, spread], sizes))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = []
        step, tops, low, high = self.LEAF, self.points, self.sizes, self.sizes
        while True:
            cuts = np.arange(0, len(tops), step)
            tops, low, high = (np.maximum.reduceat(tops, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)) if len(cuts) else (tops, low, high)
            self.levels.append((tops, low, high))
            if len(tops) <= self.FAN:
                return
            step = self.FAN

    @staticmethod
    def _may(size: int, point: np.ndarray, tops: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which boxes may hold a linked point, sizes from low to high."""
        fits = (4 * high >= 3 * size) & (3 * low <= 4 * size)
        return fits & linked(size, low, _overlap(point, tops))

    def query(self, size: int, point: np.ndarray) -> np.ndarray:
        """Positions, in the order given, of points that the bound allows to be linked."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high = self.levels[depth]
            nodes = nodes[self._may(size, point, tops[nodes], low[nodes], high[nodes])]
            fan = self.LEAF if depth == 0 else self.FAN
            below = len(self.points) if depth == 0 else len(self.levels[depth - 1][0])
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = nodes[nodes < below]
        return self.order[nodes[self._may(size, point, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _profiles(texts: DataFrame) -> DataFrame:
    """A row per document (id, n, node, point), and the task's part of the count sketch in blocks."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                n, node, point = [], [], []
                for s in shingle_sets(some.column(1).to_pylist()):
                    n.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    point.append(_point(s) if len(s) else None)
                    seen.append(_bucket(s))
                    size += len(s)
                    if size >= _SEEN:
                        sketch += np.bincount(np.concatenate(seen), minlength=len(sketch)).astype(np.uint32)
                        seen, size = [], 0
                none = pa.nulls(len(n), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(point, pa.binary()), none, pa.nulls(len(n), pa.binary())], ["id", "n", "node", "point", "block", "counts"])
        if size:
            np.add.at(sketch, np.concatenate(seen), 1)
        if sketch.any():
            blobs = [zlib.compress(sketch[i : i + _SKETCH_BLOCK].astype("<u4", copy=False).tobytes(), 1) for i in range(0, len(sketch), _SKETCH_BLOCK)]
            k = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary())], ["id", "n", "node", "point", "block", "counts"])

    return texts.mapInArrow(profile, "id long, n long, node long, point binary, block int, counts binary")


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The corpus' counts: the tasks' blocks are summed on the executors, first those of a sixteenth of the
    tasks, and 16 MB reach the driver. Blocks stream through a task, which holds its sums only."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, turn, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault((block, turn), np.zeros(_SKETCH_BLOCK, np.int64))
                own += np.frombuffer(zlib.decompress(blob), "<u4")
        blobs = [zlib.compress(np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([t for _, t in sums], pa.int32()), pa.array(blobs, pa.binary())], ["block", "turn", "counts"])

    rows = profiles.where("block is not null").select("block", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int").alias("turn"), "counts")
    rows = rows.repartition("block", "turn").mapInArrow(total, "block int, turn int, counts binary")
    rows = rows.select("block", F.lit(0).alias("turn"), "counts").repartition("block").mapInArrow(total, "block int, turn int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows.collect():
        out[r.block * _SKETCH_BLOCK : (r.block + 1) * _SKETCH_BLOCK] = np.frombuffer(zlib.decompress(bytes(r.counts)), "<u4")
    return out


def _keys(texts: DataFrame, sketch) -> DataFrame:
    """kind, key, node, n, pivot, pivot_n, many. Kind 0: a task's first node of a key (no pivot; many: if it
    has more). Kind 1: its other nodes of that key, with the first one as pivot. So a key has at most one
    row of kind 0 for each gathering of a task, however many documents share it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held_k, held_n, held_s, size = sketch.value, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, node, n = np.concatenate(held_k).astype(np.int64), np.concatenate(held_n), np.concatenate(held_s)
            by = np.lexsort((node, key))
            key, node, n = key[by], node[by], n[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, n = key[new], node[new], n[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(key)))
            pivot, pivot_n, many = np.repeat(node[starts], sizes), np.repeat(n[starts], sizes), np.repeat(sizes > 1, sizes)
            for at in range(0, len(key), 50_000):
                cut = slice(at, at + 50_000)
                none = first[cut]
                yield pa.RecordBatch.from_arrays([pa.array((~none).astype(np.int8)), pa.array(key[cut]), pa.array(node[cut]), pa.array(n[cut]), pa.array(pivot[cut], mask=none), pa.array(pivot_n[cut], mask=none), pa.array(many[cut])], ["kind", "key", "node", "n", "pivot", "pivot_n", "many"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for s in shingle_sets(batch.column(1).slice(at, 1024).to_pylist()):
                    if len(s):
                        rare = s[np.argsort(counts[_bucket(s)], kind="stable")[: len(s) // 4 + 1]]
                        held_k.append(rare)
                        held_n.append(np.full(len(rare), _node(s), np.int64))
                        held_s.append(np.full(len(rare), len(s), np.int64))
                        size += len(rare)
                        if size >= LOCAL_KEYS:
                            yield from flush()
                            held_k, held_n, held_s, size = [], [], [], 0
        if held_k:
            yield from flush()

    return texts.mapInArrow(keys, "kind tinyint, key long, node long, n long, pivot long, pivot_n long, many boolean")


def _sets(texts: DataFrame) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [s for s in shingle_sets(batch.column(1).slice(at, 256).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], ["node", "elements"])

    return texts.mapInArrow(sets, "node long, elements binary")


def _sets_of(nodes: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame | None:
    """node, elements: whole sets, made anew for documents of these nodes only. Without nodes, None."""
    nodes = materialize(points.select("node", F.col("rep").alias("id")).join(nodes.distinct(), "node"), "near-nodes")
    found = nodes.agg(F.count("*").alias("nodes"), F.count("id").alias("ids")).first()
    if not found.nodes:
        return None
    small = F.broadcast if found.nodes <= BROADCAST_ROWS else lambda df: df
    source = texts.join(small(nodes.select("id").where("id is not null").distinct()), "id", "left_semi")
    if found.ids < found.nodes:
        source = source.unionByName(texts.where("id is null"))
    return materialize(_sets(source).join(small(nodes.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked: first by the bound on points, then on whole sets, which are
    made anew for documents that are still in question only."""

    @F.pandas_udf("boolean")
    def allowed(na: pd.Series, p: pd.Series, nb: pd.Series, q: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype=bool)
        return pd.Series(linked(na.to_numpy(), nb.to_numpy(), _bounds(p, q)))

    @F.pandas_udf("boolean")
    def same(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            merged = np.sort(np.concatenate((x, y)), kind="stable")
            out.append(bool(linked(len(x), len(y), int((merged[1:] == merged[:-1]).sum()))))
        return pd.Series(out, dtype=bool)

    p = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("p"))
    q = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("q"))
    near = materialize(pairs.join(p, "a").join(q, "b").where(allowed("na", "p", "nb", "q")).select("a", "b"), "near-pairs")
    sets = _sets_of(near.select(F.explode(F.array("a", "b")).alias("node")), points, texts)
    if sets is None:
        return near
    x, y = sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return near.join(x, "a").join(y, "b").where(same("x", "y")).select("a", "b").distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links. Only components that these links join are looked at."""
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joins = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = components(joins.where("a <> b").distinct()).select(F.col("node").alias("label"), F.col("label").alias("new"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node"))
    out = labels.unionByName(nodes).join(small_or_shuffled(new), "label", "left")
    return materialize(out.select("node", F.coalesce("new", "label").alias("label")), "node-labels")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    rows = members.select("key", "node").join(small_or_shuffled(labels), "node", "left")
    return rows.select("key", "node", F.coalesce("label", "node").alias("label"))


def _unresolved(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """key, node, label of blocks that hold nodes of different components, and more than two: both of a
    block of two have been compared. With them the rows of the largest block (0: there is none). ``members``:
    key, node, in which a row may come twice."""
    rows = _labelled(members, labels)
    keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c")).where("low <> high and c > 2")
    keys = materialize(keys.select("key", "c"), "unresolved")
    found = keys.agg(F.count("*").alias("keys"), F.max("c").alias("most")).first()
    if not found.keys:
        return keys.select("key", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("label"), "c"), 0
    keys = F.broadcast(keys) if found.keys <= BROADCAST_ROWS else keys
    return materialize(rows.join(keys, "key").distinct(), "unresolved-blocks"), found.most


def _pivot_pairs(blocks: DataFrame, turn: int) -> DataFrame:
    """Each node of a block with a pivot that differs by block and turn, if it is of another component."""
    pivots = blocks.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", "key", F.lit(turn))).alias("p"))
    pivots = small_or_shuffled(materialize(pivots, "pivots"))
    pairs = blocks.join(pivots, "key").where(F.col("label") != F.col("p.label"))
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _by_cell(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole cells, sorted by ``cell``, and where each begins."""
    rest = None  # the last cell, which may go on in the next batch
    for batch in batches:
        pdf = batch.to_pandas() if rest is None else pd.concat([rest, batch.to_pandas()])
        at = pdf[cell].to_numpy()
        starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1))) if len(at) else np.zeros(1, int)
        if starts[-1]:
            yield pdf.iloc[: starts[-1]], starts[:-1]
        rest = pdf.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest, np.zeros(1, int)


def _forest(label: np.ndarray, elements: list[bytes], lefts: int) -> Iterator[tuple[int, int]]:
    """Positions of linked sets, the first ``lefts`` against the others: as many links as join the labels."""
    n = np.array([len(e) // 8 for e in elements])
    found, code = np.unique(np.frombuffer(b"".join(elements), "<u8"), return_inverse=True)
    ends = np.cumsum(n)
    starts, ours, has = (ends - n)[:lefts], code[: ends[lefts - 1]], np.zeros(len(found), bool)
    root = np.unique(label, return_inverse=True)[1]
    for y in range(lefts, len(n)):
        others = np.flatnonzero(root[:lefts] != root[y])
        if not len(others):
            continue
        own = code[ends[y] - n[y] : ends[y]]
        has[own] = True
        both = np.add.reduceat(has[ours], starts, dtype=np.int64)
        has[own] = False
        hits = others[linked(n[others], n[y], both[others])]
        roots, first = np.unique(root[hits], return_index=True)
        for x in hits[first]:
            yield int(x), y
        root[np.isin(root, roots)] = root[y]


def _block_links(blocks: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a < b) within blocks, as many as join the components that any link of a block joins.

    ``blocks``: key, node, label. Blocks with the same nodes count once. A block's rows are cut into pieces,
    and those outside its largest component also into chunks; each (piece, chunk) is compared by itself, first by
    the bound on points. Only nodes that it leaves in question go on, a row for each and cell at most; a node
    that several cells would compare with the same others stays in one of them. Then whole sets are compared."""
    same = blocks.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor("node").alias("x")).where("c > 2")
    keys = materialize(same.groupBy("c", "s", "x").agg(F.min("key").alias("key")).select("key"), "block-keys")
    rows = blocks.join(small_or_shuffled(keys), "key", "left_semi")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.select("key", F.col("top.label").alias("major"), F.ceil(F.col("all") / PIECE).alias("p"), F.ceil((F.col("all") - F.col("top.c")) / PIECE).alias("q"))
    rows = rows.join(small_or_shuffled(materialize(mixed, "mixed-blocks")), "key").join(points, "node")
    zero = F.lit(0).cast("long")
    left = rows.select("key", "node", "label", "n", "point", F.lit(0).alias("side"), F.pmod(F.xxhash64("node"), "p").alias("i"), F.explode(F.sequence(zero, F.col("q") - 1)).alias("j"))
    right = rows.where("label <> major").select("key", "node", "label", "n", "point", F.lit(1).alias("side"), F.pmod(F.xxhash64("node", F.lit(1)), "q").alias("j"), F.explode(F.sequence(zero, F.col("p") - 1)).alias("i"))
    cells = left.unionByName(right)
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sides 0 and 1."""
        pdf = pdf.assign(at=np.arange(len(pdf)))
        l, r = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        # Sides by their number of groups; sizes a third apart differ by one halving at most. Points with a full
        # coordinate are compared with all.
        left = {g: some for g, some in l.groupby(l["point"].map(len))}
        for own, some in r.groupby(r["point"].map(len)):
            for other in (own // 2, own, own * 2):
                if other not in left:
                    continue
                against, groups = left[other], min(own, other)
                fine, mine = _folded(_coordinates(against["point"]), groups), _folded(_coordinates(some["point"]), groups)
                sizes, at, marks = against["n"].to_numpy(), against["at"].to_numpy(), against["label"].to_numpy()
                full = (_coordinates(against["point"]) == _FULL).any(1)
                coarse = max(LEAST_GROUPS, groups // COARSE)
                tree, views = CountTree(sizes, _folded(fine, coarse)), _folded(mine, coarse)
                for y, label, n, point, view, raw in zip(some["at"], some["label"], some["n"], mine, views, some["point"], strict=True):
                    hit = np.arange(len(sizes)) if _FULL in raw else np.union1d(tree.query(n, view), np.flatnonzero(full))
                    hit = hit[marks[hit] != label]
                    if _FULL not in raw:
                        hit = hit[full[hit] | linked(n, sizes[hit], _overlap(point, fine[hit]))]
                    a.append(at[hit])
                    b.append(np.full(len(hit), y))
        return np.concatenate(a), np.concatenate(b)

    def compare_few(pdf: pd.DataFrame, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """All sides of many cells at once. ``cell``: each row's, in order."""
        side, node, label, n = (pdf[c].to_numpy() for c in ("side", "node", "label", "n"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        begin = np.searchsorted(cell[left], np.arange(cells + 1))
        each = np.diff(begin)[cell[right]]
        y = np.repeat(right, each)
        x = left[np.repeat(begin[cell[right]] - (np.cumsum(each) - each), each) + np.arange(len(y))]
        fits = (label[x] != label[y]) & (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
        x, y = x[fits], y[fits]
        if not len(x):
            return x, y
        # a pair is in a cell for each key that it shares
        _, at, pair = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1), axis=0, return_index=True, return_inverse=True)
        u, v = x[at], y[at]
        may = linked(n[u], n[v], _bounds(pdf["point"].iloc[u], pdf["point"].iloc[v]))[pair.ravel()]
        return x[may], y[may]

    def asked(pdf: pd.DataFrame, cell: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """The rows in question, their pieces of at most ELEMENTS, and for side 1 a hash of the other side's nodes."""
        by = np.argsort(y, kind="stable")
        right, starts = np.unique(y[by], return_index=True)
        hashes = np.add.reduceat(_mixed(pdf["node"].to_numpy()[x[by]].astype(np.uint64)), starts).astype(np.int64) if len(y) else np.zeros(0, np.int64)
        left = np.unique(x)
        at, others = np.append(left, right), np.append(np.zeros(len(left), np.int64), hashes)
        group = 2 * cell[at] + np.repeat([0, 1], [len(left), len(right)])
        by = np.argsort(group, kind="stable")
        at, others, group = at[by], others[by], group[by]
        before = np.cumsum(n := pdf["n"].to_numpy()[at]) - n
        own = (before - before[np.searchsorted(group, group)]) // ELEMENTS
        pieces = np.zeros(2 * int(cell[-1]) + 2 if len(cell) else 0, np.int64)
        np.maximum.at(pieces, group, own + 1)
        some = pdf.iloc[at]
        columns = {c: pa.array(some[c].to_numpy(), pa.int64()) for c in ("key", "i", "j", "node", "label")}
        columns |= {"side": pa.array(group % 2, pa.int64()), "own": pa.array(own, pa.int64()), "pieces": pa.array(pieces[group ^ 1], pa.int64()), "others": pa.array(others, pa.int64())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf, starts in _by_cell(batches, ["key", "i", "j"]):
            cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
            side = pdf["side"].to_numpy()
            few = np.bincount(cell[side == 0], minlength=len(starts)) * np.bincount(cell[side == 1], minlength=len(starts)) <= FEW_PAIRS
            some, own = pdf[few[cell]], (np.cumsum(few) - 1)[cell[few[cell]]]
            yield asked(some, own, *compare_few(some, own, int(few.sum())))
            for k in np.flatnonzero(~few):
                yield asked(some := pdf[cell == k], np.zeros(len(some), int), *compare(some))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf, starts in _by_cell(batches, ["key", "i", "j", "u", "v"]):
            a, b = [], []
            for k, end in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
                some = pdf.iloc[k:end]
                node, lefts = some["node"].to_numpy(), int((some["side"] == 0).sum())
                for x, y in _forest(some["label"].to_numpy(), some["elements"].tolist(), lefts) if 0 < lefts < len(some) else ():
                    a.append(min(node[x], node[y]))
                    b.append(max(node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = materialize(cells.mapInArrow(run, "key long, i long, j long, node long, label long, side long, own long, pieces long, others long"), "asked")
    once = found.where("side = 1").groupBy("node", "others").agg(F.min(F.struct("key", "i", "j")).alias("cell")).select("node", "cell.*")
    once = small_or_shuffled(materialize(once, "asked-once"))
    right = found.where("side = 1").join(once, ["key", "i", "j", "node"], "left_semi")
    left = found.where("side = 0").join(once.select("key", "i", "j").distinct(), ["key", "i", "j"], "left_semi")
    kept = materialize(right.unionByName(left).drop("others"), "in-question")
    sets = _sets_of(kept.select("node"), points, texts)
    if sets is None:
        return kept.select(F.col("node").alias("a"), F.col("node").alias("b"))
    held = kept.withColumn("other", F.explode(F.sequence(zero, F.col("pieces") - 1)))
    held = held.select("key", "i", "j", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("u"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("v"), "side", "node", "label")
    held = held.join(sets, "node").repartition("key", "i", "j", "u", "v").sortWithinPartitions("key", "i", "j", "u", "v", "side")
    return held.mapInArrow(settle, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, n_shingles, component_id (smallest id that links reach, itself included)
    and ``links_found``: how many links between different sets it took to settle its component (not all that
    there are: pairs of one component are not compared again).

    Null, empty and blank texts have an empty set, link with nothing and are their own component. Rows with
    equal ids keep a row each. Rows with a null id take part, but never name a component. All work grows
    with the documents and the candidates; no step pairs all rows of a group."""
    texts = _texts(docs, id_col, text_col)
    spark = docs.sparkSession
    profiles = materialize(_profiles(texts), "profiles")
    counts = spark.sparkContext.broadcast(_sketch(profiles))
    rows = profiles.where("block is null")
    points = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point"))
    points = materialize(points, "points")

    keys = _keys(texts, counts)
    of_key = Window.partitionBy("key", F.when(F.col("kind") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("node").bitwiseOR(F.lit(1).cast("long"))))
    keys = keys.withColumns({"tasks": F.count("*").over(of_key), "first": F.min(F.struct("node", "n")).over(of_key)}).where("kind = 1 or many or tasks > 1")
    shared = keys.select("key", "node", "n", F.coalesce("pivot", "first.node").alias("pivot"), F.coalesce("pivot_n", "first.n").alias("pivot_n"))
    shared = materialize(shared, "keys")

    star = shared.where("node <> pivot and 4 * n >= 3 * pivot_n and 4 * pivot_n >= 3 * n")
    star = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = materialize(_verified(star, points, texts), "star-links")
    labels = materialize(components(links), "node-labels")
    blocks, most = _unresolved(shared, labels)
    if most:
        small, large = blocks.where(F.col("c") <= PIVOT_ROWS), blocks.where(F.col("c") > PIVOT_ROWS)
        for turn in range(PIVOT_TURNS):
            if most <= PIVOT_ROWS:
                break
            more = materialize(_verified(_pivot_pairs(large, turn), points, texts), "more-links")
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = _relabelled(labels, more)
            large, most = _unresolved(large, labels)
        # small blocks stay out of the rounds, but their nodes may be joined by them
        blocks = _labelled(small, labels).unionByName(large.select("key", "node", "label"))
        more = materialize(_block_links(blocks, points, texts), "more-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = _relabelled(labels, more)
    links = links.distinct()

    named = points.select("node", "rep").join(labels, "node")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = named.join(smallest, "label").join(degree, "node").select("node", "component", "links")
    alone = points.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    out = rows.select("id", "n", "node").join(alone, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links_found"))
