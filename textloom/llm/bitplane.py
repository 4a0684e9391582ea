"""Token-ID binary output: id blocks transposed into byte or bit planes, each compressed with zstandard.

A shard is one binary value with this layout (little-endian):

    magic ``TLBP``, u16 version, u8 planes (4 byte planes or 32 bit planes), u8 zero,
    u32 ids per chunk, u64 ids, u32 chunks
    chunk index: for each chunk u64 offset, u32 ids, u32 crc32 of the ids, u32 length of each plane
    the planes, one zstandard frame each

Any range of ids can be read by decoding only the chunks that hold it. Shards are kept in a Parquet
container (``part``, ``shard``, ids before it in its part, ``blob``, and the ids and lengths of its documents), as Spark's own
writers commit safely on any file system when executors are lost.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_or_shuffled
from textloom.llm.tokens import default_path, encoder, with_ends

MAGIC, VERSION = b"TLBP", 1
_HEAD = struct.Struct("<4sHBBIQI")
PLANES = {"byte": 4, "bit": 32}
#: Ids of a shard, after which a new one starts at the next document: 4 MB before compression.
SHARD_IDS = 1 << 20
CHUNK_IDS = 1 << 16
FILE_SCHEMA = "part int, shard int, before long, n_ids long, blob binary, doc_ids array<bigint>, n_tokens array<bigint>"


def _planes(ids: np.ndarray, planes: int) -> np.ndarray:
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def _ids(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 4:
        return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).reshape(-1).view("<u4")


def encode_shard(ids: np.ndarray, planes: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3) -> bytes:
    """Ids (any unsigned 32-bit values, also none) as a shard."""
    k, pack = PLANES[planes], zstandard.ZstdCompressor(level=level)
    index, body, at = [], [], 0
    for start in range(0, len(ids), chunk_ids):
        chunk = np.ascontiguousarray(ids[start : start + chunk_ids], "<u4")
        frames = [pack.compress(p.tobytes()) for p in _planes(chunk, k)]
        index.append(struct.pack(f"<QII{k}I", at, len(chunk), zlib.crc32(chunk.tobytes()), *map(len, frames)))
        body += frames
        at += sum(map(len, frames))
    return b"".join([_HEAD.pack(MAGIC, VERSION, k, 0, chunk_ids, len(ids), len(index)), *index, *body])


def decode_shard(blob: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids from ``start`` up to ``stop`` of a shard. Raises ValueError on a damaged one."""
    magic, version, k, _, chunk_ids, n, chunks = _HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a shard of this format")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, "<u4")
    entry, unpack = struct.Struct(f"<QII{k}I"), zstandard.ZstdDecompressor()
    body, first, out = _HEAD.size + entry.size * chunks, start // chunk_ids, []
    for c in range(first, (stop - 1) // chunk_ids + 1):
        at, count, crc, *lengths = entry.unpack_from(blob, _HEAD.size + entry.size * c)
        at, planes = at + body, []
        for length in lengths:
            planes.append(unpack.decompress(blob[at : at + length]))
            at += length
        ids = _ids(planes, count)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {c} is damaged")
        out.append(ids)
    return np.concatenate(out)[start - first * chunk_ids : stop - first * chunk_ids]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    planes: str = "byte", shard_ids: int = SHARD_IDS, chunk_ids: int = CHUNK_IDS, level: int = 3,
) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``id_col``.

    One range shuffle of (id, text); a task then streams its documents into shards, so its memory is a
    shard and a batch. A null text counts as empty. A null id comes first; rows with equal ids stay
    neighbours, ordered by a hash of the text. An empty table gives no shard. Other columns are ignored.
    """
    tokenizer = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, counts, held = [], [], []

        def row() -> pa.RecordBatch:
            blob = encode_shard(np.concatenate(held), planes, chunk_ids, level)
            of_docs = pa.ListArray.from_arrays([0, sum(map(len, doc_ids))], pa.concat_arrays(doc_ids))
            sizes = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary()), of_docs, pa.ListArray.from_arrays([0, len(sizes)], pa.array(sizes, pa.int64()))],
                ["part", "shard", "before", "n_ids", "blob", "doc_ids", "n_tokens"],
            )

        tok = encoder(tokenizer)
        for batch in batches:
            for first, ids, at in tok.batches(batch.column(1)):
                ids, at = with_ends(ids, at, end_id)
                done = 0
                while done < len(at) - 1:
                    # up to the document that fills the shard
                    end = min(len(at) - 1, int(np.searchsorted(at, at[done] + shard_ids - size, "left")))
                    held.append(ids[at[done] : at[end]])
                    doc_ids.append(batch.column(0).slice(first + done, end - done))
                    counts.append(np.diff(at[done : end + 1]))
                    size, done = size + int(at[end] - at[done]), end
                    if size >= shard_ids:
                        yield row()
                        shard, before, size = shard + 1, before + size, 0
                        doc_ids, counts, held = [], [], []
        if doc_ids:
            yield row()
        tok.rest()

    keyed = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    tie = F.xxhash64("__text")
    keyed.repartitionByRange(F.col("__id"), tie).sortWithinPartitions("__id", tie).mapInArrow(encode, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``base``, the ids before each: those before its part, and those before it there. Parts
    are as many as tasks that wrote; their running sum is over one narrow row each."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    parts = small_or_shuffled(materialize(parts, "parts"))
    return files.join(parts, "part").withColumn("base", F.col("__base") + F.col("before")).drop("__base")


def token_documents(shards: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32, from decoded shards."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, blob, doc_ids, counts = (batch.column(k)[i] for k in range(4))
                octets, at, out = decode_shard(blob.as_py()).tobytes(), 0, []
                counts = np.array(counts.as_py(), np.int64)
                starts = np.concatenate(([0], np.cumsum(counts)))
                for at, to in zip((starts[:-1] * 4).tolist(), (starts[1:] * 4).tolist(), strict=True):
                    out.append(zlib.crc32(octets[at:to]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(base.as_py() + starts[:-1]), pa.array(counts), pa.array(out, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("base", "blob", "doc_ids", "n_tokens").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
