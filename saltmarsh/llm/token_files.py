"""Token ids in files of patched frame-of-reference blocks.

A file is a run of whole documents in ascending doc_id order.  Its ids are cut into blocks of 128: each stores its least id, the
ids' distances from it in as many bits as a given share of them needs, and the distances that need more in a list of places and
values.  Behind the blocks stand the places at which they start, so any block can be read alone.

Layout, little-endian: 8 bytes of MAGIC; numbers of ids, documents and blocks (64 bits each); ids before the file's own among those
of its part (64); for each document its id (64), ids (64) and whether its doc_id is null (8); the blocks; their starts (64 each).
A block: least id (32), width and number of exceptions (8 each), 16 bits unused, 2 * width words of 64 bits (value i of each half
begins at bit i * width), then the exceptions' places (8 each) and distances (32 each).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, saved, table
from .tokens import Encoder, vocabulary

MAGIC = b"PFORids1"
BLOCK, HALF, END = 128, 64, 0
#: Share of a block's distances that its width holds; a file is closed when it has this many ids.
SHARE, FILE_IDS = 0.9, 1 << 20

_HEAD = struct.Struct("<8sQQQQ")
_encoders: dict[str, Encoder] = {}


def bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2**32; 0 of 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` words of 64 bits."""
    out = np.zeros((width, len(values)), "<u8")
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(HALF if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The rows of values that pack() was given."""
    columns = np.ascontiguousarray(words.T).astype(np.uint64)
    out = np.zeros((HALF, len(words)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(HALF if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' bytes, and where each starts in them.  The last block is filled up with its least id."""
    count = -(-len(ids) // BLOCK)
    filled = np.append(ids, np.full(count * BLOCK - len(ids), ids[-1] if len(ids) else 0, ids.dtype)).reshape(count, BLOCK).astype(np.int64)
    least = filled.min(1) if count else np.zeros(0, np.int64)
    distance = filled - least[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    width = bits(np.partition(distance, at, 1)[:, at]) if count else np.zeros(0, np.int64)
    outside = distance >> width[:, None] > 0
    exceptions = outside.sum(1)
    size = 8 + 16 * width + 5 * exceptions
    start = np.append(0, np.cumsum(size))
    out = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros(count, np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("unused", "<u2")]))
    head["least"], head["width"], head["exceptions"] = least, width, exceptions
    out[start[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(count, 8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        inside = np.where(outside[rows], 0, distance[rows])
        words = pack(inside.reshape(-1, HALF), w).reshape(len(rows), 2 * w)
        out[start[rows, None] + 8 + np.arange(16 * w)] = words.view(np.uint8).reshape(len(rows), 16 * w)
    block, place = np.nonzero(outside)
    behind = (start[:-1] + 8 + 16 * width)[block]
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    out[behind + nth] = place
    value = distance[block, place].astype("<u4").view(np.uint8).reshape(len(block), 4)
    out[(behind + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = value
    return out, start[:-1]


def decode_blocks(body: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of the blocks that begin at ``start``, as unsigned 32-bit numbers."""
    head = np.ascontiguousarray(body[start[:, None] + np.arange(8)]).view(np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("unused", "<u2")])).reshape(-1)
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words = np.ascontiguousarray(body[start[rows, None] + 8 + np.arange(16 * w)]).view("<u8").reshape(-1, w)
        out[rows] = unpack(words, w).reshape(len(rows), BLOCK)
    block = np.repeat(np.arange(len(start)), exceptions)
    behind = (start + 8 + 16 * width)[block]
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    value = np.ascontiguousarray(body[(behind + exceptions[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    out[block, body[behind + nth]] = value
    return (out + head["least"].astype(np.int64)[:, None]).reshape(-1)[:count].astype("<u4")


def write_file(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, before: int, share: float = SHARE) -> bytes:
    """A file of documents: their ids of ids, one after another, and how many ids of the same part stand before."""
    body, start = encode_blocks(ids, share)
    head = _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(start), before)
    table = [np.array([d or 0 for d in doc_ids], "<i8"), np.array(sizes, "<u8"), np.array([d is None for d in doc_ids], np.uint8)]
    return head + b"".join(x.tobytes() for x in table) + body.tobytes() + start.astype("<u8").tobytes()


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, numbers of ids, the ids and the ids before, of a file of write_file()."""
    magic, count, docs, blocks, before = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    raw = np.frombuffer(content, np.uint8)
    at = _HEAD.size
    doc_ids, sizes, none = (np.frombuffer(content, kind, docs, at + step * docs) for kind, step in (("<i8", 0), ("<u8", 8), ("u1", 16)))
    first, last = at + 17 * docs, len(content) - 8 * blocks
    start = np.frombuffer(content, "<u8", blocks, last).astype(np.int64)
    return [None if n else d for d, n in zip(doc_ids.tolist(), none.tolist(), strict=True)], sizes.astype(np.int64), decode_blocks(raw[first:last], start, count), before


def _writer(path: str, end: int, share: float, file_ids: int):
    """Kernel over the rows (part, doc_id, text) of a part in order: files, each with the part's number and its own in the part."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, close = _encoders[path], np.array([end], "<u4").tobytes()
        doc_ids, sizes, held, count, before, number, part = [], [], [], 0, 0, 0, 0

        def file() -> pa.RecordBatch:
            content = write_file(doc_ids, sizes, np.frombuffer(b"".join(held), "<u4"), before, share)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([count], pa.int64()), pa.array([content], pa.binary())], names=["part", "number", "n_ids", "content"])

        for batch in parts:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                part = some.column(0)[0].as_py()
                for doc_id, ids in zip(some.column(1).to_pylist(), encode([t or "" for t in some.column(2).to_pylist()]), strict=True):
                    doc_ids.append(doc_id)
                    held.append(ids + close)
                    sizes.append(len(held[-1]) // 4)
                    count += sizes[-1]
                    if count >= file_ids:
                        yield file()
                        doc_ids, sizes, held, count, before, number = [], [], [], 0, before + count, number + 1
        if doc_ids:
            yield file()

    return run


def write_token_files(docs: DataFrame, path: str | None = None, end: int = END, share: float = SHARE, file_ids: int = FILE_IDS) -> tuple[DataFrame, DataFrame]:
    """The files of docs (doc_id, text), and of each part how many ids stand before it: (part, number, n_ids, content), (part, base).

    docs is dealt out by ranges of doc_id and sorted in each part, so parts follow one another; nulls come first, then equal doc_ids by a
    hash of their text, which also parts a doc_id that very many rows have.  Null text is empty: the one id ``end``.  A document is
    never cut, so a file is as large as ``file_ids`` or its last document asks.  An empty table gives no file.  Other columns of
    docs are left out.  Both tables are in the shared folder; the driver holds one number for each part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    kernel = _writer(path or vocabulary(), end, share, file_ids)
    files = saved(dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(kernel, "part int, number int, n_ids long, content binary"), "token-files")
    base, at = [], 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base.append((r["part"], at))
        at += r["n"]
    return files, spark.createDataFrame(base, "part int, base long")


def _documents(part: pa.RecordBatch) -> pa.RecordBatch:
    doc_ids, starts, sizes, sums = [], [], [], []
    for base, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
        own, size, ids, before = read_file(content.as_py())
        stop = np.cumsum(size)
        raw = memoryview(ids.tobytes())
        doc_ids += own
        starts += (base + before + stop - size).tolist()
        sizes += size.tolist()
        sums += [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), size.tolist(), strict=True)]
    kinds = (pa.int64(),) * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((doc_ids, starts, sizes, sums), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame, bases: DataFrame) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    placed = files.select("part", "content").join(F.broadcast(bases), "part").select("base", "content")
    return placed.mapInArrow(batches(_documents, 8), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(files: DataFrame) -> DataFrame:
    """Of each document in the files: doc_id and its ids as an array."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids, offsets, flat = [], [0], []
        for content in part.column(0):
            own, size, ids, _ = read_file(content.as_py())
            doc_ids += own
            offsets += (offsets[-1] + np.cumsum(size)).tolist()
            flat.append(ids.astype(np.int64))
        whole = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole))], names=["doc_id", "ids"])

    return files.select("content").mapInArrow(batches(kernel, 1), "doc_id long, ids array<bigint>")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the files of ids, their number and checksum, read back from the files."""
    return read_documents(*write_token_files(table(spark, sf_dir, "documents")))
