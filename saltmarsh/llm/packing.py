"""Best-fit packing of token sequences by length patterns.

Only the histogram of piece lengths (one number a length) reaches the driver.  There the patterns of up to three lengths that
fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded down,
and what they leave is packed best-fit, still as counts of equal pieces.  The result is a plan: runs of equal sequences.  A
piece's place follows from its length and its rank among the pieces of that length, so Spark hands places out without ever
gathering a length's pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, saved, table
from .tokens import Encoder, vocabulary

LENGTH, END = 1024, 2

_encoders: dict[str, Encoder] = {}


def _pieces(path: str, length: int, end: int):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        close = np.array([end], "<u4").tobytes()
        owner, piece, start, size, ids = [], [], [], [], []
        texts = [t or "" for t in part.column(0).to_pylist()]
        for i, whole in enumerate(_encoders[path](texts)):
            whole += close
            total = len(whole) // 4
            at = 0
            for k, n in enumerate(([total % length] if total % length else []) + [length] * (total // length)):
                owner.append(i)
                piece.append(k)
                start.append(at)
                size.append(n)
                ids.append(whole[4 * at : 4 * (at + n)])
                at += n
        return pa.RecordBatch.from_arrays(
            [part.column(1).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
            names=["row", "piece", "start", "length", "ids"],
        )

    return kernel


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs without text, one row per piece: piece (from 0), start, length and ids (binary, little-endian unsigned 32-bit).

    A document is its ids and then ``end``; only one longer than ``length`` is cut, into pieces of ``length`` of which the first
    may be shorter.  Null text is empty: the one id ``end``.  Columns of these names are replaced; an empty table has no piece.
    ``path`` is the vocabulary's file on every executor.
    """
    new = ("piece", "start", "length", "ids")
    others = [c for c in docs.columns if c != "text" and c not in new]
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    out = row.mapInArrow(batches(_pieces(path, length, end), 1000), f"row {row.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids binary")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *new)


@dataclass
class Plan:
    """Runs of equal sequences: run r has count[r] sequences, and in each the pieces lengths[r] in this order."""

    lengths: list[tuple[int, ...]]
    count: list[int]

    def slots(self) -> dict[str, np.ndarray]:
        """A row for each place of each run, by length: places before it (of this length), places, sequence, step and offset.

        The place of rank g (of its length) in row r is in sequence base[r] + g - before[r].
        """
        size, many, base, offset, at = [], [], [], [], 0
        for pattern, n in zip(self.lengths, self.count, strict=True):
            begin = 0
            for x in pattern:
                size.append(x)
                many.append(n)
                base.append(at)
                offset.append(begin)
                begin += x
            at += n
        size, many, base, offset = (np.array(x, np.int64) for x in (size, many, base, offset))
        order = np.argsort(size, kind="stable")
        size, many, base, offset = size[order], many[order], base[order], offset[order]
        total = np.cumsum(many) - many
        first = np.searchsorted(size, size)
        return {"length": size, "before": total - total[first] if len(size) else total, "base": base, "offset": offset}


def patterns(length: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0, a >= 1 and a + b + c = length."""
    a, b = np.meshgrid(np.arange(1, length + 1), np.arange(length + 1), indexing="ij")
    a, b = a.reshape(-1), b.reshape(-1)
    c = length - a - b
    keep = (b <= a) & (c >= 0) & (c <= b)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def fit_repeats(histogram: np.ndarray, pattern: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes |A x - histogram|^2 small, A[l, p] = how often pattern p has length l (projected, with momentum)."""
    size = len(histogram)
    scale = max(histogram.max(), 1.0)
    h = histogram / scale
    # |A|^2 <= (most entries a pattern) * (most patterns a length, weighted): a power iteration gives a closer bound.

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(pattern.reshape(-1), np.repeat(x, pattern.shape[1]), size)
        out[0] = 0
        return out

    def backward(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0
        return y[pattern].sum(1)

    v = np.ones(len(pattern))
    for _ in range(20):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * norm)
    x = np.zeros(len(pattern))
    look, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(look - rate * backward(forward(look) - h), 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + (t - 1) / t_next * (new - x)
        x, t = new, t_next
    return x * scale


def best_fit(histogram: np.ndarray, length: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Runs of sequences for the counted pieces: longest first, each into the fullest sequences that have room for it.

    Equal pieces and equal sequences are handled as counts, so the work follows the number of lengths, not of pieces.
    """
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]
    for size in range(length, 0, -1):
        left = int(histogram[size])
        while left:
            free = next((r for r in range(size, length) if room[r]), None)
            if free is None:
                each = length // size
                for n, many in ((each, left // each), (left % each, 1)):
                    if n and many:
                        room[length - n * size].append(((size,) * n, many))
                left = 0
                continue
            held, many = room[free].pop()
            use = min(left, many)
            if many > use:
                room[free].append((held, many - use))
            room[free - size].append(((*held, size), use))
            left -= use
    runs: dict[tuple[int, ...], int] = {}
    for group in room:
        for held, many in group:
            runs[held] = runs.get(held, 0) + many
    return list(runs), list(runs.values())


def make_plan(histogram: np.ndarray, length: int = LENGTH) -> Plan:
    """histogram[l] = number of pieces of length l (0 to ``length``).

    The rounded repeats never ask for more pieces than there are: patterns are taken in order of their fitted counts, and one that
    would overdraw a length gets what is left of it.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    pattern = patterns(length)
    runs: dict[tuple[int, ...], int] = {}
    if left.any():
        x = np.floor(fit_repeats(left.astype(float), pattern) + 1e-6).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            if not x[p]:
                break
            lengths, each = np.unique(pattern[p][pattern[p] > 0], return_counts=True)
            n = int(min(x[p], (left[lengths] // each).min()))
            if n > 0:
                left[lengths] -= n * each
                runs[tuple(int(v) for v in pattern[p] if v)] = n
    more, count = best_fit(left, length)
    return Plan([*runs, *more], [*runs.values(), *count])


def pack(pieces: DataFrame, length: int = LENGTH) -> tuple[DataFrame, Plan]:
    """pieces (with a column ``length``, 1 to ``length``) with sequence_id and offset, and the plan.

    pieces is written to the shared folder, so leave out of it what is not needed beyond.  Columns of the new names are
    replaced.  Equal rows each get a place of their own; an empty table gives an empty table.
    """
    others = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    numbered = saved(pieces.select(row, F.col("length").alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "pieces")
    counts = numbered.groupBy("size", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():
        histogram[r["size"]] = r["n"]
    plan = make_plan(histogram, length)
    slots = plan.slots()

    # Ranks: those of its length in earlier parts, and in its own part (parts are small and sorted by their own task).
    by_part = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.withColumn("earlier", F.coalesce(F.sum("n").over(by_part), F.lit(0))).select("size", "part", "earlier")
    own = Window.partitionBy("size", "part").orderBy("at")
    ranked = numbered.withColumn("rank", F.row_number().over(own) - 1).join(earlier, ["size", "part"]).select("row", "size", (F.col("rank") + F.col("earlier")).alias("rank"))

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        size, rank = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        span = np.int64(1) << np.int64(48)
        at = np.searchsorted(slots["length"] * span + slots["before"], size * span + rank, "right") - 1
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(slots["base"][at] + rank - slots["before"][at]), pa.array(slots["offset"][at])], names=["row", "sequence_id", "offset"])

    out = ranked.mapInArrow(batches(kernel), f"row {ranked.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "sequence_id", "offset"), plan


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text)."""
    pieces = token_pieces(docs.select("doc_id", "text"), path or vocabulary())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)[0].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
