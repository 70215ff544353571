"""Ogg bit streams in a binary column: pages with checksums, packets from lacing values, logical streams, granule positions.

``multiplex`` writes packets of unsigned 8-bit mono samples as two logical streams (the frames take turns), each with a PCM
header packet on its first page.  ``demultiplex`` reads any Ogg bytes: it checks every page's checksum, joins packets over pages,
sorts them by stream, and puts timestamps to them from the granule positions.  Both handle one file at a time; Spark deals the
files out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

FRAME, RATE, STREAMS, PACKETS_A_PAGE = 576, 48_000, 2, 64
CONTINUED, FIRST, LAST = 1, 2, 4

_HEADER = struct.Struct("<4sBBqIIIB")
#: PCM identification packet (big-endian): "PCM     ", version 0.0, format 1 (unsigned 8 bits), rate, bits, channels, most frames
#: a packet, number of further header packets.
_PCM = struct.Struct(">8sHHIIBBHI")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, most significant bit first, start 0) of a page whose checksum field is zero.

    zlib has the same polynomial with the bits the other way round: reverse the bits of the bytes and of the result.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lacing_of(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)


def write_stream(packets: list[bytes], granules: list[int], serial: int, header: bytes, a_page: int = PACKETS_A_PAGE) -> list[bytes]:
    """Pages of one logical stream: the header packet alone, then ``a_page`` packets a page; long packets go on over pages.

    granules[i] is the position at the end of packet i; a page on which no packet ends has the position -1.
    """
    pages = [(FIRST, 0, lacing_of([len(header)]), header)]
    for i in range(0, len(packets), a_page):
        group = packets[i : i + a_page]
        lacing, body = lacing_of([len(p) for p in group]), b"".join(group)
        ends = [k for k, x in enumerate(lacing) if x < 255]
        at = 0
        for k in range(0, len(lacing), 255):
            part = lacing[k : k + 255]
            size = sum(part)
            done = sum(e < k + len(part) for e in ends)
            here = done - sum(e < k for e in ends)
            flags = CONTINUED if k and lacing[k - 1] == 255 else 0
            pages.append((flags, granules[i + done - 1] if here else -1, part, body[at : at + size]))
            at += size
    return [page(flags | (LAST if n == len(pages) - 1 else 0), granule, serial, n, part, body) for n, (flags, granule, part, body) in enumerate(pages)]


def multiplex(payload: bytes, frame: int = FRAME, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """payload as Ogg: frame i (of ``frame`` bytes, the last one may be shorter) goes to stream i mod ``streams``.

    Serial numbers come from the payload alone, so equal payloads give equal bytes.  A granule position counts the samples of its
    own stream up to a packet's end, so the frames come in order of (their start, stream).
    """
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    serial = zlib.crc32(payload)
    header = _PCM.pack(b"PCM     ", 0, 0, 1, rate, 8, 1, frame, 0)
    logical = []
    for s in range(streams):
        own = frames[s::streams]
        logical.append(write_stream(own, np.cumsum([len(x) for x in own], dtype=np.int64).tolist(), (serial + s) & 0xFFFFFFFF, header))
    # All first pages come before any other; then the streams take turns.
    rest = [p for turn in range(1, max(map(len, logical))) for x in logical for p in x[turn : turn + 1]]
    return b"".join([x[0] for x in logical] + rest)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # at the end of each packet; -1 where the page says none
    pages: int = 0
    rate: int = 0
    width: int = 0  # bytes of a sample of all channels, 0 without a header
    headers: int = 1
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)
    _next: int | None = None


def demultiplex(media: bytes) -> tuple[list[Stream], list[str]]:
    """Logical streams in order of appearance, and what was wrong.

    A page with a wrong checksum is left out, and with it the packets that reach into it; bytes between pages are skipped to the
    next capture pattern.  Rate and sample width come from each stream's own header packet.
    """
    streams: dict[int, Stream] = {}
    wrong: list[str] = []
    at, size = 0, len(media)
    while at < size:
        if media[at : at + 4] != b"OggS":
            found = media.find(b"OggS", at + 1)
            wrong.append(f"skipped:{at}")
            at = found if found >= 0 else size
            continue
        if at + 27 > size:
            wrong.append(f"cut:{at}")
            break
        _, version, flags, granule, serial, sequence, crc, segments = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if version or len(lacing) < segments or end > size or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            wrong.append(f"checksum:{at}")
            at += 4
            continue
        s = streams.setdefault(serial, Stream(serial))
        if s._next is not None and sequence != s._next:
            wrong.append(f"lost:{serial}:{s._next}")
            s._open = []
        s._next = sequence + 1
        if flags & FIRST and s.pages:
            wrong.append(f"first:{serial}")
        body = at + 27 + segments
        skip = bool(flags & CONTINUED) and not s._open  # the rest of a packet whose beginning is lost
        if not flags & CONTINUED:
            s._open = []
        values = np.frombuffer(lacing, np.uint8)
        ends = np.flatnonzero(values < 255)
        stops = np.cumsum(values.astype(np.int64))[ends] if len(ends) else ends
        start, done = 0, 0
        for stop in stops.tolist():
            piece = media[body + start : body + stop]
            if s._open:
                piece = b"".join([*s._open, piece])
                s._open = []
            start = stop
            if skip:
                skip = False
                continue
            s.packets.append(piece)
            done += 1
        if start < end - body or (len(values) and values[-1] == 255):
            if not skip:
                s._open.append(media[body + start : end])
        s.granules += [-1] * (done - 1) + [granule] * (done > 0)
        s.pages += 1
        s.ended |= bool(flags & LAST)
        at = end
    for s in streams.values():
        if s.packets and len(s.packets[0]) == _PCM.size and s.packets[0][:8] == b"PCM     ":
            _, _, _, _, s.rate, bits, channels, _, more = _PCM.unpack(s.packets[0])
            s.width, s.headers = -(-bits // 8) * channels, 1 + more
        if not s.rate or not s.width:
            s.width = 0
            wrong.append(f"header:{s.serial}")
        if not s.ended:
            wrong.append(f"open:{s.serial}")
    return list(streams.values()), wrong


def timeline(streams: list[Stream]) -> list[tuple[float, int, float, bytes]]:
    """(seconds at the packet's start, number of the stream, seconds at its end, packet) of all data packets, in this order.

    A page tells the position of the last packet that ends on it.  Those before it end earlier by the samples of the packets
    between, which follow from their bytes and the header's sample width.  Streams without a readable header have no timestamps
    and are left out, and so are packets behind the last known position.
    """
    out = []
    for number, s in enumerate(streams):
        if not s.width:
            continue
        position: int | None = None
        for granule, packet in zip(reversed(s.granules[s.headers :]), reversed(s.packets[s.headers :]), strict=True):
            position = granule if granule >= 0 else position
            if position is not None:
                end = position
                position -= len(packet) // s.width
                out.append((position / s.rate, number, end / s.rate, packet))
    out.sort(key=lambda x: x[:3])
    return out


def describe(media: bytes) -> tuple[bytes, str]:
    """The signal read back, and a line of features: streams, pages, packets, milliseconds, level, crossings, errors."""
    streams, wrong = demultiplex(media)
    line = timeline(streams)
    signal = b"".join(p for *_, p in line)
    x = np.frombuffer(signal, np.uint8).astype(np.int16) - 128
    duration = 1000 * max((end for _, _, end, _ in line), default=0.0)
    level = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return signal, f"streams={len(streams)} pages={sum(s.pages for s in streams)} packets={len(line)} ms={duration:.3f} rms={level:.4f} crossings={crossings} errors={len(wrong)}"


def _encode(part: pa.RecordBatch) -> pa.RecordBatch:
    size, media = [], []
    for text in part.column(0).to_pylist():
        raw = text or b""
        size.append(len(raw))
        media.append(multiplex(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)))
    return pa.RecordBatch.from_arrays([part.column(1), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["row", "n_bytes", "media"])


def encode_ogg(docs: DataFrame) -> DataFrame:
    """docs without text, with ``n_bytes`` (of the UTF-8 text) and ``media``: the text as 8-bit samples in an Ogg file.

    Null text is empty; an empty text is one frame of bytes 255, and any other is filled up to whole frames of 576 with them.
    Columns of these names are replaced; repeated rows give a row each, and an empty table an empty one.
    """
    others = [c for c in docs.columns if c not in ("text", "n_bytes", "media")]
    row = docs.select(F.col("text").cast("binary").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    out = row.mapInArrow(batches(_encode, 1000), f"row {row.schema['row'].dataType.simpleString()}, n_bytes long, media binary")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "n_bytes", "media")


def _decode(part: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for media in part.column(0).to_pylist():
        if media is None:
            rows.append((None,) * 6)
            continue
        signal, feature = describe(media)
        rows.append((len(signal), hashlib.sha256(signal).hexdigest(), zlib.crc32(signal[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    return pa.RecordBatch.from_arrays([part.column(1), *[pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]], names=["row", *[n for n, _ in kinds]])


def inspect_ogg(files: DataFrame) -> DataFrame:
    """files without ``media``, with what is read back from its bytes: sizes, digests and the feature line.

    Null media gives nulls; bytes that are no Ogg give an empty signal and count as errors in the feature line.
    """
    new = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    others = [c for c in files.columns if c != "media" and c not in new]
    row = files.select("media", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    out = row.mapInArrow(batches(_decode, 1000), f"row {row.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in new.items()))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *new)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg file, and what reading the file gives."""
    return inspect_ogg(encode_ogg(table(spark, sf_dir, "documents").select("doc_id", "text")))
