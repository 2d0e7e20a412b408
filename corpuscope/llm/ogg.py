"""Ogg media columns: a writer, and a reader that checks, reassembles and demultiplexes.

A file holds two logical streams: ``payload`` (packets of 8-bit samples) and ``index`` (a checksum
of every payload packet). Pages carry lacing values (255 a full segment, a smaller value ends a
packet), a page sequence number, a granule position and a checksum (polynomial 0x04c11db7, not
reflected). The reader verifies every page checksum and sequence number, joins the packets that
span pages, parts the streams by serial number and derives timestamps from granule positions: the
samples that have ended at a page, over the rate; -1 where no packet ends on a page.

The media are written to a table in the shared folder and read back from it; rows stream through
the workers, and a text is held once with its pages.

Defined cases: null and empty texts are one block of 64 zero bytes; equal texts give equal media,
since serial numbers follow from the content; a damaged page raises ``OggError``; repeated rows
stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune, utf8, written

RATE = 8000
PACKET = 4096
BLOCK = 64
_HEAD = struct.Struct("<4sBBqIIIB")
_PAYLOAD, _INDEX = b"\x01samples8", b"\x01packetcrc"
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format."""


def ogg_crc(page: bytes) -> int:
    """The Ogg checksum by zlib's: both are one polynomial, with the bits of each byte reversed."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """A logical stream's pages; ``packets``: data, and the granule position at its end.

    The first packet has a page of its own, as headers must.
    """
    out: list[bytes] = []

    def put(lacing: bytes, body: bytes, granule: int, carried: bool, last: bool) -> None:
        flags = (_CONTINUED if carried else 0) | (_FIRST if not out else 0) | (_LAST if last else 0)
        out.append(_page(serial, len(out), flags, granule, lacing, body))

    head, at = packets[0]
    put(bytes([255] * (len(head) // 255) + [len(head) % 255]), head, at, False, len(packets) == 1)
    lacing, body, granule, carried = bytearray(), bytearray(), -1, False
    for k, (data, ends) in enumerate(packets[1:], 2):
        values, seg = [255] * (len(data) // 255) + [len(data) % 255], 0
        while seg < len(values):
            room = 255 - len(lacing)
            take = values[seg : seg + room]
            lacing += bytes(take)
            body += data[seg * 255 : seg * 255 + sum(take)]
            seg += len(take)
            if seg == len(values):
                granule = ends
            done = k == len(packets) and seg == len(values)
            if len(lacing) == 255 or done:
                put(bytes(lacing), bytes(body), granule, carried, done)
                lacing, body, granule, carried = bytearray(), bytearray(), -1, seg < len(values)
    return out


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of each page, and of each packet where its page tells it (else -1).
    granules: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    open: bytearray | None = None
    ended: bool = False

    def seconds(self, rate: int) -> float:
        return max((g for g in self.granules if g >= 0), default=0) / rate


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams of a physical stream, by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one must be")
        lacing = data[at + _HEAD.size : at + _HEAD.size + segments]
        body = at + _HEAD.size + segments
        end = body + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("a page is cut off")
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("a page's checksum is wrong")
        s = streams.get(serial)
        if (s is None) != bool(flags & _FIRST):
            raise OggError("a stream must begin once")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or s.ended or bool(flags & _CONTINUED) != (s.open is not None):
            raise OggError("a page is missing")
        s.pages, s.ended = s.pages + 1, bool(flags & _LAST)
        s.granules.append(granule)
        for value in lacing:
            s.open = s.open if s.open is not None else bytearray()
            s.open += data[body : body + value]
            body += value
            if value < 255:
                s.packets.append(bytes(s.open))
                s.ends.append(-1)
                s.open = None
        if granule >= 0 and s.ends:
            s.ends[-1] = granule
        at = end
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def encode(text: bytes) -> bytes:
    """A text's media: zero-padded to a positive multiple of 64 bytes, one sample a byte."""
    padded = text + bytes(-len(text) % BLOCK if text else BLOCK)
    serial = zlib.crc32(padded) & ~1
    parts = [padded[i : i + PACKET] for i in range(0, len(padded), PACKET)]
    ends = [min(len(padded), i + PACKET) for i in range(0, len(padded), PACKET)]
    payload = pages(serial, [(_PAYLOAD + struct.pack("<IQ", RATE, len(text)), 0), *zip(parts, ends, strict=True)])
    index = pages(serial | 1, [(_INDEX, 0), (b"".join(struct.pack("<I", zlib.crc32(p)) for p in parts), len(padded))])
    # First pages come first; then the streams' pages take turns.
    rest = [p for pair in zip(payload[1:], index[1:]) for p in pair] + payload[1:][len(index) - 1 :] + index[1:][len(payload) - 1 :]
    return b"".join([payload[0], index[0], *rest])


def decode(media: bytes) -> tuple[int, bytes, Stream]:
    """The unpadded length, the payload and its stream; the index stream is checked against it."""
    found = {s.packets[0][: len(k)]: s for s in demultiplex(media).values() for k in (_PAYLOAD, _INDEX) if s.packets[0].startswith(k)}
    stream, index = found[_PAYLOAD], found[_INDEX]
    rate, n = struct.unpack_from("<IQ", stream.packets[0], len(_PAYLOAD))
    sums = b"".join(struct.pack("<I", zlib.crc32(p)) for p in stream.packets[1:])
    if rate != RATE or sums != b"".join(index.packets[1:]):
        raise OggError("the index does not fit the payload")
    return n, b"".join(stream.packets[1:]), stream


def features(payload: bytes, stream: Stream) -> str:
    """Duration by granule positions, pages, mean, root mean square and crossings of the middle."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128
    crossed = int(np.count_nonzero(np.diff(x >= 0)))
    return f"seconds={stream.seconds(RATE):.6f};pages={stream.pages};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossed}"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [encode(t) for t in utf8(batch.column("__text"))]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in utf8(batch.column("media")):
            n, payload, stream = decode(media)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, stream)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, an Ogg file in a binary column."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(_encoded, "doc_id long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """What the media hold: lengths, digests and features."""
    tune(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_decoded, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every text as Ogg media in a table, read back and described."""
    return decode_media(written(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ogg"))
