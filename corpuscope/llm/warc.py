"""WARC archives with a dictionary: every record is a Zstandard frame of its own.

A file starts with a skippable frame (magic 0x184D2A5D) that embeds the dictionary, so that it can
be read alone; each record is compressed individually with it, so that any record can be read by its
offset. The dictionary is trained on a bounded sample of the archived records
(:data:`SAMPLE_RECORDS` records, of each the first :data:`SAMPLE_CHARS` characters); records are all archived whole.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest page_id is
the response, the others are revisits of it without a body. The groups are pre-aggregated by digest
(minimum and count, combined on the map side), and only digests that occur twice are joined back.

Records follow WARC/1.1: each file tells of itself in a warcinfo record; a response's block is an HTTP
response whose body is the payload, a revisit's its header alone. A record's id follows from page_id and
payload digest, so that a revisit can name the response it stands for.

Defined cases: a null html is an empty payload; a null url gives an empty target; rows that share
the smallest page_id of a group are all responses; repeated rows are equal records of one id; a null page_id never names a group (a group of
such rows has responses only); an empty table writes no file; other columns are ignored. Files are
written whole or not at all, each under the name of its task attempt, and the index is committed with
those of the attempt that counts: what a lost or doubled attempt has written is in no index.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, filesystem, shared_dir, tune, utf8, write_file, written

SKIPPABLE = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_CHARS = 512, 16 << 10
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 64 << 20
LEVEL = 3
_IDS = uuid.UUID("6f1b3a0e-8a52-4d0b-9f6e-2f8f6d1c7a10")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{digest}')}>"


def _lines(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit has no payload, and tells the length of what it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", refers_to)]
    return _lines(fields, http if refers_to is not None else http + payload)


def info(name: str, date: str) -> bytes:
    """The warcinfo record of a file."""
    block = b"format: WARC File Format 1.1\r\nsoftware: corpuscope\r\n"
    return _lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and its payload: what follows the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record's length is wrong")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where the sample is too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """Random access to a file's records."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        magic, n = struct.unpack("<II", self.file.read_at(8, 0))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} has no dictionary frame")
        data = self.file.read_at(n, 8)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdDecompressor()

    def read(self, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(self.reader.decompress(self.file.read_at(length, offset)))

    def close(self) -> None:
        self.file.close()


def _write(folder: str, dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        task = TaskContext.get()
        part, attempt, k = task.partitionId(), task.taskAttemptId(), 0
        frames, at, rows = [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal frames, at, rows, k
            name = f"{part:06d}-{attempt}-{k:05d}.warc.zst"
            first = [frame, writer.compress(info(name, date))]
            shift = sum(map(len, first))
            uri = f"{folder}/{name}"
            write_file(uri, [*first, *frames])
            out = pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), pa.array([r[0] + shift for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["file", "at", "length"])
            frames, at, rows, k = [], 0, [], k + 1
            return out

        for batch in batches:
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("__id", "__url", "__digest", "__refers_to"))
            for i, payload in enumerate(utf8(batch.column("__html"))):
                data = writer.compress(record(ids[i], urls[i], payload, digests[i], refers[i], date))
                frames.append(data)
                rows.append((at, len(data)))
                at += len(data)
                if at >= FILE_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, archive = None, None

    def page(value: str | None) -> int | None:
        return None if value in (None, "None") else int(value)

    for batch in batches:
        out = []
        for uri, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length")), strict=True):
            if name != uri:
                if archive:
                    archive.close()
                name, archive = uri, Archive(uri)
            fields, body = archive.read(at, n)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if fields["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
                raise ValueError(f"a payload in {uri} does not fit its digest")
            out.append((page(fields["X-Page-ID"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], page(fields.get("X-Refers-To-Page")), fields["WARC-Target-URI"]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])


def write_archives(pages: DataFrame, min_revisit: int = 100, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Archive all pages, as of ``date`` (else now); gives the index of records: file, at, length."""
    spark = pages.sparkSession
    tune(spark)
    folder = folder or shared_dir(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), html.alias("__html"), F.sha2(html.cast("binary"), 256).alias("__digest"))
    groups = rows.where(F.octet_length("__html") >= min_revisit).groupBy("__digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__digest", "__first")
    groups = written(groups, "warc-groups")
    if groups.count() * 256 <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    refers = F.when(F.col("__id") != F.col("__first"), F.col("__first")).when(F.col("__id").isNull(), F.col("__first"))
    rows = rows.join(groups, "__digest", "left").withColumn("__refers_to", refers)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    some = pages.select(F.col(id_col).cast("long"), url_col, F.left(html, F.lit(SAMPLE_CHARS))).limit(SAMPLE_RECORDS).collect()
    sample = [record(r[0], r[1], r[2].encode(), hashlib.sha256(r[2].encode()).hexdigest(), None, date) for r in some]
    index = rows.select("__id", "__url", "__html", "__digest", "__refers_to").mapInArrow(_write(folder, train(sample), date), "file string, at long, length long")
    return written(index, "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and target_uri of every record."""
    tune(index.sparkSession)
    return index.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index).drop("target_uri")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND p.page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
