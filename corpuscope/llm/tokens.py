"""Token ids of whole texts by the tokenizers library, and their fixed-width bit packing.

:class:`Encoder` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. Byte-level
BPE never merges across its pre-tokens, so the ids of a pre-token are kept once the library has
encoded it; new pre-tokens of a batch are encoded together in one call and told apart by the
spaces that their first tokens begin with. Texts with characters on which Unicode versions of pre-tokenizers may differ, or
with the string of an added token, go to the library as they are.

File format (``.ids``): ``magic "CSIDS1\\0\\0" | u32 bits | u32 block ids | u64 ids | u64 blocks |
u64 block starts[blocks + 1] | blocks``. A block holds ``block ids`` ids (the last fewer), each in
``bits`` bits, least significant first, and ends on a byte; its start gives random access, and numpy
unpacks it as a whole.

Defined cases: null and empty texts give the end id alone; repeated rows are separate documents,
ties on doc_id are ordered by a hash of the text; a null doc_id sorts first; an empty table writes no file;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, filesystem, shared_dir, tune, utf8, write_file, written

MAGIC = b"CSIDS1\0\0"
BLOCK_IDS = 4096
#: Ids of one file at most, for readers' memory.
FILE_IDS = 8 << 20
#: Pre-tokens kept in a worker; beyond it, the memory starts anew.
KEPT = 600_000

# What is not among the characters that every Unicode version since 7.0 classes alike, and the
# tokenizer's own pattern in the terms of ``re``, equal to it on those characters: fixed values.
_ODD = re.compile(r"[^\x09-\x0d\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        # The tokens that begin with a space, and those that are a line feed, in byte-level letters.
        vocabulary = self.tokenizer.get_vocab()
        self.spaced, self.feeds = np.zeros((2, max(vocabulary.values()) + 1), dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.feeds[[i for t, i in vocabulary.items() if t == "\u010a"]] = True
        self.kept: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        waiting: list[tuple[int, list, list[int], list[str]]] = []
        if len(self.kept) > KEPT:
            self.kept.clear()
        get = self.kept.get
        new: set[str] = set()
        for i, text in enumerate(texts):
            if _ODD.search(text) or (self.added and self.added.search(text)):
                out[i] = self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            words = _SPLIT.findall(text)
            ids = list(map(get, words))
            if None in ids:
                holes = [k for k, x in enumerate(ids) if x is None]
                missing = [words[k] for k in holes]
                new.update(missing)
                waiting.append((i, ids, holes, missing))
            else:
                out[i] = b"".join(ids)
        # Words after a space keep their bounds when joined; the rest is encoded one by one.
        joined = [w for w in new if len(w) > 1 and w[0] == " " and w[1] != " "]
        for k in range(0, len(joined), 2000):
            self._learn("".join(joined[k : k + 2000]), joined[k : k + 2000], self.spaced, 0)
        # So do words of letters when parted by line feeds, which are no part of them.
        letters = [w for w in new if w.isalpha()]
        for k in range(0, len(letters), 2000):
            self._learn("\n" + "\n".join(letters[k : k + 2000]), letters[k : k + 2000], self.feeds, 1)
        alone = [w for w in new if w not in self.kept]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.kept[w] = self._bytes(e.ids)
        for i, ids, holes, missing in waiting:
            for k, w in zip(holes, missing, strict=True):
                ids[k] = self.kept[w]
            out[i] = b"".join(ids)
        return out

    def _learn(self, text: str, words: list[str], first: np.ndarray, skip: int) -> None:
        """Keep the words' ids: each word's begin at a token of ``first``, after ``skip`` tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        starts = np.flatnonzero(first[ids])
        if len(starts) == len(words) and starts[0] == 0:
            data, width = ids.tobytes(), self.dtype.itemsize
            at = (starts * width).tolist()
            begins = [x + skip * width for x in at] if skip else at
            self.kept.update(zip(words, map(data.__getitem__, map(slice, begins, [*at[1:], len(data)])), strict=True))

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


# --- bit packing ------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, least significant first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (spread.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def packed_file(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> list[bytes]:
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = MAGIC + struct.pack("<IIQQ", bits, block_ids, len(ids), len(blocks)) + starts.tobytes()
    return [head, *blocks]


class PackedIds:
    """Random access to a packed file: only the blocks that a range touches are read."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(32, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        self.bits, self.block_ids, self.n, blocks = struct.unpack("<IIQQ", head[8:])
        self.starts = np.frombuffer(self.file.read_at(8 * (blocks + 1), 32), dtype="<u8")
        self.body = 32 + 8 * (blocks + 1)

    def read(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        lo = int(self.starts[first])
        data = self.file.read_at(int(self.starts[last + 1]) - lo, self.body + lo)
        parts = []
        for b in range(first, last + 1):
            k = min(self.block_ids, self.n - b * self.block_ids)
            parts.append(unpack(data[int(self.starts[b]) - lo : int(self.starts[b + 1]) - lo], k, self.bits))
        return np.concatenate(parts)[start - first * self.block_ids :][:n]

    def close(self) -> None:
        self.file.close()


# --- operator ---------------------------------------------------------------------------------


def _write(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bits = bits_for(enc.vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        width = enc.dtype.itemsize
        parts: list[bytes] = []
        ids: list = []
        lens: list[int] = []
        held, k = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, ids, lens, held, k
            uri = f"{folder}/{part:06d}-{k:06d}.ids"
            write_file(uri, packed_file(np.frombuffer(b"".join(parts), dtype=enc.dtype), bits))
            at = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
            rows = pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array([k] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(at), pa.array(lens, pa.int64())], ["part", "file", "doc_id", "at", "n"])
            parts, ids, lens, held, k = [], [], [], 0, k + 1
            return rows

        for batch in batches:
            for doc, data in zip(batch.column("__id").to_pylist(), enc(texts_of(batch.column("__text"))), strict=True):
                parts += (data, end)
                ids.append(doc)
                lens.append(len(data) // width + 1)
                held += lens[-1]
                if held >= FILE_IDS:
                    yield flush()
        if ids:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the ids of all texts in ascending id order; gives the folder and its index.

    The index has a row per document: its file (part, file), place in it and number of ids, and
    ``start``, the ids of all documents before it.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = folder or shared_dir(spark, "ids")
    ordered = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # Ties are ordered by a hash: the sample that range partitioning takes must not hold texts.
    ordered = ordered.withColumn("__tie", F.xxhash64("__text")).orderBy("__id", "__tie").drop("__tie")
    index = written(ordered.mapInArrow(_write(path, end_id, folder), "part int, file int, doc_id long, at long, n long"), "ids-index")
    # Files of a task are numbered in order, and tasks too: one sum a task reaches the driver.
    files = index.groupBy("part", "file").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    tasks = sorted(files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = [(r["part"], s) for r, s in zip(tasks, itertools.accumulate((r["n"] for r in tasks), initial=0), strict=False)]
    first = spark.createDataFrame(starts, "part int, first long")
    base = files.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(first), "part").select("part", "file", (F.col("first") + F.col("own")).alias("base"))
    base = F.broadcast(base) if base.count() * 32 <= BROADCAST_BYTES else base
    index = index.join(base, ["part", "file"])
    return folder, index.withColumn("start", F.col("base") + F.col("at")).drop("base")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = batch.to_pydict()
            crc = []
            for part, k, at, n in zip(rows["part"], rows["file"], rows["at"], rows["n"], strict=True):
                if name != (part, k):
                    if file:
                        file.close()
                    name, file = (part, k), PackedIds(f"{folder}/{part:06d}-{k:06d}.ids")
                crc.append(zlib.crc32(file.read(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_ids(folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    tune(index.sparkSession)
    return index.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, written bit-packed and read back."""
    folder, index = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return read_ids(folder, index)
