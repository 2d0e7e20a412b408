"""Best-fit packing of token sequences with bounded space.

Pieces come in document order. A fixed number of bins is open; a bitset keyed by free space finds
the fullest bin that still fits with two big-integer operations. A piece that fits nowhere opens a
bin; where all are open, the fullest closes first. Only documents longer than a sequence are cut:
the first piece takes the remainder, the others are full sequences, which need no bin.

Every task packs its own part of the input in one pass, without a shuffle; its memory is the open
bins and one batch. Open bins of a task's end stay partly empty: at most ``open_bins`` a task,
whatever the input. Sequence numbers hold the task's number in their upper bits.

Defined cases: null and empty texts give the end id alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored. A lost task is packed anew to the same
result, since it reads the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .tokens import default_tokenizer, encoder, texts_of

COLUMNS = ("doc_id long", "piece int", "start long", "length long", "ids_crc32 long", "sequence_id long", "offset long")


class OpenBins:
    """Best fit over a fixed number of open bins."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        self.capacity, self.most, self.next_id = capacity, open_bins, first_id
        self.mask, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset of a piece."""
        if length == self.capacity:
            self.next_id += 1
            return self.next_id - 1, 0
        fits = self.mask >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            bin_id = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.next_id
            self.next_id += 1
        if free > length:
            self.by_free[free - length].append(bin_id)
            self.mask |= 1 << (free - length)
            self.open += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        bin_id = at.pop()
        if not at:
            self.mask ^= 1 << free
        self.open -= 1
        return bin_id


def _packed(path: str, end_id: int, capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in COLUMNS]
            for doc, data in zip(batch.column("__id").to_pylist(), enc(texts_of(batch.column("__text"))), strict=True):
                ids = memoryview(np.frombuffer(data, dtype=enc.dtype).astype("<u4").tobytes() + end)
                n = len(ids) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    length = (n % capacity or capacity) if piece == 0 else capacity
                    bin_id, offset = bins.place(length)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (doc, piece, start, length, crc, bin_id, offset), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in COLUMNS])

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    tune(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return source.mapInArrow(_packed(path, end_id, capacity, open_bins), ", ".join(COLUMNS))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
