"""Helpers shared by the training-data operators.

Nothing outside :mod:`corpuscope.llm` imports this module.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker: whole texts can be long.
ARROW_ROWS = 256
ARROW_BYTES = 4 << 20
#: Side tables are broadcast only below this many bytes; beyond it, joins shuffle.
BROADCAST_BYTES = 32 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that memory does not follow the length of the texts.

    Python workers also get this package's place on their path (a cluster ships it by --py-files).
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where the setting is unset, a local session (one process, as in tests) gets a folder of its own;
    a cluster must name one, since its executors cannot read one another's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='corpuscope-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def packed(columns: list[str], *but: str) -> Column:
    """A struct of the columns but those that stand beside it, so that their names meet no others."""
    return F.struct(F.lit(True).alias("_"), *[c for c in columns if c not in but])


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again (survives lost executors)."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`written` wrote and nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI, and the path in it: local, HDFS or object stores alike."""
    if uri.startswith("file:"):
        path = uri[5:]
        while path.startswith("//"):
            path = path[1:]
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes | list[bytes]) -> None:
    """Write whole or not at all: a retried or doubled task leaves the same file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        for block in [data] if isinstance(data, bytes) else data:
            out.write(block)
    fs.move(part, path)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null gives empty bytes."""
    binary = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column
    for value in binary:
        yield value.as_py() or b""
    # Workers live on: what a batch took goes back to the system.
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return freed memory to the system at a task's end, where the C library can: workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- hashing of words and shingles ------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, applied to every element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longest word, in bytes, that the table of bytes by place hashes; longer ones go to xxh3.
_PLACES = 64
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)


def normal(text: bytes) -> bytes:
    """The words of an UTF-8 text (runs without ASCII white space), A-Z lower-cased, by spaces."""
    return b" ".join(text.lower().split())


def word_hashes(words: bytes) -> np.ndarray:
    """A hash for each of :func:`normal` words: sums of random values by byte and place (tabulation)."""
    data = np.frombuffer(words + b" ", dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts + 1
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    long = np.flatnonzero(lengths > _PLACES)
    if len(long):
        at = np.minimum(at, _PLACES - 1)
    h = np.add.reduceat(_TABLE[(at << 8) | data], starts)
    for i in long.tolist():
        h[i] = xxhash.xxh3_64_intdigest(words[starts[i] : ends[i]])
    return h


def shingle_hashes(words: bytes, width: int = 5) -> np.ndarray:
    """A hash for each run of ``width`` words, in order; fewer words give one for their whole sequence.

    The hashes of a run's words are combined in order by steps that are not linear, so that regular
    words give no regular hashes.
    """
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    width = min(width, len(h))
    x = h[: len(h) - width + 1] + np.uint64(width)
    for j in range(1, width):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j]
    return mix(x)


def shingles(words: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct :func:`shingle_hashes`."""
    return np.unique(shingle_hashes(words, width))
