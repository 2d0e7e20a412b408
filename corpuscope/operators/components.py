"""Connected components, and cutting lineage in a shared folder."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Side tables are broadcast only below this many bytes; beyond it, joins shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of one Arrow batch handed to a Python worker: texts can be long.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="corpuscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where the source has fewer partitions (a single small file); else as it is.

    Arrow batches are bounded from here on, so that a Python worker's memory does not follow the rows or
    the length of the texts.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def texts_of(batch: pa.RecordBatch, beside: str = "text") -> Iterator[tuple]:
    """The column ``beside`` and the text ("" for null) of each row; few texts at a time are Python's."""
    at, text = batch.schema.get_field_index(beside), batch.schema.get_field_index("text")
    for low in range(0, batch.num_rows, 128):
        for x, t in zip(batch.column(at).slice(low, 128).to_pylist(), batch.column(text).slice(low, 128).to_pylist(), strict=True):
            yield x, t or ""


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def running_total(df: DataFrame, order: list[str | Column], weight: str, name: str) -> DataFrame:
    """``df`` with the total of ``weight`` up to and with each row in the order, as ``name``.

    A range sort, totals within its parts, and the parts' offsets; a window over all rows would be
    one task. Rows that tie in ``order`` have an arbitrary order among themselves.
    """
    parts = cut(df.orderBy(*order)).withColumn("__part", F.spark_partition_id())
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row a part.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").agg(F.sum(weight).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return parts.withColumn(name, F.sum(weight).over(upto)).join(offsets, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def _two(*pairs: tuple) -> Column:
    """Each row as two rows ``x.u, x.v``."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.explode(F.array(*[F.struct(col(u).alias("u"), col(v).alias("v")) for u, v in pairs])).alias("x")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, root``: the smallest node reachable by edges ``a, b``; alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        # Rows are doubled by explode, not by unions, so that a round's plan reads its table a few times only.
        both = e.select(_two(("u", "v"), ("v", "u"))).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        down = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = cut(small.select(_two((F.greatest("v", "m"), F.least("v", "m")), ("u", "m"))).select("x.*").where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not converge")
