"""Sharding by a K-d tree over document metadata.

The root holds all documents. Every node splits along its widest metadata dimension (width
relative to the root's) at a weighted median, the weight being bytes; a node that holds ``k``
shards splits its bytes ``k // 2 : k - k // 2``, until every leaf reaches the target bytes
(``total / shards``). Medians are distributed: histograms of at most :data:`BINS` bins a node are
refined until a single coordinate remains, and documents that tie on it are split by a hash, so
that one source or one value may hold any share of the rows.

Copies of a text stay together: they share the place of the one with the smallest coordinates, and
their weight is that of all. Groups of more than 1 / :data:`WHOLE` of a shard's bytes cannot stay
whole under the law that holds, ``bytes``; their copies are placed one by one. There are at most
``shards * WHOLE`` such groups.

Only the histograms (nodes x bins rows), node extents and those large groups reach the driver; their
size depends on the number of shards, never on the rows. The text is read once, for its length and
checksum; the passes of the tree read a metadata table written to the shared folder.

Defined cases: a null text counts 0 bytes (size 8, checksum 0) and equals an empty one; null metadata
takes the coordinate -1; integers of any width are coordinates (a dimension wider than 2^62 is laid out
by quarters of its values); repeated rows and equal ids are separate rows of one group; an empty table gives an
empty result; other columns of the input are ignored, so clashing names do no harm. More shards than
documents leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, discard, written

BINS = 2048
#: Ties on a coordinate are split by a hash of this many bits.
TIE_BITS = 22
CHUNKS = 64
#: A group of copies stays together up to this part of a shard.
WHOLE = 50


@dataclass
class Node:
    """A node of the tree; a leaf has ``shards == 1``."""

    first: int
    shards: int
    dim: int = 0
    cut: int = 0
    tie_cut: int = 0
    left: Node | None = None
    right: Node | None = None


def _leaf_of(node: Node, dims: list[str]) -> Column:
    """The first shard of the open or closed leaf that a row falls in, as one expression."""
    if node.left is None:
        return F.lit(node.first)
    x = F.col(dims[node.dim])
    goes_left = (x < node.cut) | ((x == node.cut) & (F.col("__tie") < node.tie_cut))
    return F.when(goes_left, _leaf_of(node.left, dims)).otherwise(_leaf_of(node.right, dims))


def _at(values: dict[int, int], shards: int) -> Column:
    """``values[__leaf]`` for a driver-side table of one entry a node."""
    return F.get(F.array(*[F.lit(values.get(i)).cast("long") for i in range(shards)]), F.col("__leaf"))


def _refine(points: DataFrame, shards: int, low: dict, width: dict, goal: dict) -> tuple[dict, dict]:
    """For each node the coordinate at which the running bytes reach ``goal``, and what is below it.

    ``points``: ``__leaf, __x, __w``; ``low`` and ``width``: the range searched, per node. A pass
    narrows it to one of BINS parts.
    """
    low, width, below = dict(low), dict(width), dict.fromkeys(goal, 0)
    while any(w > 1 for w in width.values()):
        step = {n: max(1, -(-w // BINS)) for n, w in width.items()}
        away = F.col("__x") - _at(low, shards)
        rows = (
            points.select("__leaf", "__w", away.alias("__away"), _at(width, shards).alias("__width"), _at(step, shards).alias("__step"))
            .where("__away >= 0 and __away < __width")
            .groupBy("__leaf", F.expr("__away div __step").alias("bin"))
            .agg(F.sum("__w").alias("w"))
            .collect()
        )
        bins: dict[int, list] = {n: [] for n in goal}
        for r in rows:
            bins[r["__leaf"]].append((r["bin"], r["w"]))
        for n, parts in bins.items():
            chosen = 0
            for b, w in sorted(parts):
                chosen = b
                if below[n] + w >= goal[n]:
                    break
                below[n] += w
            low[n], width[n] = low[n] + chosen * step[n], step[n]
    return low, below


def _placed_by_group(rows: DataFrame, shards: int, dims: list[str]) -> DataFrame:
    """Rows with a weight ``__w`` and a tie hash: copies of a text all lie where the least of them does."""
    key = ["__hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*dims)).alias("__at") if dims else F.lit(0).alias("__at")).where("__n > 1")
    groups = written(groups.withColumn("__bytes", F.col("__n") * F.col("size")), "kd-groups")
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [r["__hash"] for r in groups.where(F.col("__bytes") * (shards * WHOLE) > F.lit(total)).select("__hash").collect()]
    kept = groups.where(~F.col("__hash").isin(large)) if large else groups
    if kept.count() * 128 <= BROADCAST_BYTES:
        kept = F.broadcast(kept)
    # Rows of large groups take no part in the join: no key of it holds more than a part of a shard.
    alone = F.col("__hash").isin(large) if large else F.lit(False)
    joined = rows.where(~alone).join(kept, key, "left")
    one = F.col("__n").isNull()
    joined = joined.select(*key, "doc_id", *[F.when(one, F.col(d)).otherwise(F.col("__at")[d]).alias(d) for d in dims], F.when(one, F.xxhash64("doc_id", "text_crc32", *dims)).otherwise(F.xxhash64("__hash")).alias("__tie"))
    if large:
        joined = joined.unionByName(rows.where(alone).select(*key, "doc_id", *dims, F.xxhash64("doc_id", "text_crc32", *dims).alias("__tie")))
    return joined.drop("__hash").withColumns({"__w": F.col("size"), "__tie": F.shiftrightunsigned("__tie", 64 - TIE_BITS)})


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", numeric: tuple[str, ...] = ("doc_id", "n_chars"), categorical: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numeric = tuple(c for c in numeric if c in docs.columns)
    categorical = tuple(c for c in categorical if c in docs.columns)
    dims = [f"__d{i}" for i in range(len(numeric) + len(categorical))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A categorical dimension is laid out by a hash, so that no dictionary is gathered.
    coords = [F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in numeric]
    coords += [F.coalesce(F.shiftrightunsigned(F.crc32(F.col(c).cast("string").cast("binary")), 32 - TIE_BITS), F.lit(-1)) for c in categorical]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("__hash"),
        *[c.alias(d) for c, d in zip(coords, dims, strict=True)],
    )
    rows = written(rows, "kd-rows")
    points = written(_placed_by_group(rows, shards, dims), "kd-points")
    discard(rows)

    extent = [f(d).alias(f"{f.__name__}{d}") for d in dims for f in (F.min, F.max)]
    ends = points.agg(*extent).first() if dims else {}
    for d in dims:
        if ends[f"max{d}"] is not None and ends[f"max{d}"] - ends[f"min{d}"] >= 1 << 62:
            points = points.withColumn(d, F.shiftright(d, 2))
    root = Node(0, shards)
    spread: list[int] = []
    open_nodes = [root] if shards > 1 and dims else []
    while open_nodes:
        placed = points.withColumn("__leaf", _leaf_of(root, dims))
        stats = {r["__leaf"]: r for r in placed.groupBy("__leaf").agg(F.sum("__w").alias("w"), *extent).collect()}
        low, width, goal = {}, {}, {}
        for node in open_nodes:
            r = stats.get(node.first)
            if r is None:
                continue
            sizes = [r[f"max{d}"] - r[f"min{d}"] for d in dims]
            spread = spread or [max(1, s) for s in sizes]
            node.dim = max(range(len(dims)), key=lambda i: sizes[i] / spread[i])
            low[node.first], width[node.first] = r[f"min{dims[node.dim]}"], sizes[node.dim] + 1
            goal[node.first] = -(-r["w"] * (node.shards // 2) // node.shards)
        by_first = {n.first: n for n in open_nodes if n.first in goal}
        if by_first:
            dim = F.get(F.array(*dims), _at({n.first: n.dim for n in by_first.values()}, shards).cast("int"))
            split = placed.where(F.col("__leaf").isin(list(goal))).select("__leaf", "__w", "__tie", dim.alias("__x"))
            cut, below = _refine(split, shards, low, width, goal)
            ties = split.where(F.col("__x") == _at(cut, shards)).select("__leaf", "__w", F.col("__tie").alias("__x"))
            tie_cut, _ = _refine(ties, shards, dict.fromkeys(goal, 0), dict.fromkeys(goal, 1 << TIE_BITS), {n: max(0, goal[n] - below[n]) for n in goal})
            for n, node in by_first.items():
                # The hash at which the goal is reached goes left with what is below it.
                node.cut, node.tie_cut = cut[n], tie_cut[n] + 1
        opened = []
        for node in open_nodes:
            if node.first not in by_first:
                continue
            half = node.shards // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
            opened += [n for n in (node.left, node.right) if n.shards > 1]
        open_nodes = opened

    placed = points.withColumns({"shard": _leaf_of(root, dims).cast("int"), "__chunk": F.pmod(F.col("__tie"), F.lit(CHUNKS)).cast("int")})
    # Slots: rows are numbered within (shard, chunk); the chunks' starts come from shards x CHUNKS counts.
    counts = placed.groupBy("shard", "__chunk").agg(F.count(F.lit(1)).alias("n")).collect()
    starts, at = [], {}
    for r in sorted(counts):
        starts.append((r["shard"], r["__chunk"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("__chunk", T.IntegerType()), T.StructField("__start", T.LongType())])
    start = docs.sparkSession.createDataFrame(starts, schema)
    order = Window.partitionBy("shard", "__chunk").orderBy("doc_id", "text_crc32", "size", *dims)
    numbered = placed.join(F.broadcast(start), ["shard", "__chunk"]).withColumn("slot", F.col("__start") + F.row_number().over(order) - 1)
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
