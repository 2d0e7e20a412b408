"""Near-duplicates by one-permutation MinHash and banding.

Signatures are made in one Arrow pass. A band without an empty bin is a bucket key. In a bucket the
first member is the anchor: members that match it are done, the others form a bucket around the next
one, to the last. The first anchor of all buckets is compared by joins, so that a flood of copies costs
one comparison a copy. What is left of a bucket of up to ``block`` members is finished within one
task; of a larger one, a block of members gives the next anchors and all later members, in chunks, are
compared with those in their order, which is the same as one after another. No task holds more than two
blocks of signatures (512 bytes each). Components of the matches are clusters.

Defined cases: any type of doc_id; rows are told apart by their place in the input, so repeated and null
ids are documents of their own, and "first" is the input's order; null and short texts are ``short``; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, cut, give_back, running_total, spread, texts_of
from .signals import words_of

SHINGLE, BINS, BANDS, MIN_SHINGLES = 5, 64, 16, 10
ROWS = BINS // BANDS
BLOCK = 4096


@dataclass
class NearDuplicates:
    """Rows of :func:`find_near_duplicates`, and the comparisons made for them (one a bucket and pair)."""

    rows: DataFrame
    pairs_checked: int


def signature(words: list[str]) -> np.ndarray | None:
    """Smallest value per bin; -1 in empty bins; None below ten distinct shingles.

    A shingle's hash is the first 64 bits of its MD5, which SQL has too.
    """
    grams = {" ".join(g) for g in zip(*(words[i:] for i in range(SHINGLE)))}
    if len(grams) < MIN_SHINGLES:
        return None
    digests = b"".join([hashlib.md5(g.encode("utf-8", "replace"), usedforsecurity=False).digest() for g in grams])
    h = np.frombuffer(digests, dtype=">u8")[::2].astype(np.uint64)
    out = np.full(BINS, np.iinfo(np.int64).max, dtype=np.int64)
    np.minimum.at(out, (h % np.uint64(BINS)).astype(np.int64), (h // np.uint64(BINS)).astype(np.int64))
    out[out == np.iinfo(np.int64).max] = -1
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [signature(words_of(t)) for _, t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([None if s is None else s.tolist() for s in sigs], pa.list_(pa.int64()))], ["row", "doc_id", "sig"])
        give_back()


def signatures(docs: DataFrame) -> DataFrame:
    """row (the place in the input), doc_id and sig (64 longs, null for short documents)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return spread(placed).mapInArrow(_signed, f"row long, doc_id {kind}, sig array<long>")


def similarity(a, b):
    """U4: agreeing filled bins over all bins."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda x: x)) / float(BINS)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, and their signatures."""
    table = table.sort_by("row").combine_chunks()
    sigs = table.column("sig").chunk(0).flatten() if table.num_rows else pa.array([], pa.int64())
    return table.column("row").to_numpy(), sigs.to_numpy(zero_copy_only=False).reshape(-1, BINS)


_FOUND = "key long, kind int, anchor long, row long, similarity double, checked long"
_MATCH, _ANCHOR, _LEFT, _COUNT = range(4)


def _told(key: int, parts: list[tuple]) -> pa.Table:
    """``parts``: kind, anchors, rows, similarities, checked."""
    sizes = [len(p[2]) for p in parts]
    columns = [np.concatenate([np.broadcast_to(p[i], (n,)) for p, n in zip(parts, sizes, strict=True)]) for i in range(5)]
    return pa.table([pa.array(np.full(sum(sizes), key), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64())], names=[f.split()[0] for f in _FOUND.split(", ")])


def _finished(threshold: float):
    """The matches of a bucket's members by one anchor after another, the anchors, and the comparisons."""

    def run(bucket: pa.Table) -> pa.Table:
        key = bucket.column("key")[0].as_py()
        rows, sigs = _matrix(bucket)
        parts, anchors, checked = [], [], 0
        while len(rows):
            anchors.append(rows[0])
            s = ((sigs[1:] == sigs[0]) & (sigs[0] >= 0)).sum(axis=1) / float(BINS)
            hit = s >= threshold
            checked += len(s)
            parts.append((_MATCH, rows[0], rows[1:][hit], s[hit], 0))
            rows, sigs = rows[1:][~hit], sigs[1:][~hit]
        return _told(key, [*parts, (_ANCHOR, 0, np.array(anchors), 0.0, 0), (_COUNT, 0, np.zeros(1, dtype=np.int64), 0.0, checked)])

    return run


def _compared(threshold: float):
    """A chunk of later members with the anchors of a block: each matches the first one that fits."""

    def run(chunk: pa.Table) -> pa.Table:
        key = chunk.column("key")[0].as_py()
        of_anchor = chunk.column("anchor").combine_chunks()
        anchors, heads = _matrix(chunk.filter(of_anchor))
        rows, sigs = _matrix(chunk.filter(pc.invert(of_anchor)))
        parts, checked = [], 0
        for anchor, head in zip(anchors.tolist(), heads, strict=True):
            s = ((sigs == head) & (head >= 0)).sum(axis=1) / float(BINS)
            hit = s >= threshold
            checked += len(s)
            parts.append((_MATCH, anchor, rows[hit], s[hit], 0))
            rows, sigs = rows[~hit], sigs[~hit]
        return _told(key, [*parts, (_LEFT, 0, rows, 0.0, 0), (_COUNT, 0, np.zeros(1, dtype=np.int64), 0.0, checked)])

    return run


def _with_size(left: DataFrame) -> DataFrame:
    """Members of buckets that still hold two, with the bucket's size."""
    return left.join(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key").select("key", "row", "n")


def _rest(left: DataFrame, full: DataFrame, threshold: float, block: int) -> list[DataFrame]:
    """``_FOUND`` rows of what the first anchors have left of the buckets ``key, row, n``, in as many turns as it takes."""
    found = []
    while True:
        signed = left.join(full, "row")
        small = signed.where(F.col("n") <= block).select("key", "row", "sig")
        found.append(cut(small.groupBy("key").applyInArrow(_finished(threshold), _FOUND)))
        large = left.where(F.col("n") > block)
        if large.isEmpty():
            return found
        # A block: the members up to the row below which half of half ... of the bucket lies. An
        # approximate quantile will do; it is a member's row, so that every turn retires an anchor.
        halves = F.percentile_approx("row", F.array(*[F.lit(0.5**i) for i in range(1, 41)]), F.lit(100_000))
        bound = large.groupBy("key").agg(halves.alias("at"), F.first("n").alias("m")).select("key", F.element_at("at", F.ceil(F.log2(F.col("m") / block)).cast("int")).alias("bound"))
        large = large.join(bound, "key")
        early = large.where("row <= bound").select("key", "row").join(full, "row")
        turn = cut(early.groupBy("key").applyInArrow(_finished(threshold), _FOUND))
        chunk = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / block)).alias("chunk")
        later = large.where("row > bound").select("key", "row", chunk)
        heads = turn.where(F.col("kind") == _ANCHOR).select("key", "row").join(later.select("key", "chunk").distinct(), "key")
        both = later.withColumn("anchor", F.lit(False)).unionByName(heads.withColumn("anchor", F.lit(True))).join(full, "row")
        compared = cut(both.groupBy("key", "chunk").applyInArrow(_compared(threshold), _FOUND))
        found += [turn, compared]
        left = cut(_with_size(compared.where(F.col("kind") == _LEFT).select("key", "row")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, block: int = BLOCK) -> NearDuplicates:
    """doc_id, cluster (null alone; 0 the largest), cluster_size, max_similarity, short."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sigs = cut(signatures(docs))
    full = sigs.where("sig is not null").select("row", "sig")
    band = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.slice("sig", b * ROWS + 1, ROWS).alias("part")) for b in range(BANDS)])).alias("x")
    keys = full.select("row", band).where(~F.exists("x.part", lambda v: v < 0)).select(F.xxhash64("x.band", "x.part").alias("key"), "row")
    first = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("anchor")).where("n > 1").select("key", "anchor")
    starred = cut(keys.join(first, "key").where("row <> anchor"))
    compared = starred.select("anchor", "row").distinct().join(full, "row").join(full.select(F.col("row").alias("anchor"), F.col("sig").alias("head")), "anchor")
    compared = compared.select("anchor", "row", similarity(F.col("sig"), F.col("head")).alias("similarity"))
    edges = cut(compared.where(F.col("similarity") >= threshold))
    checked = starred.count()
    left = cut(_with_size(starred.join(edges.select("anchor", "row"), ["anchor", "row"], "left_anti").select("key", "row")))
    if not left.isEmpty():
        for part in _rest(left, full, threshold, block):
            edges = edges.unionByName(part.where(F.col("kind") == _MATCH).select("anchor", "row", "similarity"))
            checked += part.agg(F.sum("checked")).first()[0] or 0
        edges = cut(edges.distinct())
    roots = components(edges.select(F.col("anchor").alias("a"), F.col("row").alias("b")))
    clusters = roots.groupBy("root").agg(F.count(F.lit(1)).alias("cluster_size"), F.min("node").alias("first"))
    # U8: the largest first, then by first appearance.
    numbered = running_total(clusters.withColumn("one", F.lit(1)), [F.desc("cluster_size"), F.col("first")], "one", "upto")
    numbered = numbered.select("root", "cluster_size", (F.col("upto") - 1).cast("int").alias("cluster"))
    best = edges.select(F.explode(F.array("anchor", "row")).alias("node"), "similarity").groupBy("node").agg(F.round(F.max("similarity"), 4).alias("max_similarity"))
    named = roots.join(numbered, "root").join(best, "node", "left").select(F.col("node").alias("row"), "cluster", "cluster_size", "max_similarity")
    out = sigs.select("row", "doc_id", F.col("sig").isNull().alias("short")).join(named, "row", "left")
    rows = out.select("doc_id", "cluster", F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), "short")
    return NearDuplicates(rows, checked)


def find_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of :func:`near_duplicates`."""
    return near_duplicates(docs, threshold).rows


def summary(found: NearDuplicates) -> DataFrame:
    """Compared, short, clusters, documents in clusters, what could be removed, and pairs checked."""
    zero = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    s = found.rows.agg(zero(~F.col("short")).alias("compared"), zero(F.col("short")).alias("short"), F.count_distinct("cluster").alias("clusters"), F.count("cluster").alias("in_clusters"))
    return s.withColumns({"removable": F.col("in_clusters") - F.col("clusters"), "pairs_checked": F.lit(found.pairs_checked).cast("long")})
