"""Benchmark decontamination by an FM-index per training shard.

A task gathers documents into shards of bounded size. A shard's words become symbols: words of the
test phrases by number, any other word a separator. Runs of phrase words shorter than the shortest
phrase can hold no occurrence and are left out, which keeps the index small and the result exact.
The shard's suffixes are sorted, their Burrows-Wheeler transform goes into a wavelet matrix, and all
phrases are searched backwards at once through its ranks. Occurrences are located by walking to
suffix positions sampled every :data:`SAMPLE` symbols. Overlapping occurrences are merged into
spans of words.

The phrases are a stated query set: their bytes are counted before they are sent to the tasks; a set
above :data:`PHRASE_BYTES` is dealt into parts that hold about so much each, which are searched one after
another while the documents pass through, and their spans merged. Documents are read once, without a
shuffle.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Defined cases: a null
or wordless text has no words and no hits; a null or wordless item has no phrases; equal items each
count; repeated rows give repeated results; an empty table gives an empty result; other columns are
kept or ignored as the caller says, but for those of the added ones' names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, tune, utf8

SAMPLE = 8
#: Bounds of a shard: symbols kept, words read, documents.
SHARD_SYMBOLS, SHARD_WORDS, SHARD_DOCS = 1 << 19, 1 << 22, 1 << 14
PHRASE_BYTES = 64 << 20

# A-Z to a-z; every ASCII character that is no digit or letter to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# The same words in a text whose case is kept.
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(end), end
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            s1, e1 = ones[start], ones[end]
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be smaller than all others."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        following = np.zeros(n, dtype=np.int64)
        following[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Full-text index of a sequence of symbols >= 1; 0 is added as its end."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        sampled = order % SAMPLE == 0
        self.place = np.where(sampled, np.cumsum(sampled) - 1, -1)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, a row of the array each, by backward search."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(self.place[at] < 0)
        while len(walking):
            c = self.bwt[at[walking]]
            at[walking] = self.before[c] + self.tree.rank(c, at[walking])
            steps[walking] += 1
            walking = walking[self.place[at[walking]] < 0]
        return self.samples[self.place[at]] + steps


class Phrases:
    """Windows of the test items: by length, with the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.symbols = len(self.number) + 1
        self.shortest = min(map(len, found), default=window)
        self.by_length: dict[int, tuple[np.ndarray, list[set[str]]]] = {}
        for length in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == length]
            self.by_length[length] = np.array(own, dtype=np.int64), [found[p] for p in own]


class Shard:
    """Documents whose phrase words are indexed together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.runs: list[np.ndarray] = []
        self.places: list[tuple[int, int]] = []  # document and first word of a run
        self.n_words: list[int] = []
        self.symbols = self.words = 0

    def add(self, text: bytes) -> None:
        words = words_of(text)
        doc = len(self.n_words)
        self.n_words.append(len(words))
        self.words += len(words)
        if not words or not self.phrases.by_length:
            return
        get = self.phrases.number.get
        ids = np.fromiter((get(w, 1) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 1, [0])).astype(np.int8)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start >= self.phrases.shortest:
                self.runs += (ids[start:end], np.ones(1, dtype=np.int64))
                self.places.append((doc, start))
                self.symbols += end - start + 1

    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.words >= SHARD_WORDS or len(self.n_words) >= SHARD_DOCS

    def search(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Merged spans of words, and the items found, of every document."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        items: list[set[str]] = [set() for _ in self.n_words]
        if not self.runs:
            return spans, items
        text = np.concatenate(self.runs)
        index = FMIndex(text, self.phrases.symbols)
        starts = np.concatenate(([0], np.cumsum([len(r) for r in self.runs])))[:-1:2]
        docs, firsts = (np.array(x, dtype=np.int64) for x in zip(*self.places, strict=True))
        cover = np.zeros(len(text) + 1, dtype=np.int32)
        for length, (rows, owners) in self.phrases.by_length.items():
            low, high = index.search(rows)
            count = high - low
            which = np.repeat(np.arange(len(rows)), count)
            if not len(which):
                continue
            at = index.locate(np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = docs[np.searchsorted(starts, at, side="right") - 1]
            for pair in np.unique(doc * len(rows) + which).tolist():
                items[pair // len(rows)] |= owners[pair % len(rows)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0])).astype(np.int8)))
        run = np.searchsorted(starts, edge[::2], side="right") - 1
        for start, end, r in zip(edge[::2].tolist(), edge[1::2].tolist(), run.tolist(), strict=True):
            word = int(firsts[r] + start - starts[r])
            spans[docs[r]].append((word, word + end - start))
        return spans, items


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return "".join([*kept, text[at:]])


def _merged(spans: list[tuple[int, int]], more: list[dict]) -> list[tuple[int, int]]:
    """Spans of two searches as one list of spans that do not overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*spans, *((m["start"], m["end"]) for m in more)]):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _scan(items: list[tuple[str, bytes]], window: int, text_col: str, kept: list[str], cut: bool, before: bool):
    """``before``: the rows carry what earlier parts of the phrases have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def finish(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans, found = shard.search()
            at = 0
            for batch in held:
                own = slice(at, at + batch.num_rows)
                at += batch.num_rows
                if before:
                    earlier = zip(range(own.start, own.stop), batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
                    for i, old_spans, old_items in earlier:
                        spans[i] = _merged(spans[i], old_spans)
                        found[i] |= set(old_items)
                columns = [batch.column(c) for c in kept]
                if cut and any(spans[own]):
                    texts = [cut_words(t, s) if s else t for t, s in zip(batch.column(text_col).to_pylist(), spans[own], strict=True)]
                    columns[kept.index(text_col)] = pa.array(texts, batch.column(text_col).type)
                out = [pa.array(shard.n_words[own], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans[own]], span_type), pa.array([sorted(f) for f in found[own]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *out], [*kept, "__n_words", "__spans", "__items"])

        shard, held = Shard(phrases), []
        for batch in batches:
            for text in utf8(batch.column(text_col)):
                shard.add(text)
            held.append(batch)
            if shard.full():
                yield from finish(shard, held)
                shard, held = Shard(phrases), []
        if held:
            yield from finish(shard, held)
        del shard, held
        give_back()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", keep: list[str] | None = None, cut: bool = False, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with ``__n_words``, ``__spans`` and ``__items``.

    Spans are of words, ``end`` excluded. With ``cut``, the kept text is without its spans.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    tune(docs.sparkSession)
    named = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PHRASE_BYTES))
    added = ("__n_words", "__spans", "__items")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*dict.fromkeys([*kept, text_col]))
    fields = {f.name: f for f in rows.schema.fields}
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    told = [T.StructField("__n_words", T.LongType()), T.StructField("__spans", spans), T.StructField("__items", T.ArrayType(T.StringType()))]
    for part in range(parts):
        own = named if parts == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        items = [(r[0], r[1].encode()) for r in own.collect()]
        last = part == parts - 1
        through = kept if last else list(fields)
        schema = T.StructType([*[fields[c] for c in through], *told])
        rows = rows.mapInArrow(_scan(items, window, text_col, through, cut and last, part > 0), schema)
    return rows


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in an occurrence of a ten-word window of a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("__items")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
