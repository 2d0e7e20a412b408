"""Corpus language model (N1-N9) and the surprisal family.

An interpolated trigram model with absolute discounting. In self mode every document is scored
against the corpus without itself, by subtraction: its own counts, its own continuations, and the
continuations and words that only it has.

No row stands for one n-gram. Documents are taken in blocks of about half a million words; a block's distinct
n-grams are sorted arrays (histories, and below each the words that follow it), which are cut by ranges of the
history's code into buckets and packed. A bucket's task adds up the totals of its part of the corpus and answers
every block in the order of its question, so that a block's task looks nothing up: it makes its arrays anew and reads
the answers by place. A history and all that follows it meet in one bucket, which so knows its continuations. The
memory of a task follows the block's or the bucket's size, and buckets grow in number with the corpus.

A history is told by 64 bits, the word after it by 44 more.

Documents are told apart by an integer ``doc_id``; :func:`by_row` gives one to rows of any ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LM_DISCOUNT, MIN_COVERAGE_SENTENCES, MIN_COVERAGE_SPREAD
from .components import cut, give_back, spread, texts_of
from .signals import sentences_of, words_of

#: Words of a block, and characters of the corpus for each bucket.
BLOCK_WORDS = 1 << 19
BUCKET_CHARS = 8 << 20
#: N-grams that a bucket's task sorts at once; beyond it, its table grows by merges.
AT_ONCE = 1 << 22

_M = np.uint64(0x9E3779B97F4A7C15)
_BOS = np.uint64(0x1234567)
_CHILD = 44
_CHILD_MASK = np.uint64((1 << _CHILD) - 1)
_MOST_RANKS = 1 << (64 - _CHILD)
_ZSTD = pa.Codec("zstd", compression_level=1)
_QUESTION, _RECORD, _ANSWER, _SUMS, _TOTALS = range(5)
_ROWS = "block long, bucket long, kind int, data binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _one(w: np.ndarray) -> np.ndarray:
    return _mix(w * _M + np.uint64(1))


def _two(one: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(one * _M + w + np.uint64(2))


_BOS_ONE = _one(np.array([_BOS]))
_BOS_TWO = _two(_BOS_ONE, np.array([_BOS]))


def _distinct(ranks: np.ndarray, children: np.ndarray, n_ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order as ranks and children, each pair's place among them, and their counts."""
    if n_ranks <= _MOST_RANKS:
        u, inverse, n = np.unique((ranks.astype(np.uint64) << np.uint64(_CHILD)) | children, return_inverse=True, return_counts=True)
        return (u >> np.uint64(_CHILD)).astype(np.int64), u & _CHILD_MASK, inverse, n
    order = np.lexsort((children, ranks))
    r, c = ranks[order].astype(np.int64), children[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])))
    inverse = np.empty(len(r), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return r[new], c[new], inverse, np.bincount(inverse)


@dataclass
class _Level:
    """The n-grams of a block by their histories."""

    codes: np.ndarray  # histories in order
    ranks: np.ndarray  # of each position's history
    grams: np.ndarray  # of each position's n-gram, among the distinct ones
    sizes: np.ndarray  # distinct n-grams of each history
    children: np.ndarray
    counts: np.ndarray
    ends: np.ndarray  # documents that end on the history, for those of one word


class _Block:
    """Documents of ``lengths`` words, which are ``words`` (hashes) at ``places``."""

    def __init__(self, words: np.ndarray, places: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths[lengths > 0]
        self.places, self.n = places, len(places)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64) if len(self.lengths) else np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        one = _one(words)
        codes, rank = np.unique(np.concatenate((_BOS_ONE, one)), return_inverse=True)
        self.word_ranks = rank[1:][places]
        ranks = self._before(self.word_ranks, rank[0])
        child = (words >> np.uint64(64 - _CHILD))[places]
        hist, children, grams, counts = _distinct(ranks, child, len(codes))
        last = self.starts + self.lengths - 1
        self.two = _Level(codes, ranks, grams, np.bincount(hist, minlength=len(codes)), children, counts, np.bincount(self.word_ranks[last], minlength=len(codes)))
        pair = np.empty(len(children), dtype=np.uint64)
        pair[grams] = _two(codes[ranks], words[places])
        codes, rank = np.unique(np.concatenate((_BOS_TWO, pair)), return_inverse=True)
        ranks = self._before(rank[1:][grams], rank[0])
        hist, children, grams, counts = _distinct(ranks, child, len(codes))
        self.three = _Level(codes, ranks, grams, np.bincount(hist, minlength=len(codes)), children, counts, np.zeros(len(codes), dtype=np.int64))

    def _before(self, of: np.ndarray, first: int) -> np.ndarray:
        out = np.empty_like(of)
        out[1:] = of[:-1]
        out[self.starts] = first
        return out


# --- packed arrays -----------------------------------------------------------------------------


def _small(a: np.ndarray) -> list[bytes]:
    """Counts in a byte each, those from 255 on apart."""
    return [np.minimum(a, 255).astype(np.uint8).tobytes(), a[a >= 255].astype(np.int64).tobytes()]


def _of_small(low: memoryview, high: memoryview) -> np.ndarray:
    out = np.frombuffer(low, dtype=np.uint8).astype(np.int64)
    if len(high):
        out[out == 255] = np.frombuffer(high, dtype=np.int64)
    return out


def _sorted_bytes(codes: np.ndarray) -> bytes:
    """Codes in order: their differences by byte planes."""
    if not len(codes):
        return b""
    d = np.concatenate((codes[:1], np.diff(codes)))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_sorted(data: memoryview) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _child_bytes(children: np.ndarray) -> bytes:
    """44 bits each: five planes, and one of half bytes."""
    planes = children.view(np.uint8).reshape(-1, 8)
    half = planes[:, 5]
    if len(half) % 2:
        half = np.append(half, np.uint8(0))
    return planes[:, :5].T.tobytes() + (half[::2] | (half[1::2] << 4)).tobytes()


def _of_children(data: memoryview, n: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :5] = raw[: 5 * n].reshape(5, n).T
    half = raw[5 * n :]
    out[::2, 5] = half & 15
    out[1::2, 5] = (half >> 4)[: n // 2]
    return out.view(np.uint64).ravel()


def _packed(chunks: list[bytes]) -> bytes:
    raw = np.array([len(chunks), *map(len, chunks)], dtype=np.int64).tobytes() + b"".join(chunks)
    return np.int64(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> list[memoryview]:
    raw = memoryview(_ZSTD.decompress(data[8:], int(np.frombuffer(data[:8], dtype=np.int64)[0]), asbytes=True))
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    at = np.cumsum(np.concatenate(([8 + 8 * n], np.frombuffer(raw[8 : 8 + 8 * n], dtype=np.int64)))).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _level_chunks(codes: np.ndarray, sizes: np.ndarray, children: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [_sorted_bytes(codes), *_small(sizes), _child_bytes(children), *_small(counts), *_small(ends)]


def _bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of codes."""
    return (((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _questions(levels: list[tuple], buckets: int, counted: bool = True) -> Iterator[tuple[int, bytes]]:
    """``levels`` (codes, sizes, children, counts, ends) cut into buckets; not ``counted``: asked only."""
    cuts = []
    for codes, sizes, *_ in levels:
        at = np.searchsorted(_bucket_of(codes, buckets), np.arange(buckets + 1))
        cuts.append((at, np.concatenate(([0], np.cumsum(sizes)))[at]))
    for b in range(buckets):
        chunks = []
        for (codes, sizes, children, counts, ends), (at, below) in zip(levels, cuts, strict=True):
            h, c = slice(at[b], at[b + 1]), slice(below[b], below[b + 1])
            none = counts[:0]
            chunks += _level_chunks(codes[h], sizes[h], children[c], counts[c] if counted else none, ends[h] if counted else none)
        if chunks[0] or chunks[8]:
            yield b, _packed(chunks)


# --- blocks, buckets ---------------------------------------------------------------------------


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    blocks, buckets, kinds, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "kind", "data"])


def _of_level(level: _Level) -> tuple:
    return level.codes, level.sizes, level.children, level.counts, level.ends


def _blocks(buckets: int, counted: bool, recorded: bool, words_a_block: int):
    """Questions of blocks of documents to all buckets, and the blocks themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        seen = 0
        vocabulary, docs, lengths, places = defaultdict(count().__next__), [], [], []

        def told() -> Iterator[pa.RecordBatch]:
            words = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
            at, n = np.concatenate(places), np.array(lengths, dtype=np.int64)
            block = first + seen
            rows = []
            if recorded:
                planes = at.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, : 3 if len(words) <= 1 << 24 else 4]
                rows.append((block, block % buckets, _RECORD, _packed([np.array(docs, dtype=np.int64).tobytes(), *_small(n), words.tobytes(), planes.T.tobytes()])))
            if len(at):
                both = _Block(words, at, n)
                for b, data in _questions([_of_level(both.two), _of_level(both.three)], buckets, counted):
                    rows.append((block, b, _QUESTION, data))
                    if len(rows) == 64:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

        held = 0
        for batch in batches:
            for doc, text in texts_of(batch, "doc_id"):
                words = words_of(text)
                places.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words)))
                docs.append(doc)
                lengths.append(len(words))
                held += len(words)
                if held >= words_a_block or len(docs) >= words_a_block:
                    yield from told()
                    vocabulary, docs, lengths, places, held = defaultdict(count().__next__), [], [], [], 0
                    seen += 1
        if docs:
            yield from told()
        give_back()

    return run


def _asked(data: bytes) -> list[tuple]:
    """Levels of a question: codes, sizes, children, counts, ends (the last two empty if it only asks)."""
    x = _unpacked(data)
    out = []
    for k in (0, 8):
        sizes = _of_small(x[k + 1], x[k + 2])
        out.append((_of_sorted(x[k]), sizes, _of_children(x[k + 3], int(sizes.sum())), _of_small(x[k + 4], x[k + 5]), _of_small(x[k + 6], x[k + 7])))
    return out


def _added(keys: list[np.ndarray], totals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their totals, and each key's place."""
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(totals), len(u)).astype(np.int64), inverse


def _level_sums(asked: list[tuple], at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]:
    """Histories, what follows them, of how many kinds, documents that end on them; of each question its histories' places and n-grams' totals; the table."""
    codes, places = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    places = np.split(places, np.cumsum([len(x[0]) for x in asked])[:-1])
    follow, kinds, ends = (np.zeros(len(codes), dtype=np.int64) for _ in range(3))
    for p, x in zip(places, asked, strict=True):
        if len(x[4]):
            ends[p] += x[4]
    told: list[list] = [[] for _ in asked]
    table = []
    for low in range(0, len(codes), _MOST_RANKS):
        # So few histories at a time that a key holds history and word.
        edges = [np.searchsorted(p, (low, low + _MOST_RANKS)) for p in places]
        below = [np.concatenate(([0], np.cumsum(x[1])))[e] for x, e in zip(asked, edges, strict=True)]

        def keys(i: int) -> np.ndarray:
            (a, b), (c, d) = edges[i], below[i]
            rank = (places[i][a:b] - low).astype(np.uint64) << np.uint64(_CHILD)
            return np.repeat(rank, asked[i][1][a:b]) | asked[i][2][c:d]

        def counts(i: int) -> np.ndarray:
            c, d = below[i]
            return asked[i][3][c:d] if len(asked[i][3]) else np.zeros(d - c, dtype=np.int64)

        sizes = [int(d - c) for c, d in below]
        if sum(sizes) <= at_once:
            known, total, at = _added([keys(i) for i in range(len(asked))], [counts(i) for i in range(len(asked))])
            for i, x in enumerate(np.split(total[at], np.cumsum(sizes)[:-1])):
                told[i].append(x)
        else:
            known, total = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            ks, cs, held = [], [], 0
            for i in range(len(asked)):
                ks.append(keys(i))
                cs.append(counts(i))
                held += sizes[i]
                if held >= max(at_once // 4, len(known)) or i == len(asked) - 1:
                    known, total, _ = _added([known, *ks], [total, *cs])
                    ks, cs, held = [], [], 0
            for i in range(len(asked)):
                told[i].append(total[np.searchsorted(known, keys(i))])
        rank = (known >> np.uint64(_CHILD)).astype(np.int64) + low
        follow += np.bincount(rank, total, len(codes)).astype(np.int64)
        kinds += np.bincount(rank, total > 0, len(codes)).astype(np.int64)
        table.append((rank, known & _CHILD_MASK, total))
    rank, children, total = (np.concatenate(x) for x in zip(*table)) if table else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    answers = [(follow[p], kinds[p], ends[p], np.concatenate(t) if t else np.zeros(0, dtype=np.int64)) for p, t in zip(places, told, strict=True)]
    return codes, follow, kinds, ends, answers, (rank, children, total)


def _bucket(answered: bool, kept: bool, at_once: int):
    """Totals of a bucket: its sums, ``answered``: answers to its questions and the records it was handed, ``kept``: the totals themselves."""

    def run(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        rows, asked, blocks = [], [], []
        for block, kind, data in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind == _RECORD:
                rows.append((block, b, kind, data))
            else:
                asked.append(_asked(data))
                blocks.append(block if kind == _QUESTION else None)
        del table
        chunks: list[list[bytes]] = [[] for _ in asked]
        totals: list[bytes] = []
        sums = np.zeros(6, dtype=np.int64)  # words, vocabulary, words in recurring pairs, entries, documents, first words
        if asked:
            for k in (0, 1):
                codes, follow, kinds, ends, answers, (rank, children, total) = _level_sums([x[k] for x in asked], at_once)
                for i, x in enumerate(answers):
                    chunks[i] += [y for a in x for y in _small(a)]
                some = total > 0
                if k == 0:
                    start = codes == _BOS_ONE[0]
                    words = int(((follow + ends > 0) & ~start).sum())
                    sums += (total.sum(), words, total[total > 1].sum(), words, follow[start].sum(), kinds[start].sum())
                sums[3] += some.sum()
                if kept:
                    totals += _level_chunks(codes, np.bincount(rank[some], minlength=len(codes)), children[some], total[some], ends)
        if answered:
            rows += [(block, b, _ANSWER, _packed(c)) for block, c in zip(blocks, chunks, strict=True) if block is not None]
        if kept and asked:
            rows.append((-1, b, _TOTALS, _packed(totals)))
        rows.append((-1, b, _SUMS, sums.tobytes()))
        give_back()
        return pa.Table.from_batches([_rows(rows)])

    return run


def _rebucketed(buckets: int):
    """Totals cut into other buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                rows = [(-1, b, _TOTALS, x) for b, x in _questions(_asked(data), buckets)]
                if rows:
                    yield _rows(rows)

    return run


class MismatchError(RuntimeError):
    """Documents that are not among those that the model was fitted on."""


@dataclass
class LanguageModel:
    """Sums of a corpus. ``rows``: its blocks and what the buckets answered them; ``totals``: packed totals, made when first asked for."""

    docs: DataFrame
    n_documents: int
    n_tokens: int
    vocabulary: int
    entries: int
    coverage: float
    first_types: int  # distinct first words
    rows: DataFrame | None = None
    totals: DataFrame | None = None
    audits: list = field(default_factory=list)

    def release(self) -> None:
        """Give up what was kept for scoring."""
        self.rows, self.totals, self.audits = None, None, []

    def summary(self) -> dict:
        return {"order": 3, "discount": LM_DISCOUNT, "documents": self.n_documents, "tokens": self.n_tokens, "vocabulary": self.vocabulary, "entries": self.entries, "bigram_coverage": self.coverage}


def by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents by their place in the input as ``doc_id``, with their text; and ``__row, doc_id``, their names."""
    placed = docs.withColumn("__row", F.monotonically_increasing_id())
    return spread(placed.select(F.col("__row").alias("doc_id"), "text")), placed.select("__row", "doc_id")


def named(out: DataFrame, names: DataFrame) -> DataFrame:
    """What was computed :func:`by_row`, under the documents' own ids."""
    return out.withColumnRenamed("doc_id", "__row").join(names, "__row").drop("__row")


def _buckets(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, chars // BUCKET_CHARS)


def _asking(docs: DataFrame, buckets: int, counted: bool = True, recorded: bool = True) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(buckets, counted, recorded, BLOCK_WORDS), _ROWS)


def fit(docs: DataFrame, keep_rows: bool = True, keep_totals: bool = False) -> LanguageModel:
    """The model of all documents, short and foreign ones included.

    ``keep_rows``: to score these documents, each without itself; ``keep_totals``: to score others.
    """
    rows = _asking(docs, _buckets(docs), recorded=keep_rows).groupBy("bucket").applyInArrow(_bucket(keep_rows, keep_totals, AT_ONCE), _ROWS)
    rows = cut(rows if keep_rows or keep_totals else rows.where(F.col("kind") == _SUMS))
    n, v, hits, entries, documents, first = np.sum([np.frombuffer(r[0], dtype=np.int64) for r in rows.where(F.col("kind") == _SUMS).select("data").collect()] or [np.zeros(6, dtype=np.int64)], axis=0).tolist()
    return LanguageModel(docs, documents, n, v, entries, hits / n if n else 0.0, first, rows.where(F.col("kind").isin(_RECORD, _ANSWER)) if keep_rows else None, rows.where(F.col("kind") == _TOTALS) if keep_totals else None)


def _answered(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Blocks of other documents than the model's, and the answers of the model's totals."""
    if model.totals is None:
        own = _asking(model.docs, _buckets(model.docs), recorded=False).groupBy("bucket").applyInArrow(_bucket(False, True, AT_ONCE), _ROWS)
        model.totals = cut(own.where(F.col("kind") == _TOTALS))
    buckets = _buckets(docs)
    asked = _asking(docs, buckets, counted=False).unionByName(model.totals.mapInArrow(_rebucketed(buckets), _ROWS))
    return asked.groupBy("bucket").applyInArrow(_bucket(True, False, AT_ONCE), _ROWS).where(F.col("kind").isin(_RECORD, _ANSWER))


def _own(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct ids of documents: each position's place among them, a position of each, their counts."""
    _, inverse, n = np.unique((doc << 32) | ids, return_inverse=True, return_counts=True)
    at = np.empty(len(n), dtype=np.int64)
    at[inverse] = np.arange(len(ids))
    return inverse, at, n


def _score(model: dict, loo: bool, with_bits: bool):
    """Bits per word of a block's documents, from its record and its answers."""

    def bits_of(block: _Block, two: list[np.ndarray], three: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        d = LM_DISCOUNT
        total = (two[0] + two[2])[block.word_ranks]
        n_tokens, vocabulary = np.full(block.n, model["n_tokens"]), np.full(block.n, model["vocabulary"])
        if loo:
            inverse, at, own = _own(block.doc, block.places)
            lost = np.bincount(block.doc[at[total[at] == own]], minlength=len(block.lengths))
            n_tokens, vocabulary = n_tokens - block.lengths[block.doc], vocabulary - lost[block.doc]
            total = total - own[inverse]
            if min(total.min(), n_tokens.min(), vocabulary.min()) < 0:
                raise MismatchError("a document to score is not among those that the model was fitted on, or has more words")
        p = (total + 1) / (n_tokens + vocabulary + 1)
        for level, (follow, kinds, _, totals) in ((block.two, two), (block.three, three)):
            total, ctx, types = totals[level.grams], follow[level.ranks], kinds[level.ranks]
            if level is block.two:
                known = total > 0
            if loo:
                inverse, at, own = _own(block.doc, level.grams)
                hist, _, followed = _own(block.doc, level.ranks)
                lost = np.bincount(hist[at[total[at] == own]], minlength=len(followed))
                total, ctx, types = total - own[inverse], ctx - followed[hist], types - lost[hist]
                if total.min() < 0:
                    raise MismatchError("a document to score is not among those that the model was fitted on")
            safe = np.maximum(ctx, 1).astype(np.float64)
            p = np.where(ctx > 0, np.maximum(total - d, 0) / safe + d * types / safe * p, p)
        return -np.log2(p), known

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        data = table.column("data")
        docs, low, high, words, planes = _unpacked(data[kinds.index(_RECORD)].as_py())
        docs, lengths, words = np.frombuffer(docs, dtype=np.int64), _of_small(low, high), np.frombuffer(words, dtype=np.uint64)
        n = int(lengths.sum())
        out: list[tuple] = [(None,) * 6] * len(docs)
        if n:
            wide = np.frombuffer(planes, dtype=np.uint8).reshape(-1, n).T
            places = np.zeros((n, 4), dtype=np.uint8)
            places[:, : wide.shape[1]] = wide
            block = _Block(words, places.view(np.uint32).ravel().astype(np.int64), lengths)
            buckets = table.column("bucket").to_pylist()
            parts = [_unpacked(data[i].as_py()) for i in sorted((i for i, k in enumerate(kinds) if k == _ANSWER), key=buckets.__getitem__)]
            told = [np.concatenate([_of_small(x[2 * i], x[2 * i + 1]) for x in parts]) for i in range(8)]
            bits, known = bits_of(block, told[:4], told[4:])
            ends = np.cumsum(lengths)
            for i, (b, e) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
                if b < e:
                    x = bits[b:e]
                    out[i] = (float(x.mean()), run_fraction(x), float(x.std()), e - b, int(known[b:e].sum()), x.tobytes() if with_bits else None)
        kind = [pa.float64()] * 3 + [pa.int64()] * 2 + [pa.binary()]
        made = pa.table([pa.array(docs), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kind)]], names=["doc_id", "mean_surprisal", "predictable_run_fraction", "surprisal_std", "__n", "__known", "__bits"])
        give_back()
        return made

    return run


def run_fraction(bits: np.ndarray, limit: float = 1.0, least: int = 5) -> float:
    """Share of words in runs of five or more below one bit."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.asarray(bits) < limit).astype(np.int8), [0]))))
    runs = edge[1::2] - edge[::2]
    return float(runs[runs >= least].sum() / len(bits)) if len(bits) else 0.0


def sentence_spread(text: str, bits: np.ndarray) -> float | None:
    """Spread of the means of sentences of three words or more, four at least."""
    counts = [len(words_of(s)) for s in sentences_of(text)]
    if sum(counts) != len(bits):
        return None
    ends = np.cumsum(counts)
    means = [bits[e - c : e].mean() for c, e in zip(counts, ends, strict=True) if c >= 3]
    return float(np.std(means)) if len(means) >= 4 else None


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column("__bits")
        found = [sentence_spread(text, np.frombuffer(b.as_py(), dtype=np.float64)) if b.is_valid else None for (_, text), b in zip(texts_of(batch, "doc_id"), bits, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "sentence_surprisal_std"])


def _scored(docs: DataFrame, model: LanguageModel, rows: DataFrame, loo: bool) -> DataFrame:
    with_bits = model.coverage >= MIN_COVERAGE_SENTENCES
    out = rows.groupBy("block").applyInArrow(_score({"n_tokens": model.n_tokens, "vocabulary": model.vocabulary}, loo, with_bits), "doc_id long, mean_surprisal double, predictable_run_fraction double, surprisal_std double, __n long, __known long, __bits binary")
    if not with_bits:
        return out.drop("__bits").withColumn("sentence_surprisal_std", F.lit(None).cast("double"))
    # Sentences need the texts again; only a corpus of so much coverage has this signal.
    out = cut(out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spreads = texts.join(out.select("doc_id", "__bits"), "doc_id").mapInArrow(_spreads, "doc_id long, sentence_surprisal_std double")
    return out.drop("__bits").join(spreads, "doc_id", "left")


def _audited(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Scores of other documents against the model, made once."""
    for known, out in model.audits:
        if known is docs:
            return out
    out = cut(_scored(docs, model, _answered(docs, model), False))
    model.audits = [(docs, out)]
    return out


def surprisal_signals(docs: DataFrame, model: LanguageModel, self_mode: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """N2-N4, N10-N13 of every document with words: against the corpus without it, or a reference.

    ``docs`` are scored; in self mode they are those (or some of those) that the model was fitted on,
    else a :class:`MismatchError` is raised (N6). Spread signals are withheld below the model's
    coverage gates.
    """
    if not self_mode:
        out = _audited(docs, model)
    elif model.rows is not None:
        out = _scored(docs, model, model.rows, True)
        if scored is None and docs is not model.docs:
            out = out.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    else:
        out = _scored(docs, model, _answered(docs, model), True)
    if scored is not None:
        out = out.join(scored.select("doc_id"), "doc_id", "left_semi")
    gate = lambda c, least: F.col(c) if model.coverage >= least else F.lit(None).cast("double")
    return out.select("doc_id", "mean_surprisal", "predictable_run_fraction", gate("surprisal_std", MIN_COVERAGE_SPREAD).alias("surprisal_std"), gate("sentence_surprisal_std", MIN_COVERAGE_SENTENCES).alias("sentence_surprisal_std"))


def audited_coverage(docs: DataFrame, model: LanguageModel) -> float:
    """Share of word positions whose bigram the reference has."""
    n, known = _audited(docs, model).agg(F.sum("__n"), F.sum("__known")).first()
    return known / n if n else 0.0
