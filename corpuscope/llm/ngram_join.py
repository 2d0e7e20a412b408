"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets are the distinct word shingles of a text. Two sets r, s (``|r| <= |s|``) with Jaccard
similarity of at least t differ in at most ``H = (|r| + |s|) (1 - t) / (1 + t)`` tokens. Tokens are
hashed into the m segments of a size band; with more than H units of search spread over the
segments, some segment must agree: one unit on a segment finds equal subsets, two units find
subsets that differ by one token (one-deletion neighbourhoods of both sides).

* Size bands grow by 1/t. A set is indexed in its own band, and probes its own and the next lower.
* The index holds a key for every non-empty segment subset. The first segments of a band
  (``designated``) are also indexed by their one-deletion neighbourhoods.
* Allocation: a probe spends no unit on empty subsets, which all sets share. What it then lacks it
  takes as second units on the designated segments whose subsets are cheapest (fewest deletions),
  and last from empty subsets, which are indexed for that. What it has to spare it takes from the
  keys that most sets share, so that common passages cost nothing: the cost of a key is counted
  over the whole corpus.
* Candidates are verified exactly, by the whole sets.

Links are wanted as classes, so a bucket need not give all its pairs: its members are joined to the
bucket's anchor first. Where verification leaves several classes in a bucket, the allocation is made
by what the keys now cost, and every pair of a probe and an index entry of different classes is
verified: pair by pair in small buckets, in blocks of documents where many meet. Equal word
sequences are one node from the start.

Defined cases: a null or blank text has no set, is linked with nothing and is its own class; short
texts are one shingle; a row with a null id takes part in the classes but never names one (a class
of such rows alone has a null id); repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, discard, give_back, mix, normal, shingles, tune, utf8, written

#: Share of segments beyond the pigeonhole's need: what empty and costly subsets may take.
SLACK = 0.10
#: Buckets with more members than this are verified in blocks of families, not pair by pair.
HOT = 64
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 128, 100_000
#: Keys that a task deals at once, and shingles to a part of the keys.
FLUSH_KEYS, PART_SHINGLES = 300_000, 1_500_000
#: Entries of one key among the keys dealt at once from which on it is hot.
HOT_KEYS = 32

_DELETED = np.uint64(0xD6E8FEB86659FD93)
_OWN, _LOWER = 1, 2


@lru_cache(maxsize=1 << 16)
def _band(size: int, percent: int) -> int:
    """The band of a set's size; band k holds sizes from its first size up to the next band's."""
    k = 0
    while _first(k + 1, percent) <= size:
        k += 1
    return k


@lru_cache(maxsize=1 << 12)
def _first(band: int, percent: int) -> int:
    """The smallest size of a band: sizes at least t times a band's first lie in it or one below."""
    return 1 if band == 0 else _first(band - 1, percent) * 100 // percent + 1


def _most_different(sizes: int, percent: int) -> int:
    """Tokens in which two sets of ``sizes`` tokens together may differ and still be linked."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(maxsize=1 << 12)
def _segments(band: int, percent: int) -> int:
    top = _first(band + 1, percent) - 1
    most = _most_different(top + top * 100 // percent, percent)
    return most + 1 if most < 3 else int((most + 1) * (1 + SLACK)) + 2


@lru_cache(maxsize=1 << 12)
def _designated(band: int, percent: int) -> int:
    return min(_segments(band, percent), 2 + _segments(band, percent) // 25)


def _subsets(tokens: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment: the number of tokens and the sum of their hashes; and each token's segment."""
    m = _segments(band, percent)
    hashed = mix(tokens ^ np.uint64(0x5851F42D4C957F2D + band))
    segment = (hashed >> np.uint64(33)) % np.uint64(m)
    segment = segment.astype(np.int64)
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, segment, mix(hashed + np.uint64(1)))
    return np.bincount(segment, minlength=m), sums, segment


def _named(sums: np.ndarray, segments: np.ndarray, band: int, deleted: bool) -> np.ndarray:
    place = (segments.astype(np.uint64) + (np.uint64(band) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return mix(sums ^ mix(place + (_DELETED if deleted else np.uint64(0)))).view(np.int64)


def set_keys(tokens: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(role, keys, is_probe, spare)`` for the own and the next lower band.

    ``is_probe``: 0 index entry, 1 probe that the allocation may drop, 2 probe that it may not.
    Own-band keys of whole subsets serve as index entry and probe at once (1); ``spare`` is the
    number of units that may be dropped.
    """
    size = len(tokens)
    own = _band(size, percent)
    for role, band in ((_OWN, own), (_LOWER, own - 1)):
        if band < 0:
            continue
        largest = size if role == _OWN else _first(own, percent) - 1
        if largest * 100 < size * percent:
            continue
        need = _most_different(size + largest, percent) + 1
        counts, sums, segment = _subsets(tokens, band, percent)
        full = np.flatnonzero(counts)
        keys, kinds = [_named(sums[full], full, band, False)], [np.ones(len(full), dtype=np.int8)]
        lack = need - len(full)
        d = _designated(band, percent)
        chosen = np.empty(0, dtype=np.int64)
        if lack > 0:
            kinds[0][:] = 2
            able = np.flatnonzero(counts[:d])
            chosen = able[np.argsort(counts[able], kind="stable")][:lack]
            lack -= len(chosen)
        if role == _OWN or len(chosen):
            # Neighbourhoods: an index entry for every designated segment, probes for the chosen ones.
            near = np.flatnonzero(segment < d) if role == _OWN else np.flatnonzero(np.isin(segment, chosen))
            if len(near):
                hashed = mix(mix(tokens[near] ^ np.uint64(0x5851F42D4C957F2D + band)) + np.uint64(1))
                seg = segment[near]
                less = sums[seg] - hashed
                if role == _OWN:  # index: subsets of r with one token less meet whole subsets of s
                    keys.append(_named(less, seg, band, True))
                    kinds.append(np.zeros(len(near), dtype=np.int8))
                if len(chosen):  # probe: subsets of s with one token less meet whole subsets of r
                    pick = np.isin(seg, chosen)
                    keys.append(_named(less[pick], seg[pick], band, False))
                    kinds.append(np.full(int(pick.sum()), 2, dtype=np.int8))
            if len(chosen):
                keys.append(_named(sums[chosen], chosen, band, True))
                kinds.append(np.full(len(chosen), 2, dtype=np.int8))
        empty = np.flatnonzero(counts == 0)
        if len(empty) and (role == _OWN or lack > 0):
            used = np.zeros(len(empty), dtype=np.int8)
            if lack > 0:
                used[:] = 2
            keep = used > 0 if role == _LOWER else slice(None)
            keys.append(_named(sums[empty], empty, band, False)[keep])
            kinds.append(used[keep])
        yield role, np.concatenate(keys), np.concatenate(kinds), max(0, len(full) - need) if need <= len(full) else 0


def _node(words: bytes) -> tuple[int, int]:
    """128 bits of the word sequence; texts with equal sequences are one node."""
    digest = xxhash.xxh3_128_digest(words)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the set's tokens in a power of two of bits, at least one and a half a token.

    Every place where two sketches differ stands for a token that only one of the sets has, so the
    differing places are a lower bound of the sets' symmetric difference.
    """
    bits = 64
    while bits < 1.5 * len(tokens):
        bits *= 2
    odd = np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for words in map(normal, utf8(batch.column("__text"))):
            tokens = shingles(words)
            rows.append((*_node(words), len(tokens), sketch(tokens)) if words else (None, None, 0, None))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__raw"), *columns], ["id", "raw", "node", "check", "n", "bits"])


# --- keys, dealt in blocks --------------------------------------------------------------------

_BLOCK_FIELDS = ["part", "hot", "keys", "rest"]
_BLOCK_SCHEMA = "part int, hot boolean, keys binary, rest binary"
_ENTRY = np.dtype([("node", "<i8"), ("count", "<u2"), ("spare", "<u2"), ("role", "u1")])
_LOW = np.uint64((1 << 40) - 1)


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by its upper 24 bits."""
    return (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def _block(part: int, hot: bool, keys: np.ndarray, kinds: np.ndarray, owner: np.ndarray, entries: np.ndarray) -> tuple:
    """A row of one part's keys: 40 bits each (the part holds the upper ones), hot ones in full.

    Keys of one owner follow one another; an owner is told once, with the number of its keys.
    """
    edge = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]))
    counts = np.diff(edge)
    rows = entries[owner[edge[:-1]]]
    if counts.max() > 65535:  # told in several runs
        times = -(-counts // 65535)
        rows, last = np.repeat(rows, times), np.cumsum(times) - 1
        whole = np.full(len(rows), 65535)
        whole[last] = counts - (times - 1) * 65535
        counts = whole
    rows["count"] = counts
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    data = raw.tobytes() if hot else np.ascontiguousarray(raw[:, :5]).tobytes()
    rest = zstandard.ZstdCompressor(level=1).compress(len(rows).to_bytes(4, "little") + rows.tobytes() + kinds.tobytes())
    return part, hot, data, rest


def _unblock(part: int, hot: bool, data: bytes, rest: bytes) -> tuple[np.ndarray, ...]:
    """key, node, kind, role and spare of a block's keys."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if hot:
        keys = raw.view("<i8")
    else:
        wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
        wide[:, :5] = raw.reshape(-1, 5)
        keys = wide.view("<i8").ravel() | np.int64(part << 40)
    rest = zstandard.ZstdDecompressor().decompress(rest)
    n = int.from_bytes(rest[:4], "little")
    rows = np.frombuffer(rest, dtype=_ENTRY, count=n, offset=4)
    kinds = np.frombuffer(rest, dtype=np.int8, offset=4 + n * _ENTRY.itemsize)
    times = rows["count"].astype(np.int64)
    return keys, np.repeat(rows["node"], times), kinds, np.repeat(rows["role"], times), np.repeat(rows["spare"], times)


def _dealt(at: np.ndarray, to: np.ndarray, hot: bool, full: np.ndarray, kinds: np.ndarray, owner: np.ndarray, entries: np.ndarray) -> list[tuple]:
    """Blocks of the keys ``at``, by the part ``to`` which each goes."""
    if not len(at):
        return []
    by = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")
    edges = np.flatnonzero(np.diff(to[by])) + 1
    parts = to[by[np.concatenate(([0], edges))]].tolist()
    return [_block(p, hot, full[x], kinds[x], owner[x], entries) for p, x in zip(parts, np.split(at[by], edges), strict=True)]


def _blocks(found: list, parts: int) -> pa.RecordBatch:
    """The keys of some texts as a row for each part, and rows of hot keys, which are dealt by node.

    A key that many of these texts hold needs no meeting to be known as shared: its entries go
    through as they are, and two of them to the key's part, so that others are told.
    """
    keys = np.concatenate([f[0] for f in found]).view(np.uint64)
    kinds = np.concatenate([f[1] for f in found])
    entries = np.zeros(len(found), dtype=_ENTRY)
    for i, name in enumerate(("node", "role", "spare"), 2):
        entries[name] = [f[i] for f in found]
    owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    part = _place(keys, parts)
    full = (part.astype(np.uint64) << np.uint64(40)) | (keys & _LOW)
    out = []
    usual = np.ones(len(full), dtype=bool)
    # Only where some slot of a table is met that often can a key be hot.
    if np.bincount((full & np.uint64((1 << 20) - 1)).astype(np.int64)).max() >= HOT_KEYS:
        order = np.argsort(full, kind="stable")
        start = np.concatenate(([0], np.flatnonzero(np.diff(full[order])) + 1))
        counts = np.diff(np.concatenate((start, [len(full)])))
        of_hot = np.repeat(counts >= HOT_KEYS, counts)
        hot = np.sort(order[of_hot])
        usual[hot] = False
        # Two of each key's entries, a probe among them if there is one, stay with the usual ones.
        firsts = order[np.lexsort((-kinds[order], np.repeat(np.arange(len(start)), counts)))]
        for shift in (0, 1):
            usual[firsts[start[counts >= HOT_KEYS] + shift]] = True
        dealt = (mix(entries["node"].view(np.uint64))[owner[hot]] % np.uint64(parts)).astype(np.int64)
        out += _dealt(hot, dealt, True, full, kinds, owner, entries)
    at = np.flatnonzero(usual)
    out += _dealt(at, part[at], False, full, kinds, owner, entries)
    types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], _BLOCK_FIELDS)


def _keyed(percent: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class is keyed once a task; the set is bounded
        found: list = []
        rows = 0
        for batch in batches:
            for words in map(normal, utf8(batch.column("__text"))):
                if not words or (node := _node(words)[0]) in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(node)
                for role, keys, kinds, spare in set_keys(shingles(words), percent):
                    found.append((keys, kinds, node, role, min(spare, 65535)))
                    rows += len(keys)
                if rows >= FLUSH_KEYS:
                    yield _blocks(found, parts)
                    found, rows = [], 0
        if found:
            yield _blocks(found, parts)
        del found, seen
        give_back()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, node, kind, role, spare`` of the part's keys that two nodes hold, one of them as a probe."""
    held: list[tuple] = []
    through: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _BLOCK_FIELDS), strict=True):
            (through if row[1] else held).append(_unblock(*row))
    kept = [tuple(np.concatenate(c) for c in zip(*through, strict=True))] if through else []
    if held:
        key, node, kind, role, spare = (np.concatenate(c) for c in zip(*held, strict=True))
        held = []
        order = np.argsort(key, kind="stable")
        start = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1))
        nodes = node[order]
        some = (np.minimum.reduceat(nodes, start) != np.maximum.reduceat(nodes, start)) & (np.maximum.reduceat(kind[order], start) > 0)
        chosen = order[np.repeat(some, np.diff(np.concatenate((start, [len(key)]))))]
        kept.append((key[chosen], node[chosen], kind[chosen], role[chosen], spare[chosen]))
        del order, start, nodes, some, chosen
    give_back()
    if not kept:
        return
    key, node, kind, role, spare = (np.concatenate(c) for c in zip(*kept, strict=True))
    # The same class may come from several tasks: of its rows the one that drops least stays.
    order = np.lexsort((spare, -kind, role, node, key))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(node[order]) != 0) | (np.diff(role[order]) != 0)
    order = order[fresh]
    for i in range(0, len(order), 100_000):
        at = order[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at]), pa.array(kind[at]), pa.array(role[at].astype(np.int8)), pa.array(spare[at].astype(np.int32))], ["key", "hash", "kind", "role", "spare"])


# --- verification -----------------------------------------------------------------------------


def _linked(a: bytes, b: bytes, s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two texts are linked; near the threshold the words themselves are compared."""
    same = len(np.intersect1d(s, t, assume_unique=True))
    over = 100 * same - percent * (len(s) + len(t) - same)
    if abs(over) <= 400:
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
        same = len(x & y)
        over = 100 * same - percent * (len(x) + len(y) - same)
    return over >= 0


def _verified(percent: int):
    """Exact similarity of pairs (a, b); rows of one ``a`` follow one another, so its set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            links = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, (x, y) in enumerate(zip(utf8(batch.column("text_a")), utf8(batch.column("text_b")), strict=True)):
                if kept != a[i]:
                    kept, first = a[i], normal(x)
                    tokens = shingles(first)
                second = normal(y)
                links.append(_linked(first, second, tokens, shingles(second), percent))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.bool_())], ["a", "b", "linked"])

    return run


def _two(*pairs):
    """Each row as two rows ``x.u, x.v``."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.explode(F.array(*[F.struct(col(u).alias("u"), col(v).alias("v")) for u, v in pairs])).alias("x")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node of every connected component, for nodes with an edge.

    Alternating large and small stars; every round is written to the shared folder, in place of the
    one before. Only counts and checksums reach the driver.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(most_rounds):
        # Rows are doubled by explode, not by unions: a round's plan reads its table a few times only.
        both = e.select(_two(("u", "v"), ("v", "u"))).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(_two((F.greatest("v", "m"), F.least("v", "m")), ("u", "m"))).select("x.*").where("u <> v").distinct()
        seen = Observation()
        last, e = e, written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "cc")
        discard(last)
        now = seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _small(df: DataFrame, bytes_a_row: int = 48) -> DataFrame:
    """Marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out texts whose raw hash is a member's by chance."""
    for batch in batches:
        nodes = zip(batch.column("hash").to_pylist(), batch.column("check").to_pylist(), strict=True)
        own = [_node(normal(text)) == node for text, node in zip(utf8(batch.column("text")), nodes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text")], ["node", "text"]).filter(pa.array(own, pa.bool_()))


def _texts(source: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of ``nodes``: a text of each, read again by its raw hash."""
    wanted = members.join(nodes, "node", "left_semi").select("node", "hash", "check", F.col("raw").alias("__raw"))
    rows = source.join(_small(wanted, 64), "__raw").select("node", "hash", "check", F.col("__text").alias("text"))
    return written(rows.mapInArrow(_own_texts, "node long, text string").groupBy("node").agg(F.first("text").alias("text")), "texts")


def _near(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches leave a link possible: they differ in no more places than linked sets in tokens."""
    bits = members.select("node", "n", "bits")
    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("p")), "a").join(bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("q")), "b")

    def folded(x: str, to: str):
        """The longer sketch's halves laid over one another: as if made with half the bits."""
        half = F.size(to)
        return F.when(F.size(x) == 2 * half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))

    p, q = folded("p", "q"), folded("q", "p")
    differ = F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, x: n + x)
    most = (F.col("n_a") + F.col("n_b")) * (100 - percent)
    comparable = (F.size("p") <= 2 * F.size("q")) & (F.size("q") <= 2 * F.size("p"))
    return both.where(~comparable | (differ * (100 + percent) <= most)).select("a", "b")


def _judge(pairs: DataFrame, source: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of those distinct pairs that their sketches leave open, by the whole sets."""
    pairs = written(_near(pairs, members, percent), "near")
    texts = _texts(source, members, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    with_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(_small(pairs, 32), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    judged = written(with_both.mapInArrow(_verified(percent), "a long, b long, linked boolean"), "judged")
    discard(texts, pairs)
    return judged


def _fit(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``p`` and ``x`` whose sizes allow a link and of which ``p`` is the larger one."""
    larger = (F.col("x.n") < F.col("p.n")) | ((F.col("x.n") == F.col("p.n")) & (F.col("x.node") < F.col("p.node")))
    return pairs.where(larger & (100 * F.col("x.n") >= percent * F.col("p.n"))).select(F.col("p.node").alias("a"), F.col("x.node").alias("b"))


def _star(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each bucket's members with one index entry, another one each turn."""
    pick = F.min_by(F.struct("node", "n", "probe"), F.xxhash64("node", F.lit(turn))).alias("y")
    starred = rows.join(rows.where("entry").groupBy("key").agg(pick), "key").select(F.struct("node", "n", "probe", "entry").alias("z"), "y")
    # The larger of the two must be a probe, the other an entry; the anchor, an entry, may be either.
    larger = F.col("y.n") < F.col("z.n")
    larger = larger | ((F.col("y.n") == F.col("z.n")) & (F.col("y.node") < F.col("z.node")))
    fits = F.when(larger, F.col("z.probe")).otherwise(F.col("z.entry") & F.col("y.probe"))
    close = 100 * F.least("y.n", "z.n") >= percent * F.greatest("y.n", "z.n")
    starred = starred.where((F.col("y.node") != F.col("z.node")) & fits & close)
    return starred.select(F.when(larger, F.col("z.node")).otherwise(F.col("y.node")).alias("a"), F.when(larger, F.col("y.node")).otherwise(F.col("z.node")).alias("b"))


def _rest(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a probe and an index entry of different classes: what stars have left over."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"))
    marked = rows.join(sizes.groupBy("key").agg(F.max_by("comp", "members").alias("main")), "key").withColumn("minor", F.col("comp") != F.col("main"))
    probes = marked.where("probe").select("key", "minor", F.struct("node", "n", "comp").alias("p"))
    entries = marked.where("entry").select("key", "minor", F.struct("node", "n", "comp").alias("x"))
    # Pairs within a bucket's largest class are not even met: one side is always of another class.
    first = probes.drop("minor").join(entries.where("minor").drop("minor"), "key")
    second = probes.where("minor").drop("minor").join(entries.where("not minor").drop("minor"), "key")
    return _fit(first.unionByName(second).where("p.comp <> x.comp"), percent)


def _block_links(percent: int):
    """Links between documents of different classes within a block pair: a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for node, comp, text in zip(table.column("node").to_pylist(), table.column("comp").to_pylist(), table.column("text").to_pylist(), strict=True):
            rows.setdefault(node, (comp, text))
        nodes = sorted(rows)
        sets = [shingles(normal(rows[x][1].encode())) for x in nodes]
        sizes = np.array([len(t) for t in sets])
        tokens, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        # A token of one document is in no intersection; the others become columns, some at a time.
        column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[place]
        owner, column = owner[column >= 0], column[column >= 0]
        same = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
        for start in range(0, int(column.max(initial=-1)) + 1, 2048):
            here = (column >= start) & (column < start + 2048)
            part = np.zeros((len(nodes), 2048), dtype=np.float32)
            part[owner[here], column[here] - start] = 1
            same += part @ part.T
        comp = np.unique([rows[x][0] for x in nodes], return_inverse=True)[1]
        same = same.astype(np.int64)
        linked = (100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)) & (comp[:, None] < comp[None, :])
        parent, links = list(range(len(nodes))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in np.argwhere(linked).tolist():
            rx, ry = root(comp[x]), root(comp[y])
            if rx != ry:
                parent[rx] = ry
                links.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _family_links(rows: DataFrame, source: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between classes that meet in hot buckets.

    The documents of such buckets form families (components of common buckets); a family is cut
    into blocks of bounded size, each two of which are verified by one task in memory. Large
    classes have blocks of their own, and pairs within one class are left out. Nothing is emitted
    per pair: a task gets two blocks of texts and gives a spanning forest.
    """
    anchors = rows.groupBy("key").agg(F.min("node").alias("b"))
    families = components(rows.select("key", F.col("node").alias("a")).join(anchors, "key").select("a", "b"))
    texts = _texts(source, members, rows.select("node").distinct())
    members = rows.select("node", "n", "comp").distinct().join(families.withColumnRenamed("root", "family"), "node")
    classes = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"))
    members = members.join(classes, ["family", "comp"]).withColumn("pool", F.when(F.col("c") >= BLOCK_DOCS, F.col("comp")))
    pools = members.groupBy("family", "pool").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    pools = pools.withColumn("name", F.xxhash64("family", "pool", F.col("pool").isNull()))
    members = members.withColumn("name", F.xxhash64("family", "pool", F.col("pool").isNull())).join(pools.select("name", "blocks"), "name")
    members = written(members.withColumn("block", F.struct("name", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"))).select("node", "comp", "family", "pool", "block"), "members")
    blocks = members.select("family", "pool", "block").distinct()
    x = blocks.select("family", F.col("pool").alias("px"), F.col("block").alias("x"))
    y = blocks.select("family", F.col("pool").alias("py"), F.col("block").alias("y"))
    pairs = x.join(y, "family").where("x <= y and not (px is not null and py is not null and px = py)").select("x", "y")
    pairs = written(pairs, "blocks")
    sides = pairs.select("x", "y", F.col("x").alias("block")).unionByName(pairs.where("x <> y").select("x", "y", F.col("y").alias("block")))
    held = sides.join(members.select("block", "node", "comp"), "block").join(texts, "node").select("x", "y", "node", "comp", "text")
    return written(held.groupBy("x", "y").applyInArrow(_block_links(percent), "a long, b long"), "family-links")


def _buckets(source: DataFrame, percent: int, parts: int) -> DataFrame:
    """``key, hash, kind, role, spare`` of the buckets that hold two nodes and a probe."""
    blocks = source.mapInArrow(_keyed(percent, parts), _BLOCK_SCHEMA)
    return written(blocks.repartitionById(parts, "part").mapInArrow(_shared, "key long, hash long, kind byte, role byte, spare int"), "buckets")


def _allotted(rows: DataFrame) -> DataFrame:
    """Cost-based allocation: each probe drops as many keys as it has units to spare, costly ones first.

    A key's cost is its number of index entries of other classes. Keys of no cost are not among
    ``rows``; so what is dropped here was never needed.
    """
    entries = rows.where("entry").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("own"))
    total = entries.groupBy("key").agg(F.sum("own").alias("all"))
    costly = Window.partitionBy("node", "role").orderBy(F.desc("cost"), "key")
    priced = rows.where("kind = 1").join(total, "key").join(entries, ["key", "comp"], "left").withColumn("cost", F.col("all") - F.coalesce("own", F.lit(0)))
    ranked = priced.withColumn("probe", F.row_number().over(costly) > F.col("spare")).select("key", "node", "n", "comp", "role", "entry", "probe")
    return ranked.unionByName(rows.where("kind <> 1").select(*ranked.columns)).where("probe or entry")


def _classed(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: id, raw (hash of the text), n, hash and check (null without words), root, component_id.

    Rows of one class agree on root, or where that is null on hash and check.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be within [50, 100]")
    spark = docs.sparkSession
    tune(spark)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__raw"))
    described = written(source.mapInArrow(_describe, "id long, raw long, node long, check long, n long, bits array<long>"), "sets")
    classes = described.where("node is not null").groupBy(F.col("node").alias("hash"), "check").agg(F.min("id").alias("rep"))

    # A part of the keys fits a task, however many there are.
    shingles_ = described.agg(F.sum("n")).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles_ // PART_SHINGLES)), 1 << 22)
    buckets = _buckets(source.drop("__raw"), percent, parts)
    # Keys know 64 bits of a node. Should two nodes share them, each is taken to hold the keys of both.
    met = _small(buckets.select("hash").distinct(), 16)
    own = described.where("node is not null").withColumnRenamed("node", "hash").join(met, "hash", "left_semi")
    own = own.groupBy("hash", "check").agg(F.min("raw").alias("raw"), F.first("n").cast("int").alias("n"), F.first("bits").alias("bits"))
    members = written(own.withColumn("node", F.monotonically_increasing_id()), "members")
    rows = buckets.join(_small(members.select("hash", "node", "n"), 48), "hash").drop("hash").withColumns({"probe": F.col("kind") > 0, "entry": F.col("role") == _OWN})

    checked = _judge(_star(rows, 0, percent).distinct(), source, members, percent)
    roots = components(checked.where("linked"))
    # What is left: buckets whose members are in more than one class.
    named = rows.join(_small(roots, 32), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = _allotted(named.join(mixed, "key"))
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("probe").alias("probed")).where("lo <> hi and probed").select("key", "members")
    left = written(left.join(sizes, "key"), "left")
    discard(buckets)
    cold, hot = left.where(f"members <= {HOT}"), left.where(f"members > {HOT}")
    links = checked.where("linked").select("a", "b")
    more = _rest(cold, percent).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    links = links.unionByName(_judge(more, source, members, percent).where("linked").select("a", "b"))
    if hot.limit(1).count():
        links = links.unionByName(_family_links(hot, source, members, percent))
    roots = components(links)
    discard(left, checked)

    # The smallest id of each class; rows without an id name none.
    linked = members.select("node", "hash", "check").join(roots, "node").join(classes, ["hash", "check"])
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = _small(linked.select("hash", "check", "root").join(smallest, "root").select("hash", "check", "root", "component_id"), 48)
    firsts = classes.join(named, ["hash", "check"], "left").select("hash", "check", "root", F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    out = described.select("id", "raw", "n", F.col("node").alias("hash"), "check").join(firsts, ["hash", "check"], "left")
    return out.withColumn("component_id", F.when(F.col("hash").isNull(), F.col("id")).otherwise(F.col("component_id")))


def similar_classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    component_id: the smallest doc_id reachable by links of similarity >= ``percent`` / 100.
    """
    return _classed(docs, percent, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_class(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest id (an id before none), then text hash.

    Rows equal in id and text are one document, and one of them stays, as it does of those without words.
    """
    classed = _classed(docs, percent, id_col, text_col)
    zero = F.lit(0).cast("long")
    told = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y"))
    id_, root, hash_, check, raw = (F.col(c) for c in ("id", "root", "hash", "check", "raw"))
    name = F.when(root.isNotNull(), told(0, root, zero)).when(hash_.isNotNull(), told(1, hash_, check)).when(id_.isNotNull(), told(2, id_, raw)).otherwise(told(3, raw, zero))
    rows = classed.select(name.alias("class"), F.struct(F.col("id").isNull().alias("none"), "id", "raw").alias("row")).groupBy("class", "row").agg(F.count(F.lit(1)).alias("copies"))
    picks = written(rows.groupBy("class").agg(F.min(F.struct("row", "copies")).alias("pick")).select(F.col("pick.row.id").alias("__pick_id"), F.col("pick.row.raw").alias("__pick_raw"), F.col("pick.copies").alias("__copies")), "picks")
    same = F.col("id").eqNullSafe(F.col("__pick_id")) & (F.col("raw") == F.col("__pick_raw"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("raw"))
    kept = keyed.join(_small(picks.where("__copies = 1"), 32), same, "left_semi")
    # Of repeated rows the first one met; only they are shuffled for it.
    again = picks.where("__copies > 1")
    if again.limit(1).count():
        kept = kept.unionByName(keyed.join(_small(again, 32), same, "left_semi").dropDuplicates(["id", "raw"]))
    return kept.select("doc.*")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, five-word shingles, similarity 0.8 or more."""
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 80)
