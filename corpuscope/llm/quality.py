"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (unigrams and bigrams in :data:`BUCKETS` buckets) are
fitted: the raw one counts every n-gram of every text; the target one those of labelled good texts, beside
:data:`PRIOR_TEXTS` texts' worth of the raw model (a Dirichlet prior), so that what few labels do not show
counts as common text.
A document's importance is the ratio of the two, its log weight ``log p_target - log p_raw`` of the whole
text. Documents are drawn without replacement in proportion to it by Gumbel top-k: the k largest of log
weight plus Gumbel noise, ties cut at exactly k.

k is a parameter. Left out, it is the number of documents with words whose weight is above a border: the
weight that parts the held-out good texts best from those without quality, over ``loss_ratio`` (how much
worse it is to lose a good text than to keep a bad one). So the draw decides among documents near that
border and keeps those far above it.

Labels are a bounded sample: at most ``max_labelled`` rows, those with the smallest hash of the id. Good
texts (of quality, not toxic) of one half of it fit the target; the other half is held out, and
:func:`held_out_report` tells what the draw keeps of it.

Toxic texts can be of good quality, so they have a model of their own, fitted on the same half of the
labels: the log ratio of the shares of toxic and of clean texts that hold a word, for words that at
least ``TOXIC_TEXTS`` toxic texts hold and that are over e^``TOXIC_RATIO`` times as common there. A
text's toxicity is the sum of its distinct words' log ratios by their number; the border is the one
that parts the held-out toxic and clean texts best, and texts beyond it are not drawn. Tasks count into
arrays of fixed size; only sums of such arrays, and the labelled rows' scores, reach the driver.

Defined cases: a null or wordless text has no n-gram, the log weight 0 and is never drawn; rows with a
null id are scored, but never labelled; a label row without a document is ignored, conflicting
labels count as bad; without held-out labels of both kinds no text is beyond the border of toxicity, and
without any good label the ratio is one, so that every document with words is drawn; without held-out
good and poor ones the border is a weight of 1 / ``loss_ratio``; repeated rows have
equal weights and noise (it follows from id and text); an empty table gives an empty result; other
columns are kept, but for those of the added ones' names, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, mix, packed, tune, utf8, written

BUCKETS = 1 << 14
MAX_LABELLED = 20_000
PRIOR_TEXTS = 500
SEED = 17
#: Buckets of the words that tell toxic texts; texts that must hold a word; its least log ratio.
WORDS = 1 << 18
TOXIC_TEXTS, TOXIC_RATIO = 3, 2.0
# Tokens: runs of word characters, and runs of other characters that are no space.
_TOKEN = regex.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def _hashes(text: bytes) -> np.ndarray:
    """A hash of every token. Case is kept: shouting is a sign."""
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def _buckets(h: np.ndarray) -> np.ndarray:
    """The buckets of a text's unigrams and bigrams."""
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])
    return (np.concatenate((mix(h), pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def _words(h: np.ndarray) -> np.ndarray:
    """The buckets of a text's distinct tokens."""
    return np.unique(h % np.uint64(WORDS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's n-grams by bucket, of all texts and of those that fit the target.

    From BUCKETS on: the labelled texts by word, the toxic ones first (as ``n_raw``), then the clean.
    """
    raw, good, toxic, clean = (np.zeros(n, dtype=np.int64) for n in (BUCKETS, BUCKETS, WORDS, WORDS))
    for batch in batches:
        labels = zip(batch.column("__fit").to_pylist(), batch.column("__fit_toxic").to_pylist(), strict=True)
        for text, (fit, fit_toxic) in zip(utf8(batch.column("__text")), labels, strict=True):
            h = _hashes(text)
            n = np.bincount(_buckets(h), minlength=BUCKETS)
            raw += n
            if fit:
                good += n
            if fit_toxic is not None:
                (toxic if fit_toxic else clean)[_words(h)] += 1
    held = np.flatnonzero(toxic + clean)
    bucket = np.concatenate((np.arange(BUCKETS), BUCKETS + held)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.concatenate((raw, toxic[held]))), pa.array(np.concatenate((good, clean[held])))], ["bucket", "n_raw", "n_good"])
    give_back()


def _scored(ratio: np.ndarray, words: np.ndarray, word_ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = np.zeros(WORDS)
        toxic[words] = word_ratios
        for batch in batches:
            sums, counts, toxicity = [], [], []
            for text in utf8(batch.column("__text")):
                h = _hashes(text)
                b = _buckets(h)
                sums.append(float(ratio[b].sum()))
                counts.append(len(b))
                toxicity.append(float(toxic[_words(h)].mean()) if len(h) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.float64()), pa.array(counts, pa.int64()), pa.array(toxicity, pa.float64())], [*batch.schema.names, "__sum", "__grams", "__toxicity"])
        give_back()

    return run


def _border(rows: list[tuple[bool, float]]) -> float:
    """The value that parts good from bad labelled texts, which have the smaller ones, with the fewest errors.

    Errors weigh alike in both kinds; of borders with as few errors, the widest gap's middle.
    """
    good = np.sort([m for ok, m in rows if ok])
    bad = np.sort([m for ok, m in rows if not ok])
    if not len(good) or not len(bad):
        return 0.0
    seen = np.unique(np.concatenate((good, bad)))
    low, high = np.concatenate((seen[:1] - 1, seen[:-1])), seen
    cuts = (low + high) / 2
    errors = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(cuts[best[np.argmax((high - low)[best])]])


def _kth(values: DataFrame, k: int, passes: int = 5, bins: int = 4096) -> float:
    """The k-th largest of a column ``__key`` of doubles, by histograms that narrow down."""
    low, high = values.agg(F.min("__key"), F.max("__key")).first()
    if k <= 0 or low is None:
        return float("inf")
    above = 0
    for _ in range(passes):
        step = (high - low) / bins
        if step <= 0:
            break
        bin_of = F.least(F.floor((F.col("__key") - low) / step), F.lit(bins - 1))
        rows = dict(values.where((F.col("__key") >= low) & (F.col("__key") <= high)).groupBy(bin_of.alias("b")).agg(F.count(F.lit(1))).collect())
        for b in sorted(rows, reverse=True):
            if above + rows[b] >= k:
                low, high = low + b * step, min(high, low + (b + 1) * step)
                break
            above += rows[b]
    return low


_ADDED = ("__grams", "__log_weight", "__toxicity", "__noise", "__selected")


def _labels(labels: DataFrame, max_labelled: int, seed: int, id_col: str) -> DataFrame:
    """``__label_id``, ``q``, ``t`` and ``half`` of the sample; half 0 fits the models, half 1 is held out."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__label_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return known.orderBy(F.xxhash64("__label_id"), "__label_id").limit(max_labelled).withColumn("half", F.pmod(F.xxhash64("__label_id", F.lit(seed)), F.lit(2)))


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labelled: int = MAX_LABELLED, loss_ratio: float = 10.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``__grams, __log_weight, __toxicity, __noise, __selected``."""
    spark = docs.sparkSession
    tune(spark)
    # The input's columns are packed, so that their names meet no others.
    columns = [c for c in docs.columns if c not in _ADDED]
    docs = docs.select(packed(columns, text_col).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    known = _labels(labels, max_labelled, seed, id_col)
    fit = (F.col("q") > 0) & (F.col("t") == 0) & (F.col("half") == 0)
    fit_toxic, held_toxic = F.when(F.col("half") == 0, F.col("t") > 0), F.when(F.col("half") == 1, F.col("t") > 0)
    # Held out: good texts, and those without quality; toxic ones of quality are in neither.
    held_good = F.when((F.col("half") == 1) & ((F.col("q") <= 0) | (F.col("t") == 0)), F.col("q") > 0)
    told = [tuple(r) for r in known.select("__label_id", fit, fit_toxic, held_toxic, held_good).collect()]
    rows = spark.createDataFrame(told, "__label_id long, __fit boolean, __fit_toxic boolean, __held_toxic boolean, __held_good boolean")
    labelled = docs.join(F.broadcast(rows), F.col("__id") == F.col("__label_id"), "left").drop("__label_id")

    counts = labelled.select("__text", "__fit", "__fit_toxic").mapInArrow(_counted, "bucket int, n_raw long, n_good long")
    totals = counts.groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_good").alias("g")).where(f"bucket < {BUCKETS} or r >= {TOXIC_TEXTS}").collect()
    n_toxic, n_clean = (sum(r[2] is kind for r in told) for kind in (True, False))
    word_ratios = {r["bucket"] - BUCKETS: math.log((r["r"] + 0.5) / (n_toxic + 1)) - math.log((r["g"] + 0.5) / (n_clean + 1)) for r in totals if r["bucket"] >= BUCKETS}
    word_ratios = {w: x for w, x in word_ratios.items() if x > TOXIC_RATIO}
    raw, good = np.ones(BUCKETS), np.zeros(BUCKETS)
    for r in totals:
        if r["bucket"] < BUCKETS:
            raw[r["bucket"]] += r["r"]
            good[r["bucket"]] += r["g"]
    raw /= raw.sum()
    n_fit = sum(bool(r[1]) for r in told)
    ratio = np.log((n_fit * good / good.sum() + PRIOR_TEXTS * raw) / (n_fit + PRIOR_TEXTS)) - np.log(raw) if good.any() else np.zeros(BUCKETS)

    schema = T.StructType([*labelled.schema.fields, T.StructField("__sum", T.DoubleType()), T.StructField("__grams", T.LongType()), T.StructField("__toxicity", T.DoubleType())])
    scored = labelled.mapInArrow(_scored(ratio, np.array(list(word_ratios), dtype=np.int64), np.array(list(word_ratios.values()))), schema)
    # Uniform in (0, 1) from 52 bits of a hash of id and text.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("__id"), F.col("__text")), 12) + 0.5) / float(1 << 52)
    scored = scored.withColumns({"__log_weight": F.when(F.col("__grams") > 0, F.col("__sum")).otherwise(0.0), "__noise": -F.log(-F.log(uniform)), "__place": F.monotonically_increasing_id()})
    scored = written(scored.drop("__sum", "__fit", "__fit_toxic", "__id"), "importance")
    held = scored.where("__held_toxic is not null and __grams > 0").select("__held_toxic", "__held_good", "__toxicity", "__log_weight").dropDuplicates().limit(4 * max_labelled).collect()

    def parted(rows: list[tuple[bool, float]], otherwise: float) -> float:
        return _border(rows) if len({kind for kind, _ in rows}) == 2 else otherwise

    most_toxic = -parted([(not r["__held_toxic"], -r["__toxicity"]) for r in held], float("-inf"))
    border = parted([(r["__held_good"], r["__log_weight"]) for r in held if r["__held_good"] is not None], 0.0)

    fits = (F.col("__grams") > 0) & (F.col("__toxicity") <= F.lit(most_toxic))
    key = F.col("__log_weight") + F.col("__noise")
    keys = scored.where(fits).select(key.alias("__key"), "__log_weight", "__place")
    if k is None:
        k = keys.where(F.col("__log_weight") > border - math.log(loss_ratio)).count()
    cut = _kth(keys, k)
    drawn = key >= F.lit(cut)
    over = keys.where(F.col("__key") >= cut).count() - k
    if over > 0:
        # Equal keys at the cut: of these, those that come first.
        least = keys.where(F.col("__key") >= cut).agg(F.min("__key")).first()[0]
        ties = keys.where(F.col("__key") == F.lit(least)).select((-F.col("__place")).cast("double").alias("__key"))
        last = _kth(ties, ties.count() - over)
        drawn = drawn & ((key > F.lit(least)) | (-F.col("__place") >= F.lit(last)))
    return scored.withColumn("__selected", fits & drawn).select(*[(F.col("__text") if c == text_col else F.col("__row")[c]).alias(c) for c in columns], *_ADDED)


def held_out_report(drawn: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Of the held-out labels, by kind (good, toxic, poor), the documents and the share that the draw keeps."""
    held = _labels(labels, max_labelled, seed, id_col).where("half = 1")
    kind = F.when(F.col("t") > 0, "toxic").when(F.col("q") > 0, "good").otherwise("poor")
    rows = drawn.join(F.broadcast(held), F.col(id_col) == F.col("__label_id"))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("documents"), F.avg(F.col("__selected").cast("double")).alias("kept"))


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's importance, and whether the draw takes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    drawn = importance_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drawn.select("doc_id", F.col("__grams").alias("n_grams"), F.round("__log_weight", 6).alias("log_weight"), F.round("__noise", 6).alias("noise"), F.col("__selected").alias("selected"))
