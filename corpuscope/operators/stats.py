"""Corpus statistics (P1-P6), regression, and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import MAD_SCALE, TIERS
from ..functions import text as T
from .components import running_total


def percentile(df: DataFrame, column: str, q: float, by: list[str] | None = None) -> DataFrame:
    """The q-th percentile (0 to 100) by linear interpolation as ``percentile``; 0 when empty."""
    if not 0 <= q <= 100:
        raise ValueError("q must be within [0, 100]")
    return df.groupBy(*(by or [])).agg(F.coalesce(F.percentile(column, q / 100), F.lit(0.0)).alias("percentile"))


def describe(df: DataFrame, column: str, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """N, mean, median, stdev (population), min, p25, p75, p95, max; zeros when empty.

    ``exact=False`` takes approximate percentiles, whose memory does not grow with the distinct values.
    """
    x = F.col(column)
    pct = (lambda q: F.percentile(x, F.lit(q))) if exact else (lambda q: F.percentile_approx(x, F.lit(q), F.lit(10_000)).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [F.count(x).alias("n"), zero(F.avg(x)).alias("mean"), zero(pct(0.5)).alias("median"), zero(F.stddev_pop(x)).alias("stdev"), zero(F.min(x).cast("double")).alias("min")]
    aggs += [zero(pct(q / 100)).alias(f"p{q}") for q in (25, 75, 95)] + [zero(F.max(x).cast("double")).alias("max")]
    return df.groupBy(*(by or [])).agg(*aggs)


def median(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The median of each group as ``name``, and ``n``: exact, from value counts sorted by the engine.

    Unlike a percentile aggregate it holds no group's values in memory: a sort that can spill tells the
    middle places.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("n"))
    placed = counts.withColumn("__end", F.sum("__c").over(upto)).join(sizes, by)
    at = lambda rank: F.max(F.when((F.expr(rank) < F.col("__end")) & (F.expr(rank) >= F.col("__end") - F.col("__c")), F.col("__v")))
    middle = placed.groupBy(*by).agg(at("(n - 1) div 2").alias("__lo"), at("n div 2").alias("__hi"), F.first("n").alias("n"))
    return middle.select(*by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * 0.5).alias(name), "n")


def median_mad(df: DataFrame, by: list[str], column: str, few: bool = False) -> DataFrame:
    """F2: median, and 1.4826 times the median deviation from it, of each group.

    ``few``: the caller knows a bound of the groups, so that their medians may be broadcast.
    """
    med = median(df, by, column, "median")
    away = df.join(F.broadcast(med) if few else med, by).withColumn("__away", F.abs(F.col(column) - F.col("median")))
    return med.join(median(away, by, "__away", "__mad").drop("n"), by).select(*by, "median", (F.col("__mad") * MAD_SCALE).alias("mad"), "n")


def robust_z(value: Column, median: Column, scale: Column) -> Column:
    """0 where the scale is not positive."""
    return F.when(scale > 0, (value - median) / scale).otherwise(0.0)


def corpus_totals(view: DataFrame) -> DataFrame:
    """Documents, analysable ones, foreign ones, words."""
    return view.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("analysable").cast("long")).alias("n_analysable"), F.sum(F.col("reason").isNotNull().cast("long")).alias("n_non_english"), F.sum("n_words").cast("long").alias("n_words"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Vocabulary, words that occur once, and their ratios, over all documents."""
    counts = docs.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    s = counts.agg(F.count(F.lit(1)).alias("vocabulary_size"), F.sum((F.col("c") == 1).cast("long")).alias("hapax_count"), F.sum("c").alias("n"))
    return s.select("vocabulary_size", "hapax_count", F.round(F.col("vocabulary_size") / F.col("n"), 6).alias("corpus_ttr"), F.round(F.col("hapax_count") / F.col("vocabulary_size"), 6).alias("hapax_ratio"))


def mean_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 with ties averaged, as ``__rank``; from value counts, whose running totals no single task makes."""
    by = by or []
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__c"))
    if by:
        w = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("__upto", F.sum("__c").over(w))
    else:
        ranked = running_total(counts, [column], "__c", "__upto")
    ranked = ranked.withColumn("__rank", F.col("__upto") - (F.col("__c") - 1) / 2).drop("__upto")
    return df.join(ranked.drop("__c"), [*by, column])


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Mann-Whitney area under the curve, ties at their middle; null without both kinds."""
    ranked = mean_ranks(df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()), score)
    s = ranked.agg(F.sum(F.when(F.col(positive), F.col("__rank"))).alias("r"), F.sum(F.col(positive).cast("double")).alias("p"), F.sum((~F.col(positive)).cast("double")).alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.nullif(F.col("p") * F.col("n"), F.lit(0.0)))).alias("auc"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of tie-averaged ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    a = mean_ranks(both, x).withColumnRenamed("__rank", "__rx")
    b = mean_ranks(a, y)
    return b.agg(F.corr("__rx", "__rank").alias("rho"), F.count(F.lit(1)).alias("n"))


def tier_metrics(scored: DataFrame, positive: str, by: list[str] | None = None) -> DataFrame:
    """Recall, false-positive rate and precision at LIKELY and at any flag; prevalence."""
    likely, flagged = F.col("tier") == TIERS[0], F.col("tier").isin(*TIERS[:2])
    pos = F.col(positive)
    rate = lambda hit, of: F.avg(F.when(of, hit.cast("double")))
    return scored.where(pos.isNotNull() & (F.col("tier") != TIERS[3])).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(pos.cast("double")).alias("prevalence"),
        rate(likely, pos).alias("recall_likely"), rate(flagged, pos).alias("recall_flagged"),
        rate(likely, ~pos).alias("fpr_likely"), rate(flagged, ~pos).alias("fpr_flagged"),
        rate(pos, likely).alias("precision_likely"), rate(pos, flagged).alias("precision_flagged"),
    )


def fire_report(signals: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Of each signal the share of documents above zero, median, p95 and maximum."""
    long = signals.unpivot([*(by or [])], columns, "signal", "value").where("value is not null")
    return long.groupBy(*(by or []), "signal").agg(F.avg((F.col("value") > 0).cast("double")).alias("fires"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def cross_family(signals: DataFrame, pairs: list[tuple[str, str]], least: int = 30) -> list[tuple[str, str, float, int]]:
    """Rank correlations between signals of different families, strongest first."""
    found = []
    for a, b in pairs:
        rho, n = spearman(signals, a, b).first()
        if rho is not None and n >= least:
            found.append((a, b, rho, n))
    return sorted(found, key=lambda r: -abs(r[2]))


def contaminated_mix(df: DataFrame, positive: str, share: float, seed: int = 0) -> DataFrame:
    """E5: all negatives, and a hash sample of positives that makes up ``share`` of the mix."""
    p, n = df.agg(F.sum(F.col(positive).cast("long")), F.sum((~F.col(positive)).cast("long"))).first()
    keep = min(1.0, share / (1 - share) * (n or 0) / p) if p else 0.0
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return df.where(~F.col(positive) | (u < keep))


def failures(scored: DataFrame, positive: str, k: int = 10) -> DataFrame:
    """The k highest-scoring negatives and the k lowest-scoring positives."""
    some = scored.where(F.col("score").isNotNull())
    high = some.where(~F.col(positive)).orderBy(F.desc("score"), "doc_id").limit(k)
    return high.unionByName(some.where(F.col(positive)).orderBy("score", "doc_id").limit(k))
