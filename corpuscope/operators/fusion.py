"""Fusion (F1-F18): signals to oriented z, to family z, to tier, score and evidence.

Statistics of the reference rows are a table of at most bins x signals x groups rows; they go to
the driver and come back as literals (or a size-checked broadcast for groups), so that scoring is a
projection without a shuffle.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import FAMILIES, FISHER_MISSING, MAX_BINS, MIN_BIN, PRECISION, TIERS, TWO_SIDED, Z_CAP
from ..registry import catalog
from .components import BROADCAST_BYTES, cut
from .stats import median_mad

NORMAL = NormalDist()


def corpus_signals() -> list[str]:
    """Signals judged against the corpus."""
    return [s for s, (f, _, _) in catalog().items() if f != "artifact"]


def artifact_signals() -> list[str]:
    """Signals judged against trusted text."""
    return [s for s, (f, _, _) in catalog().items() if f == "artifact"]


def z_of_tail(p: float) -> float:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return max(-Z_CAP, min(Z_CAP, NORMAL.inv_cdf(1 - p)))


# --- F1-F4: length strata ----------------------------------------------------------------------


def strata(long: DataFrame, keys: list[str], order: str = "doc_id") -> DataFrame:
    """``bin`` of every row: equal-frequency bins by n_words within ``keys``.

    Ranks come from counts per length, and from row numbers within one length, so that no task sorts
    all rows of a signal. Bin of rank r (from 0) of n rows in B bins: ``((r + 1) * B - 1) div n``.
    """
    counts = long.groupBy(*keys, "n_words").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("n_words").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*keys, "n_words", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    within = Window.partitionBy(*keys, "n_words").orderBy(order)
    ranked = long.withColumn("i", F.row_number().over(within)).join(start, [*keys, "n_words"])
    bins = F.greatest(F.lit(1), F.least(F.lit(MAX_BINS), F.expr(f"n div {MIN_BIN}")))
    return ranked.withColumn("bins", bins).withColumn("bin", F.expr("((start + i) * bins - 1) div n")).drop("i", "start", "bins")


def long_form(profile: DataFrame, columns: Iterable[str], group: str | None = None) -> DataFrame:
    ids = ["doc_id", "n_words"] + ([group] if group else [])
    return profile.where("analysable").unpivot(ids, list(columns), "signal", "value").where("value is not null")


def reference_stats(profile: DataFrame, group: str | None = None) -> DataFrame:
    """``grp, signal, bin, edge, median, mad, gmedian, gmad, n``; grp null: all rows. Cut: bins x signals x groups rows."""
    long = long_form(profile, corpus_signals(), group).persist()
    parts = []
    for grouped in [False] + ([True] if group else []):
        keys = ["signal"] + (["grp"] if grouped else [])
        rows = long.withColumn("grp", F.col(group).cast("string")).where("grp is not null") if grouped else long
        binned = strata(rows, keys)
        edges = binned.groupBy(*keys, "bin").agg(F.max("n_words").alias("edge"))
        local = median_mad(binned, [*keys, "bin"], "value", few=not grouped).drop("n")
        over = median_mad(rows, keys, "value", few=not grouped).select(*keys, F.col("median").alias("gmedian"), F.col("mad").alias("gmad"), "n")
        if grouped:
            over = over.where(f"n >= {MIN_BIN}")
        part = edges.join(local, [*keys, "bin"]).join(over, keys)
        parts.append(part if grouped else part.withColumn("grp", F.lit(None).cast("string")))
    names = ["grp", "signal", "bin", "edge", "median", "mad", "gmedian", "gmad", "n"]
    out = parts[0].select(*names)
    out = cut(out.unionByName(parts[1].select(*names)) if len(parts) > 1 else out)
    long.unpersist()
    return out


# --- calibration object ------------------------------------------------------------------------


@dataclass
class Calibration:
    """Thresholds and null distributions of a trusted corpus."""

    thresholds: dict[str, float]
    thresholds_low: dict[str, float]
    family_null: dict[str, list[float]]
    score_null: list[float]
    human: dict[str, list[tuple[float, int]]]
    signals: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, sort_keys=True)

    @classmethod
    def load(cls, path: str) -> Calibration:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        data["human"] = {k: [tuple(p) for p in v] for k, v in data["human"].items()}
        return cls(**data)


def tails(pairs: list[tuple[float, int]], direction: int):
    """the mid-rank tail probability of values in the suspicious direction, half a count added."""
    pairs = sorted(pairs)
    known = np.array([v for v, _ in pairs], dtype=np.float64)
    upto = np.concatenate(([0], np.cumsum([c for _, c in pairs])))

    def look(values: np.ndarray) -> np.ndarray:
        values = np.array([round(v, PRECISION) for v in values.tolist()])
        below, through = upto[np.searchsorted(known, values, side="left")], upto[np.searchsorted(known, values, side="right")]
        beyond = upto[-1] - through if direction > 0 else below
        return (beyond + (through - below) / 2 + 0.5) / (upto[-1] + 1)

    return look


def tail_p(pairs: list[tuple[float, int]], value: float, direction: int) -> float:
    return float(tails(pairs, direction)(np.array([value]))[0])


def sidak(zs: list[float]) -> float:
    """z of the strongest of several signals, given how many there are."""
    return z_of_tail(1 - NORMAL.cdf(max(zs)) ** len(zs))


def mid_rank(null: list[float], z: float) -> float:
    return (bisect.bisect_left(null, z) + bisect.bisect_right(null, z)) / 2 / len(null)


# --- column expressions ------------------------------------------------------------------------


def _array(values: Iterable[float]) -> Column:
    """A literal array as one foldable node: hundreds of literals would slow the analysis of every later step."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def mid_rank_column(null: list[float], z: Column) -> Column:
    """F11 for a literal array, by one vectorised function: a search of the sorted values.

    As an expression over the array it would stand, once for each value, in every later filter that is
    pushed below it. Null ranks as 0.
    """
    known = np.sort(np.array(null, dtype=np.float64))

    @F.pandas_udf("double")
    def ranked(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=np.float64, na_value=np.nan)
        return pd.Series((np.searchsorted(known, x, side="left") + np.searchsorted(known, x, side="right")) / (2.0 * len(known)))

    return F.when(z.isNotNull(), ranked(z)).otherwise(0.0)


def _located(edges: Column, medians: Column, mads: Column, gmad: Column, n_words: Column) -> tuple[Column, Column]:
    """median and scale of the first bin that reaches n_words, else of the last."""
    i = F.least(F.size(F.filter(edges, lambda e: e < n_words)), F.size(edges) - 1)
    scale = F.get(mads, i)
    return F.get(medians, i), F.when(scale > 0, scale).otherwise(gmad)


def with_corpus_z(profile: DataFrame, stats: DataFrame, group: str | None = None, dropped: Iterable[str] = ()) -> DataFrame:
    """``z_<signal>`` of the corpus-normalised signals; null where there is no evidence."""
    per = F.sort_array(F.collect_list(F.struct("bin", "edge", "median", "mad")))
    rows = stats.where("grp is null").groupBy("signal").agg(per.alias("b"), F.first("gmad").alias("gmad")).collect()
    whole = {r["signal"]: r for r in rows}
    out = profile
    if group:
        # A row per group, its statistics by signal.
        each = stats.where("grp is not null").groupBy("grp", "signal").agg(per.alias("b"), F.first("gmad").alias("gmad"))
        told = F.struct(F.transform("b", lambda x: x["edge"].cast("double")).alias("e"), F.transform("b", lambda x: x["median"]).alias("m"), F.transform("b", lambda x: x["mad"]).alias("s"), F.col("gmad").alias("g"))
        table = each.groupBy(F.col("grp").alias("__grp")).agg(F.map_from_entries(F.collect_list(F.struct("signal", told))).alias("__own"))
        small = table.count() * len(whole) * MAX_BINS * 24 <= BROADCAST_BYTES
        out = out.join(F.broadcast(table) if small else table, F.col(group).cast("string") == F.col("__grp"), "left")
    zs = {}
    for s in corpus_signals():
        if s in dropped or s not in whole or s not in profile.columns:
            zs[f"z_{s}"] = F.lit(None).cast("double")
            continue
        r = whole[s]
        med, scale = _located(_array(b["edge"] for b in r["b"]), _array(b["median"] for b in r["b"]), _array(b["mad"] for b in r["b"]), F.lit(float(r["gmad"])), F.col("n_words"))
        if group:
            g = F.col("__own")[s]
            gm, gs = _located(g["e"], g["m"], g["s"], g["g"], F.col("n_words"))
            med, scale = F.when(g.isNotNull(), gm).otherwise(med), F.when(g.isNotNull(), gs).otherwise(scale)
        z = F.greatest(F.lit(-Z_CAP), F.least(F.lit(Z_CAP), catalog()[s][1] * (F.col(s) - med) / scale))
        zs[f"z_{s}"] = F.when(F.col("analysable") & F.col(s).isNotNull() & (scale > 0), z)
    out = out.withColumns(zs)
    return out.drop("__grp", "__own")


def with_artifact_z(profile: DataFrame, human: Mapping[str, list[tuple[float, int]]], dropped: Iterable[str] = ()) -> DataFrame:
    """``z_<signal>`` of artifact signals and ``z_artifact``, by one vectorised function.

    Φ and its inverse are no built-ins; each distinct value is looked up once a batch.
    """
    names = [s for s in artifact_signals() if s in human and human[s] and s not in dropped]
    kind = ", ".join([*[f"{s} double" for s in names], "artifact double"])
    look = {s: (human[s], catalog()[s][1]) for s in names}

    @F.pandas_udf(kind)
    def judged(*values: pd.Series) -> pd.DataFrame:
        zs = {}
        for s, v in zip(names, values, strict=True):
            seen = v.dropna().unique()
            table = {x: z_of_tail(p) for x, p in zip(seen.tolist(), tails(*look[s])(seen).tolist(), strict=True)} if len(seen) else {}
            zs[s] = v.map(table).astype("float64")
        out = pd.DataFrame(zs)
        n, top = out.notna().sum(axis=1), out.max(axis=1)
        known: dict[tuple, float] = {}
        combined = []
        for z, k in zip(top, n, strict=True):
            if k and (z, k) not in known:
                known[z, k] = z_of_tail(1 - NORMAL.cdf(z) ** int(k))
            combined.append(known[z, k] if k else None)
        out["artifact"] = np.array(combined, dtype="float64")
        return out

    if not names:
        return profile.withColumns({f"z_{s}": F.lit(None).cast("double") for s in [*artifact_signals(), "artifact"]})
    out = profile.withColumn("__a", judged(*[F.when(F.col("analysable"), F.col(s)) for s in names]))
    real = lambda c: F.when(~F.isnan(c), c)
    return out.withColumns({f"z_{s}": real(F.col(f"__a.{s}")) if s in names else F.lit(None).cast("double") for s in artifact_signals()} | {"z_artifact": real(F.col("__a.artifact"))}).drop("__a")


def with_family_z(profile: DataFrame) -> DataFrame:
    """F8, F9, F10's rounding: ``z_<family>`` at six places, and ``k_<family>`` signals behind it."""
    out = {}
    for f in FAMILIES:
        zs = [F.col(f"z_{s}") for s, (fam, _, _) in catalog().items() if fam == f]
        n = sum((z.isNotNull().cast("int") for z in zs), F.lit(0))
        total = sum((F.coalesce(z, F.lit(0.0)) for z in zs), F.lit(0.0))
        out[f"k_{f}"] = n
        out[f"z_{f}"] = F.bround(F.col("z_artifact") if f == "artifact" else F.when(n > 0, total / n), PRECISION)
    return profile.withColumns(out)


def fisher(percentiles: Mapping[str, Column], sizes: Mapping[str, int]) -> Column:
    """sum of -2 ln of each family's tail; a missing family adds its expectation."""
    x = F.lit(0.0)
    for f in FAMILIES:
        p = percentiles[f]
        tail = 2 * F.least(p, 1 - p) if TWO_SIDED[f] else 1 - p
        x = x + F.when(p.isNull(), FISHER_MISSING).otherwise(-2 * F.log(F.greatest(tail, F.lit(0.5 / max(1, sizes.get(f, 1))))))
    return x


def side(family: str, cal: Calibration) -> Column:
    """strictly above the high threshold, or strictly below the low one of a two-sided family."""
    z = F.col(f"z_{family}")
    high, low = cal.thresholds.get(family), cal.thresholds_low.get(family)
    out = F.lit(None).cast("string")
    if low is not None:
        out = F.when(z < low, F.lit("low"))
    return F.when(z > high, F.lit("high")).otherwise(out) if high is not None else out


def with_percentiles(df: DataFrame, cal: Calibration) -> DataFrame:
    return df.withColumns({f"p_{f}": F.when(F.col(f"z_{f}").isNotNull(), mid_rank_column(cal.family_null[f], F.col(f"z_{f}"))) if cal.family_null.get(f) else F.lit(None).cast("double") for f in FAMILIES})


def with_statistic(df: DataFrame, cal: Calibration) -> DataFrame:
    return df.withColumn("statistic", F.bround(fisher({f: F.col(f"p_{f}") for f in FAMILIES}, {f: len(v) for f, v in cal.family_null.items()}), PRECISION))


def evidence(cal: Calibration | None = None, most: int = 8) -> Column:
    """the strongest signals, with direction and basis."""
    items = []
    for i, (s, (f, d, text)) in enumerate(catalog().items()):
        z = F.col(f"z_{s}")
        raw = z * d
        strength = F.abs(z) if TWO_SIDED[f] else z
        item = F.struct((-strength).alias("o"), F.lit(i).alias("i"), F.lit(s).alias("signal"), F.lit(f).alias("family"), F.bround(F.col(s), 6).alias("value"), F.bround(z, 3).alias("z"), F.bround(strength, 3).alias("strength"), F.when(raw > 0, "above").when(raw < 0, "below").otherwise("").alias("deviation"), F.lit("corpus" if f != "artifact" else "human-baseline").alias("basis"), F.lit(text).alias("description"))
        items.append(F.when(z.isNotNull(), item))
    ranked = F.slice(F.sort_array(F.filter(F.array(*items), lambda x: x.isNotNull())), 1, most)
    return F.transform(ranked, lambda x: F.struct(*[x[c].alias(c) for c in ("signal", "family", "value", "z", "strength", "deviation", "basis", "description")]))


def with_z(profile: DataFrame, stats: DataFrame, human: Mapping[str, list[tuple[float, int]]], group: str | None = None, dropped: Iterable[str] = ()) -> DataFrame:
    """Z of signals and families."""
    dropped = list(dropped)
    return with_family_z(with_artifact_z(with_corpus_z(profile, stats, group, dropped), human, dropped))


def fuse(profile: DataFrame, stats: DataFrame, cal: Calibration, group: str | None = None, dropped: Iterable[str] = ()) -> DataFrame:
    """F5-F15 for every row: tier, score, families, evidence."""
    return judged(with_z(profile, stats, cal.human, group, dropped), cal)


def judged(rows: DataFrame, cal: Calibration) -> DataFrame:
    """F10-F15 for rows that have their z."""
    out = with_statistic(with_percentiles(rows, cal), cal)
    out = out.withColumns({f"side_{f}": side(f, cal) for f in FAMILIES})
    fired = F.filter(F.array(*[F.when(F.col(f"side_{f}").isNotNull(), F.lit(f)) for f in FAMILIES]), lambda x: x.isNotNull())
    any_signal = F.coalesce(*[F.col(s) for s in catalog()]).isNotNull()
    scored = F.col("analysable") & any_signal
    n = F.size("families_fired")
    score = 100 * mid_rank_column(cal.score_null, F.col("statistic")) if cal.score_null else F.lit(None).cast("double")
    out = out.withColumn("families_fired", F.when(scored, fired).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({"tier": F.when(~scored, TIERS[3]).when(n >= 2, TIERS[0]).when(n == 1, TIERS[1]).otherwise(TIERS[2]), "score": F.when(scored, F.bround(score, 2)), "evidence": F.when(scored, evidence(cal)).otherwise(F.array())})
    fam = F.struct(*[F.struct(F.bround(f"z_{f}", 4).alias("z"), F.col(f"k_{f}").alias("n_signals"), F.col(f"side_{f}").isNotNull().alias("fired"), F.col(f"side_{f}").alias("side"), F.lit(cal.thresholds.get(f)).cast("double").alias("threshold"), F.lit(cal.thresholds_low.get(f)).cast("double").alias("threshold_low"), F.bround(f"p_{f}", 4).alias("percentile")).alias(f) for f in FAMILIES])
    return out.withColumn("families", fam)


def rollups(scored: DataFrame) -> dict[str, DataFrame]:
    """tier counts, family fire counts, a 20-bin score histogram."""
    return {
        "tiers": scored.groupBy("tier").count(),
        "families": scored.select(F.explode("families_fired").alias("family")).groupBy("family").count(),
        "histogram": scored.where("score is not null").groupBy(F.least(F.lit(19), F.floor(F.col("score") / 5)).alias("bin")).count(),
    }


def top(scored: DataFrame, n: int = 20) -> DataFrame:
    """highest scores first, ties in corpus order."""
    return scored.where("score is not null").orderBy(F.desc("score"), "__row" if "__row" in scored.columns else "doc_id").limit(n)


def label_by_tier(scored: DataFrame, label: str) -> DataFrame:
    return scored.groupBy(label).pivot("tier", list(TIERS)).count().na.fill(0)


def nearest_index(n: int, last: int) -> list[int]:
    """Indices of n quantiles, halves to even."""
    return [int(round(i * last / (n - 1))) for i in range(n)]


def high_index(alpha: float, n: int) -> int:
    return max(0, math.ceil((1 - alpha) * n) - 1)


def low_index(alpha: float, n: int) -> int:
    return min(n - 1, math.floor(alpha * n))
