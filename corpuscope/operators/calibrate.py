"""Calibration on a trusted corpus.

Family z are rounded to six places within ±6, so their distributions are tables of bounded size;
order statistics are read from running counts over them, never from a sorted array of documents.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import ALPHAS, FAMILIES, PRECISION, QUANTILES, TWO_SIDED
from ..registry import catalog
from . import fusion as fu
from .components import cut

MIN_DOCUMENTS, RECOMMENDED = 200, 1000


class CalibrationError(RuntimeError):
    """The corpus cannot support a calibration."""


@dataclass
class CalibrationRun:
    calibration: fu.Calibration
    search: list[tuple[float, float, float, bool]]
    family_z: DataFrame
    notes: list[str] = field(default_factory=list)
    #: Statistics of the corpus itself, as :func:`corpuscope.operators.fusion.reference_stats` gives them.
    stats: DataFrame | None = None


def half_of(doc_id: Column) -> Column:
    """A or B by the parity of the id's SHA-1."""
    return F.when(F.instr(F.lit("02468ace"), F.substring(F.sha1(doc_id.cast("string").cast("binary")), 40, 1)) > 0, "A").otherwise("B")


def human_table(profile: DataFrame) -> dict[str, list[tuple[float, int]]]:
    """Value counts of the artifact signals."""
    long = fu.long_form(profile, fu.artifact_signals())
    rows = long.groupBy("signal", F.bround("value", PRECISION).alias("v")).count().collect()
    out: dict[str, list[tuple[float, int]]] = {}
    for r in sorted(rows):
        out.setdefault(r["signal"], []).append((r["v"], r["count"]))
    return out


def order_statistics(values: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Values at ranks (from 0) of ``name, v`` rows."""
    counts = values.where("v is not null").groupBy("name", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select("name", "v", "c", F.sum("c").over(w).alias("end"))
    wanted = values.sparkSession.createDataFrame([(n, int(r)) for n, rs in ranks.items() for r in set(rs)] or [("", -1)], "name string, r long")
    found = upto.join(F.broadcast(wanted), "name").where("r < end and r >= end - c").select("name", "r", "v").collect()
    out: dict[str, dict[int, float]] = {n: {} for n in ranks}
    for x in found:
        out[x["name"]][x["r"]] = x["v"]
    return out


def _fires(f: str, high: dict, low: dict) -> Column:
    z = F.col(f"z_{f}")
    hit = (z > high[f]) if f in high else F.lit(False)
    return F.coalesce(hit | (z < low[f]) if f in low else hit, F.lit(False)).cast("int")


def _rates(high: dict, low: dict) -> list[Column]:
    """Fire rates of the families, then the shares of exactly one and of two or more."""
    fires = {f: _fires(f, high, low) for f in high}
    n = sum(fires.values(), F.lit(0))
    return [*[F.avg(fires[f].cast("double")) for f in high], F.avg((n == 1).cast("double")), F.avg((n >= 2).cast("double"))]


def independent(ps: list[float]) -> float:
    """The chance that two or more fire if they were independent."""
    none = _product(1 - p for p in ps)
    one = sum(p * _product(1 - q for j, q in enumerate(ps) if j != i) for i, p in enumerate(ps))
    return 1 - none - one


def _product(xs) -> float:
    out = 1.0
    for x in xs:
        out *= x
    return out


def _by_tier(scored: DataFrame) -> dict[str, list[float]]:
    """The smallest and the (upper) median score of the documents that fire no, one, or more families."""
    tier = F.when(F.col("fired") >= 2, "LIKELY").when(F.col("fired") == 1, "SUSPECT").otherwise("CLEAN")
    named = scored.where("score is not null").select(tier.alias("name"), F.col("score").alias("v"))
    sizes = dict(named.groupBy("name").count().collect())
    at = order_statistics(named, {t: [0, n // 2] for t, n in sizes.items()})
    return {t: [round(at[t][0], 1), round(at[t][n // 2], 1)] for t, n in sizes.items()}


def calibrate(profile: DataFrame, likely_target: float = 0.01, stratify_by: str | None = None, breakdown_by: str | None = None, source: str = "", min_documents: int = MIN_DOCUMENTS, dropped: Iterable[str] = ()) -> CalibrationRun:
    """C2-C11 from a profile (see :mod:`corpuscope.plans.profile`)."""
    rows = profile.where("analysable").withColumn("half", half_of(F.col("doc_id")))
    halves = dict(rows.groupBy("half").count().collect())
    n = sum(halves.values())
    notes = []
    if n < min_documents:
        raise CalibrationError(f"only {n} analysable documents; at least {min_documents} are needed")
    if n < RECOMMENDED:
        notes.append(f"{n} analysable documents, fewer than {RECOMMENDED}: thresholds are noisy")
    if min(halves.get("A", 0), halves.get("B", 0)) < min_documents // 4:
        raise CalibrationError(f"the id split gives {halves}; both halves need {min_documents // 4}")
    human = human_table(rows.where("half = 'A'"))
    stats = fu.reference_stats(rows, stratify_by)
    z = cut(fu.with_z(rows, stats, human, stratify_by, dropped))
    a = z.where("half = 'A'")
    sizes = a.agg(*[F.count(f"z_{f}").alias(f) for f in FAMILIES]).first().asDict()
    sizes = {f: c for f, c in sizes.items() if c}
    ranks = {}
    for f, c in sizes.items():
        tails = [alpha / 2 if TWO_SIDED[f] else alpha for alpha in ALPHAS]
        ranks[f] = fu.nearest_index(QUANTILES, c - 1) + [fu.high_index(t, c) for t in tails] + [fu.low_index(t, c) for t in tails]
    long = a.unpivot([], [f"z_{f}" for f in sizes], "name", "v").select(F.expr("substr(name, 3)").alias("name"), "v")
    at = order_statistics(long, ranks)

    def thresholds(alpha: float) -> tuple[dict, dict]:
        """C3, C4."""
        tail = lambda f: alpha / 2 if TWO_SIDED[f] else alpha
        return {f: at[f][fu.high_index(tail(f), c)] for f, c in sizes.items()}, {f: at[f][fu.low_index(tail(f), c)] for f, c in sizes.items() if TWO_SIDED[f]}

    k = len(sizes) + 2
    flat = list(a.agg(*[c.alias(f"c{i}") for i, c in enumerate(c for alpha in ALPHAS for c in _rates(*thresholds(alpha)))]).first())
    search = [(alpha, flat[i * k + k - 2], flat[i * k + k - 1], flat[i * k + k - 1] <= likely_target) for i, alpha in enumerate(ALPHAS)]
    passing = [s[0] for s in search if s[3]]
    if not passing:
        raise CalibrationError(f"no alpha keeps the likely share within {likely_target}")
    high, low = thresholds(passing[-1])  # C5: the last one that passes

    def evaluated(by: list[str]) -> list:
        cols = _rates(high, low)
        return z.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()

    def told(r) -> dict:
        marginals = {f: round(r[f"c{i}"], 5) for i, f in enumerate(high)}
        return {"documents": r["documents"], "family_fire_rate": marginals, "suspect_rate": round(r[f"c{k - 2}"], 5), "likely_rate": round(r[f"c{k - 1}"], 5), "likely_rate_if_independent": round(independent([r[f"c{i}"] for i in range(len(high))]), 5)}

    evaluation = {r["half"]: told(r) for r in evaluated(["half"])}
    field_ = stratify_by or breakdown_by
    if field_:
        evaluation |= {f"B_{r[field_]}": told(r) for r in evaluated(["half", field_]) if r["half"] == "B" and r[field_] is not None}
    cal = fu.Calibration(
        {f: round(t, 6) for f, t in high.items()}, {f: round(t, 6) for f, t in low.items()},
        {f: [round(at[f][i], 6) for i in fu.nearest_index(QUANTILES, c - 1)] for f, c in sizes.items()}, [], human, sorted(catalog()),
        {"baseline": source, "documents": halves, "likely_target": likely_target, "alpha": passing[-1], "evaluation": evaluation} | ({"stratify_by": stratify_by} if stratify_by else {}),
    )
    # The score's own null: the statistic over half A.
    s = cut(fu.with_statistic(fu.with_percentiles(z.select("half", *[f"z_{f}" for f in FAMILIES]), cal), cal).select("half", "statistic", sum((_fires(f, high, low) for f in sizes), F.lit(0)).alias("fired")))
    na = halves["A"]
    null = order_statistics(s.where("half = 'A'").select(F.lit("s").alias("name"), F.col("statistic").alias("v")), {"s": fu.nearest_index(QUANTILES, na - 1)})["s"]
    cal.score_null = [round(null[i], 6) for i in fu.nearest_index(QUANTILES, na - 1)]
    b = s.where("half = 'B'").withColumn("score", 100 * fu.mid_rank_column(cal.score_null, F.col("statistic")))
    nb = halves["B"]
    mid, p95 = nb // 2, int(0.95 * nb)
    bs = order_statistics(b.select(F.lit("s").alias("name"), F.col("score").alias("v")), {"s": [mid, p95]})["s"]
    evaluation["B"] |= {"score_median": round(bs[mid], 2), "score_p95": round(bs[p95], 2), "score_by_tier_min_median": _by_tier(b)}
    if evaluation["B"]["likely_rate"] > 1.5 * likely_target:
        notes.append(f"held-out half B reaches the likely tier at {evaluation['B']['likely_rate']:.2%}, above the {likely_target:.1%} target")
    return CalibrationRun(cal, search, z, notes, stats)
