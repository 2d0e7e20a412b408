import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from corpuscope.constants import FAMILIES, SIGNALS
from corpuscope.operators import calibrate as C, fusion as fu, stats


def test_tails_and_ranks():
    table = [(0.0, 90), (1.0, 10)]
    assert abs(fu.tail_p(table, 0.0, 1) - (10 + 45 + 0.5) / 101) < 1e-12
    assert fu.tail_p(table, 2.0, 1) == 0.5 / 101
    assert fu.sidak([1.0]) < 1.0000001 and fu.sidak([1.0, -1.0]) < 1.0
    assert fu.mid_rank([0, 0, 0, 1], 0) == 0.375
    assert fu.nearest_index(5, 4) == [0, 1, 2, 3, 4]


def test_strata_equal_slices(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 40), rng.random()) for i in range(333)]
    got = {r["doc_id"]: r["bin"] for r in fu.strata(spark.createDataFrame(rows, "doc_id long, n_words int, value double").withColumn("signal", F.lit("x")), ["signal"]).collect()}
    order, bins = sorted(rows, key=lambda r: (r[1], r[0])), 333 // 50
    for b in range(bins):
        assert all(got[r[0]] == b for r in order[b * 333 // bins : (b + 1) * 333 // bins])


def profile(spark, n=600, shift=0.0):
    rng = random.Random(5)
    names = list(SIGNALS)
    rows = [(i, 50 + rng.randint(0, 500), True, None, rng.choice("ab"), *[(0.0 if SIGNALS[s][0] == "artifact" and rng.random() < 0.9 else rng.gauss(shift, 1)) for s in names]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, n_words int, analysable boolean, reason string, grp string, " + ", ".join(f"{s} double" for s in names))


def test_calibrate_and_score(spark, tmp_path):
    p = profile(spark)
    run = C.calibrate(p, likely_target=0.02, stratify_by="grp")
    cal = run.calibration
    assert set(cal.thresholds) == set(FAMILIES) and "artifact" not in cal.thresholds_low
    assert len(cal.score_null) == 201 and cal.score_null == sorted(cal.score_null)
    assert cal.meta["evaluation"]["A"]["likely_rate"] <= 0.02
    cal.save(str(tmp_path / "c.json"))
    assert fu.Calibration.load(str(tmp_path / "c.json")) == cal
    out = fu.fuse(p, fu.reference_stats(p, "grp"), cal, "grp").persist()
    assert out.where("tier = 'UNSCORED'").count() == 0
    assert 40 < out.agg(F.avg("score")).first()[0] < 60
    ev = out.select("evidence").first()[0]
    assert len(ev) == 8 and all(a["strength"] >= b["strength"] - 1e-9 for a, b in zip(ev, ev[1:]))
    try:
        C.calibrate(p.limit(50))
        raise AssertionError("too few documents must be refused")
    except C.CalibrationError:
        pass


def test_measures(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True), (3.0, False)], "s double, y boolean")
    assert stats.auc(rows, "s", "y").first()[0] == 0.375
    d = stats.describe(rows, "s").first()
    assert d["mean"] == 2.25 and abs(d["stdev"] - statistics.pstdev([1, 2, 3, 3])) < 1e-12
    assert stats.describe(rows.where("s > 9"), "s").first()["p95"] == 0.0


def test_medians_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randint(0, 9)) if rng.random() < 0.5 else rng.gauss(0, 1)) for _ in range(301)] + [("c", 2.0), ("a", None)]
    got = {r["g"]: r for r in stats.median_mad(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None]
        m = statistics.median(values)
        assert abs(got[g]["median"] - m) < 1e-12 and got[g]["n"] == len(values)
        assert abs(got[g]["mad"] - 1.4826 * statistics.median(abs(v - m) for v in values)) < 1e-12


def test_tails_equal_counting():
    rng = random.Random(7)
    table = [(round(rng.gauss(0, 1), 2), rng.randint(1, 5)) for _ in range(40)]
    total = sum(c for _, c in table)
    for d in (1, -1):
        values = [v for v, _ in table] + [-9.0, 9.0, 0.001]
        for v, p in zip(values, fu.tails(table, d)(np.array(values)), strict=True):
            beyond = sum(c for x, c in table if (x - v) * d > 0)
            equal = sum(c for x, c in table if x == v)
            assert abs(p - (beyond + equal / 2 + 0.5) / (total + 1)) < 1e-12


def test_groups_have_their_own_normal(spark):
    """a group of 50 is compared with itself, a smaller one with all."""
    rng = random.Random(3)
    rows = [(i, 60, True, "big" if i < 60 else "small" if i < 70 else "rest", (10.0 if i < 60 else 0.0) + rng.gauss(0, 1)) for i in range(200)]
    names = [s for s in SIGNALS if s != "mtld"]
    df = spark.createDataFrame(rows, "doc_id long, n_words int, analysable boolean, grp string, mtld double").withColumns({s: F.lit(None).cast("double") for s in names})
    z = {r["doc_id"]: r["z_mtld"] for r in fu.with_corpus_z(df, fu.reference_stats(df, "grp"), "grp").collect()}
    whole = {r["doc_id"]: r["z_mtld"] for r in fu.with_corpus_z(df, fu.reference_stats(df)).collect()}
    big = [v for i, *_, v in rows if i < 60]
    m = statistics.median(big)
    scale = 1.4826 * statistics.median(abs(v - m) for v in big)
    assert all(abs(z[i] - max(-6, min(6, -(v - m) / scale))) < 1e-9 for i, *_, v in rows if i < 60)
    assert all(z[i] == whole[i] for i in range(60, 70))


def test_evaluation_measures(spark):
    """E2-E6 by hand."""
    rows = [(1, "LIKELY_SYNTHETIC", 99.0, True), (2, "SUSPECT", 80.0, True), (3, "CLEAN", 5.0, True), (4, "SUSPECT", 90.0, False), (5, "CLEAN", 4.0, False), (6, "CLEAN", 3.0, False), (7, "UNSCORED", None, True)]
    df = spark.createDataFrame(rows, "doc_id long, tier string, score double, y boolean")
    m = stats.tier_metrics(df, "y").first()
    assert (m["n"], m["prevalence"]) == (6, 0.5) and abs(m["recall_likely"] - 1 / 3) < 1e-12 and abs(m["recall_flagged"] - 2 / 3) < 1e-12
    assert m["fpr_likely"] == 0 and abs(m["fpr_flagged"] - 1 / 3) < 1e-12 and m["precision_likely"] == 1 and abs(m["precision_flagged"] - 2 / 3) < 1e-12
    assert [r["doc_id"] for r in stats.failures(df, "y", 2).collect()] == [4, 5, 3, 2]
    report = {r["signal"]: r for r in stats.fire_report(df.withColumn("other", F.lit(0.0)), ["score", "other"]).collect()}
    assert report["score"]["fires"] == 1 and report["other"]["fires"] == 0 and report["score"]["max"] == 99
    big = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).alias("y"))
    mix = stats.contaminated_mix(big, "y", 0.2)
    share = mix.agg(F.avg(F.col("y").cast("double"))).first()[0]
    assert mix.where("not y").count() == 2000 and abs(share - 0.2) < 0.03
    pairs = spark.createDataFrame([(float(i), float(-i), float(i % 3)) for i in range(40)], "a double, b double, c double")
    found = stats.cross_family(pairs, [("a", "c"), ("a", "b")])
    assert found[0][:2] == ("a", "b") and abs(found[0][2] + 1) < 1e-9
    assert stats.percentile(rows_of(spark), "v", 25).first()[0] == 1.75
    try:
        stats.percentile(rows_of(spark), "v", 101)
        raise AssertionError("a percentile above 100 must be refused")
    except ValueError:
        pass
    z = rows_of(spark).select(stats.robust_z(F.col("v"), F.lit(2.0), F.lit(2.0)), stats.robust_z(F.col("v"), F.lit(2.0), F.lit(0.0))).collect()
    assert [tuple(r) for r in z] == [(-0.5, 0.0), (0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]


def rows_of(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
