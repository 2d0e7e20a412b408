"""End-to-end plans: score a corpus, in self or reference mode."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FAMILIES, MIN_BIN, TIERS
from ..operators import fusion as fu, language_model as lm
from ..operators.calibrate import CalibrationRun, calibrate
from ..operators.components import cut
from ..operators.stats import corpus_totals
from .profile import Profile, profile


@dataclass
class ScoreRun:
    rows: DataFrame
    meta: dict
    top: list[dict]


def notes_of(p: Profile, cal: fu.Calibration, counts: dict, stats: DataFrame, stratify_by: str | None) -> list[str]:
    """F18."""
    out = []
    if stratify_by:
        groups = [r[0] for r in stats.where("grp is not null").select("grp").distinct().orderBy("grp").limit(13).collect()]
        out.append(f"documents are compared within {stratify_by}: {', '.join(groups[:12]) or 'no group is large enough'}{' and more' if len(groups) > 12 else ''}; groups below {MIN_BIN} documents against all")
    out += p.notes
    n = counts["n_documents"]
    if counts["n_non_english"]:
        out.append(f"{counts['n_non_english']} documents are evidently not English and were left unscored")
    short = n - (counts["n_analysable"] or 0) - (counts["n_non_english"] or 0)
    if n and short > 0.25 * n:
        out.append(f"{short} of {n} documents are too short to score")
    normal = stats.where("grp is null").agg(F.max("n")).first()[0] or 0
    if normal < MIN_BIN:
        out.append(f"only {normal} documents define what is normal")
    if (cal.meta.get("stratify_by") or None) != stratify_by:
        out.append(f"the calibration was made by {cal.meta.get('stratify_by') or 'no group'}, this run by {stratify_by or 'no group'}: its rates do not hold here")
    unknown = sorted(s for s in fu.artifact_signals() if s not in cal.human)
    if unknown:
        out.append(f"the calibration does not know these signals, which were ignored: {', '.join(unknown)}")
    return out


def score_corpus(docs: DataFrame, cal: fu.Calibration, reference: DataFrame | None = None, stratify_by: str | None = None, families: Iterable[str] = FAMILIES, guard: bool = True, top_n: int = 20) -> ScoreRun:
    """Profile, normalise, fuse; ``rows`` has a row per document (``__row``: its place), ``meta`` the roll-ups.

    The input's own columns are kept where they are named as the scores need (label, lang, source, and
    ``stratify_by``).
    """
    families = tuple(families)
    if reference is not None:
        # The reference's documents are scored against its model without themselves.
        texts = lm.by_row(reference)[0]
        model = lm.fit(texts) if "surprisal" in families else None
        normal = profile(reference, families, model=model, guard=guard, of_model=True).rows
        audited = profile(docs, families, model=model, guard=guard)
        if model is not None:
            model.release()
    else:
        audited = profile(docs, families, guard=guard)
        normal = audited.rows
    stats = fu.reference_stats(normal, stratify_by)
    scored = fu.fuse(audited.rows, stats, cal, stratify_by, audited.dropped)
    counts = corpus_totals(audited.rows).first().asDict()
    keep = [c for c in dict.fromkeys(("__row", "doc_id", "label", "lang", "source", stratify_by, "n_words", "tier", "score", "families_fired", "families", "evidence", "reason")) if c in scored.columns]
    scored = cut(scored.select(*keep))
    rolled = {k: {str(r[0]): r[1] for r in d.collect()} for k, d in fu.rollups(scored).items()}
    meta = counts | {"tiers": {t: rolled["tiers"].get(t, 0) for t in TIERS}, "families": rolled["families"], "histogram": rolled["histogram"], "mode": "reference" if reference is not None else "self", "language_model": audited.model.summary() if audited.model else None, "notes": notes_of(audited, cal, counts, stats, stratify_by)}
    if "label" in keep:
        meta["labels"] = {r["label"]: {t: r[t] for t in TIERS} for r in fu.label_by_tier(scored.where("label is not null"), "label").limit(1000).collect()}
    return ScoreRun(scored, meta, [r.asDict(recursive=True) for r in fu.top(scored, top_n).collect()])


def calibrate_corpus(docs: DataFrame, families: Iterable[str] = FAMILIES, guard: bool = True, reference: DataFrame | None = None, **options) -> CalibrationRun:
    """C11: profile a trusted corpus and calibrate on it; with a reference, against its language model."""
    p = profile(docs, tuple(families), reference=reference, guard=guard)
    return calibrate(p.rows, dropped=p.dropped, **options)


def self_calibrated(docs: DataFrame, min_documents: int = 40, families: Iterable[str] = FAMILIES, dropped: Iterable[str] = ()) -> tuple[DataFrame, CalibrationRun]:
    """Scores of a corpus under a calibration on itself, and that calibration."""
    p = profile(docs, tuple(families))
    run = calibrate(p.rows, likely_target=0.05, min_documents=min_documents, dropped=[*p.dropped, *dropped])
    # The calibration has z of all rows but those that are not scored.
    rows = run.family_z.unionByName(p.rows.where("not coalesce(analysable, false)"), allowMissingColumns=True)
    return fu.judged(rows, run.calibration), run


def self_scored(docs: DataFrame, min_documents: int = 40) -> DataFrame:
    """Scores of a corpus under a calibration on itself."""
    return self_calibrated(docs, min_documents)[0]
