"""Profiles: documents to one wide row of counts, guard and signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FAMILIES, MIN_COVERAGE_SENTENCES, MIN_COVERAGE_SPREAD, MIN_WORDS
from ..functions import language, text as T
from ..operators import language_model as lm
from ..operators.components import cut, spread
from ..operators.signals import with_text_signals
from ..registry import catalog, contextual, registered


@dataclass
class Profile:
    rows: DataFrame
    model: lm.LanguageModel | None
    dropped: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()


def _viewed(docs: DataFrame, guard: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*[c for c in docs.columns if c != "text"], text.alias("text")).withColumn("__w", T.words(F.col("text")))
    w = F.col("__w")
    reason = F.when(F.size(w) >= MIN_WORDS, language.non_english_reason(w)) if guard else F.lit(None).cast("string")
    out = base.withColumns({"n_chars": F.length("text"), "n_words": F.size(w), "n_types": F.size(F.array_distinct(w)), "reason": reason})
    return out.withColumn("analysable", (F.col("n_words") >= MIN_WORDS) & F.col("reason").isNull())


def views(docs: DataFrame, guard: bool = True) -> DataFrame:
    """Counts of every document, and whether and why not it is analysable."""
    return _viewed(docs, guard).drop("__w")


def profile(docs: DataFrame, families: tuple[str, ...] = FAMILIES, reference: DataFrame | None = None, model: lm.LanguageModel | None = None, guard: bool = True, of_model: bool = False) -> Profile:
    """Signals of every analysable document; in reference mode against the reference's model.

    ``docs``: doc_id (of any type), text, and any columns to keep. A row is a document: ids may
    repeat or be null, and ``__row`` (the place in the input) tells rows apart. What follows from a text
    alone is one projection and one Arrow pass; families that are not asked for are not computed:
    without surprisal no model is fitted. ``of_model`` tells that ``model`` was fitted on these documents
    (:func:`corpuscope.operators.language_model.by_row`), so that each is scored without itself. The result, without texts, is cut in the shared folder.
    """
    docs = spread(docs.withColumn("__row", F.monotonically_increasing_id()))
    seen = _viewed(docs, guard).drop("__w")
    if {"distributional", "reasoning", "artifact"} & set(families):
        seen = with_text_signals(seen, families, "analysable")
    for name, (family, build) in registered().items():
        if family in families:
            seen = build(seen)
    seen = seen.persist()
    out, notes, dropped = seen, [], ()
    own = reference is None and model is None
    self_mode = own or of_model
    if "surprisal" in families:
        texts = seen.select(F.col("__row").alias("doc_id"), "text")
        model = model or (lm.fit(lm.by_row(reference)[0], keep_rows=False, keep_totals=True) if reference is not None else lm.fit(texts))
        able = seen.where("analysable").select(F.col("__row").alias("doc_id"))
        bits = lm.surprisal_signals(texts, model, self_mode, able).withColumnRenamed("doc_id", "__row")
        out = out.join(bits, "__row", "left")
        if not self_mode:
            # What the reference does not cover cannot show spread.
            covered = lm.audited_coverage(texts, model)
            dropped = (("surprisal_std",) if covered < MIN_COVERAGE_SPREAD else ()) + (("sentence_surprisal_std",) if covered < MIN_COVERAGE_SENTENCES else ())
            if dropped:
                notes.append(f"the reference covers {covered:.0%} of the audited word pairs: {', '.join(dropped)} withheld")
    for name, (family, factory) in contextual().items():
        extra = factory(seen, model) if family in families else None
        if extra is not None:
            out = out.join(extra.select("__row", name).dropDuplicates(["__row"]), "__row", "left")
    missing = {s: F.lit(None).cast("double") for s in catalog() if s not in out.columns}
    rows = cut((out.withColumns(missing) if missing else out).drop("text"))
    seen.unpersist()
    if model is not None and (own or reference is not None):
        model.release()
    return Profile(rows, model, dropped, tuple(notes))
