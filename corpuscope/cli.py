"""Command line (X3-X5). Exit codes: 0 done, 1 nothing found, 2 bad input or a refused calibration, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__, registry, report
from .constants import FAMILIES


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuscope")
    p.add_argument("--version", action="version", version=f"corpuscope {__version__}")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, corpus: bool = True, audit: bool = True) -> argparse.ArgumentParser:
        v = sub.add_parser(name, help=text)
        if corpus:
            v.add_argument("corpus", help="a file, folder or glob, or - for what is piped in")
            v.add_argument("--text-field")
            v.add_argument("--min-chars", type=int, default=0)
            v.add_argument("--limit", type=int)
        if corpus and audit:
            v.add_argument("--reference", help="a trusted corpus that the language model is made of")
            v.add_argument("--allow-non-english", action="store_true")
        return v

    f = verb("profile", "totals of a corpus")
    f.add_argument("--out", help="write a row per document here, as JSON lines")
    f.add_argument("--json", action="store_true")
    f.add_argument("--family", action="append", choices=FAMILIES)
    verb("inspect", "texts and signals of some documents").add_argument("-n", "--num", type=int, default=3)
    s = verb("score", "tiers, scores and evidence")
    s.add_argument("--calibration", help="without it, the reference, or else the corpus itself, is calibrated on")
    s.add_argument("--out")
    s.add_argument("--report", help="write a report here: .md, .html or .json")
    s.add_argument("--top", type=int, default=10)
    s.add_argument("--stratify-by")
    c = verb("calibrate", "thresholds of a trusted corpus")
    c.add_argument("--out", required=True)
    c.add_argument("--likely-target", type=float, default=0.01)
    c.add_argument("--stratify-by")
    d = verb("dedup", "clusters of near-duplicates", audit=False)
    d.add_argument("--threshold", type=float, default=0.8)
    d.add_argument("--out")
    d.add_argument("--top", type=int, default=10)
    verb("families", "registered signals", corpus=False)
    e = verb("explain", "one document of a stored run", corpus=False)
    e.add_argument("run")
    e.add_argument("doc_id")
    r = verb("report", "a stored run as a report", corpus=False)
    r.add_argument("run")
    r.add_argument("--format", choices=sorted(report.RENDERERS), default="markdown")
    r.add_argument("-o", "--output")
    return p


def _put(text: str, path: str | None) -> None:
    if not path:
        print(text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _profile(a, docs, reference) -> int:
    from .operators import stats
    from .plans.profile import profile

    p = profile(docs, tuple(a.family or FAMILIES), reference=reference, guard=not a.allow_non_english)
    told = stats.corpus_totals(p.rows).first().asDict() | stats.vocabulary(docs).first().asDict()
    told |= {"language_model": p.model.summary() if p.model else None, "notes": list(p.notes)}
    if a.out:
        from .sources.readers import write_jsonl

        write_jsonl(p.rows.drop("__row"), a.out)
    if a.json:
        print(json.dumps(told, sort_keys=True))
    else:
        for name, value in told.items():
            print(f"{name:18} {value if not isinstance(value, dict) else json.dumps(value)}")
    return 0 if told["n_documents"] else 1


def _inspect(a, docs, reference) -> int:
    from pyspark.sql import functions as F

    from .functions import text as T
    from .plans.profile import profile

    view = T.view(F.col("text"))
    shown = docs.withColumns({"preview": T.preview(F.col("text")), "first_words": F.slice(T.words(F.col("text")), 1, 14), "n_sentences": view["n_sentences"], "n_lines": view["n_lines"]})
    rows = profile(shown, reference=reference, guard=not a.allow_non_english).rows.orderBy("__row").limit(a.num).collect()
    for r in rows:
        print(f"{r['doc_id']}" + (f" [{r['label']}]" if "label" in r and r["label"] else ""))
        print(f"  {r['n_chars']} characters, {r['n_words']} words, {r['n_types']} types, {r['n_sentences']} sentences, {r['n_lines']} lines; " + ("analysable" if r["analysable"] else r["reason"] or "too short"))
        print(f"  {r['preview']}\n  words: {' '.join(r['first_words'] or [])}")
        for name, (family, _, _) in registry.catalog().items():
            if r[name] is not None:
                print(f"  {name:28} {r[name]:12.4f}  {family}")
    return 0 if rows else 1


def _score(a, docs, reference) -> int:
    from .operators import fusion
    from .plans import score
    from .sources import readers

    guard = not a.allow_non_english
    if a.calibration:
        cal = fusion.Calibration.load(a.calibration)
    else:
        cal = score.calibrate_corpus(reference if reference is not None else docs, guard=guard, stratify_by=a.stratify_by, source=a.reference or a.corpus).calibration
        print(f"calibrated on {a.reference or 'the corpus itself: tiers are relative to it'}", file=sys.stderr)
    run = score.score_corpus(docs, cal, reference, a.stratify_by, guard=guard, top_n=a.top)
    if a.out:
        readers.write_run(run, a.out)
    if a.report:
        kind = {"html": "html", "json": "json"}.get(a.report.rsplit(".", 1)[-1], "markdown")
        _put(report.RENDERERS[kind](run.meta, run.top), a.report)
    print(report.render_markdown(run.meta, run.top))
    return 0 if run.meta["n_documents"] else 1


def _dedup(a, docs) -> int:
    from pyspark.sql import functions as F

    from .operators import dedup
    from .sources import readers

    found = dedup.near_duplicates(docs, a.threshold)
    if a.out:
        readers.write_jsonl(found.rows, a.out)
    s = dedup.summary(found).first().asDict()
    print(json.dumps(s))
    some = found.rows.where(F.col("cluster") < a.top).groupBy("cluster").agg(F.first("cluster_size").alias("size"), F.min("doc_id").alias("example")).orderBy("cluster")
    for r in some.collect():
        print(f"{r['size']:6}  {r['example']}")
    return 0 if s["compared"] + s["short"] else 1


def _run(a) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import score
    from .sources import readers

    spark = SparkSession.builder.appName("corpuscope").getOrCreate()
    if a.verb in ("explain", "report"):
        rows, told = readers.load_run(spark, a.run)
        if a.verb == "report":
            _put(report.RENDERERS[a.format](told["meta"], told["top"]), a.output)
            return 0
        found = rows.where(F.col("doc_id").cast("string") == a.doc_id).limit(1).collect()
        print(report.explain(found[0].asDict(recursive=True)) if found else f"no document {a.doc_id}")
        return 0 if found else 1

    def grouped(docs):
        """The field to stratify by as a column of its own."""
        by = getattr(a, "stratify_by", None)
        return docs.withColumn(by, F.col("meta")[by]) if by and by not in docs.columns else docs

    if a.corpus == "-":
        docs = readers.read_stdin(spark, sys.stdin.read(), a.text_field, a.min_chars)
        docs = docs.limit(a.limit) if a.limit is not None else docs
    else:
        docs = readers.read_corpus(spark, a.corpus, a.text_field, a.min_chars, a.limit)
    docs = grouped(docs)
    if a.verb == "dedup":
        return _dedup(a, docs)
    reference = grouped(readers.read_corpus(spark, a.reference, a.text_field)) if a.reference else None
    if a.verb == "calibrate":
        run = score.calibrate_corpus(docs, guard=not a.allow_non_english, reference=reference, likely_target=a.likely_target, stratify_by=a.stratify_by, source=a.corpus)
        run.calibration.save(a.out)
        print(json.dumps({"alpha": run.calibration.meta["alpha"], "evaluation": run.calibration.meta["evaluation"], "notes": run.notes}))
        return 0
    return {"profile": _profile, "inspect": _inspect, "score": _score}[a.verb](a, docs, reference)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.verb == "families":
        print(json.dumps(registry.listing(), indent=1))
        return 0
    from .operators.calibrate import CalibrationError
    from .sources.readers import CorpusError

    try:
        return _run(a)
    except (CorpusError, CalibrationError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
