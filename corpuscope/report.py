"""Reports of a run (X1, X2): Markdown, JSON, self-contained HTML, and one document explained."""

from __future__ import annotations

import html
import json

from .constants import TIERS

CAVEATS = (
    "A score ranks documents against clean text of the same kind; it is no proof of origin.",
    "Rates depend on the calibration corpus; calibrate on text like the audited one.",
    "Documents below 50 words, or evidently not English, are not scored.",
)


def notable(doc: dict, most: int = 5) -> list[dict]:
    return [e for e in doc.get("evidence") or [] if e["strength"] >= 1.0][:most]


def render_markdown(meta: dict, top: list[dict]) -> str:
    out = ["# Corpus audit", "", f"{meta['n_documents']} documents, {meta['n_analysable']} scored, mode {meta['mode']}.", "", "| Tier | Documents |", "|-|-|"]
    out += [f"| {t} | {meta['tiers'].get(t, 0)} |" for t in TIERS]
    out += ["", "## Highest scores", ""]
    for d in top:
        why = "; ".join(f"{e['signal']} {e['deviation']} ({e['value']})" for e in notable(d))
        out.append(f"- `{d['doc_id']}` {d['tier']} {d['score']}: {why or 'no single signal stands out'}")
    out += ["", "## Notes", "", *[f"- {n}" for n in [*meta.get("notes", []), *CAVEATS]]]
    return "\n".join(out) + "\n"


def render_json(meta: dict, top: list[dict]) -> str:
    return json.dumps({"meta": meta, "top": top, "caveats": CAVEATS}, sort_keys=True, default=str, indent=1)


def histogram_svg(bins: dict[str, int]) -> str:
    most = max(bins.values(), default=1) or 1
    bars = "".join(f'<rect x="{12 * int(b)}" y="{60 - 60 * n / most:.1f}" width="10" height="{60 * n / most:.1f}"><title>{5 * int(b)}-{5 * int(b) + 5}: {n}</title></rect>' for b, n in sorted(bins.items(), key=lambda x: int(x[0])))
    return f'<svg width="240" height="60" role="img" aria-label="scores">{bars}</svg>'


_STYLE = "body{font:15px sans-serif;max-width:60em;margin:2em auto}td,th{padding:.2em .8em;text-align:left}td.n{text-align:right}"


def _rows(rows: list[list], head: list[str]) -> str:
    cells = lambda row, tag: "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in row)
    return f"<table><tr>{cells(head, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</table>"


def render_html(meta: dict, top: list[dict]) -> str:
    """One page that needs no other file; whatever comes from documents is escaped."""
    why = lambda d: "; ".join(f"{e['signal']} {e['deviation']} ({e['value']})" for e in notable(d))
    parts = [
        "<!doctype html><meta charset=utf-8><title>Corpus audit</title>", f"<style>{_STYLE}</style><h1>Corpus audit</h1>",
        f"<p>{meta['n_documents']} documents, {meta['n_analysable']} scored, mode {html.escape(str(meta['mode']))}.</p>",
        _rows([[t, meta["tiers"].get(t, 0)] for t in TIERS], ["Tier", "Documents"]), "<h2>Scores</h2>", histogram_svg(meta.get("histogram", {})),
    ]
    if meta.get("labels"):
        parts += ["<h2>Labels</h2>", _rows([[label, *[n.get(t, 0) for t in TIERS]] for label, n in sorted(meta["labels"].items())], ["Label", *TIERS])]
    parts += ["<h2>Highest scores</h2>", _rows([[d["doc_id"], d["tier"], d["score"], why(d) or "no single signal stands out"] for d in top], ["Document", "Tier", "Score", "Evidence"])]
    parts += ["<h2>Notes</h2><ul>", *[f"<li>{html.escape(n)}</li>" for n in [*meta.get("notes", []), *CAVEATS]], "</ul>"]
    return "\n".join(parts) + "\n"


RENDERERS = {"markdown": render_markdown, "json": render_json, "html": render_html}


def explain(doc: dict) -> str:
    """Families by distance from the middle, with bounds and sides, and all kept evidence."""
    out = [f"{doc['doc_id']}: {doc['tier']}, score {doc['score']}, {doc['n_words']} words"]
    if doc.get("reason"):
        out.append(f"  not scored: {doc['reason']}")
    fams = {f: r for f, r in (doc.get("families") or {}).items() if r and r.get("z") is not None}
    for f, r in sorted(fams.items(), key=lambda x: -abs(x[1]["z"])):
        out.append(f"  {f}: z {r['z']} of {r['n_signals']} signals, fires below {r.get('threshold_low')} or above {r.get('threshold')}" + (f"; fired {r['side']}" if r.get("fired") else ""))
    out += [f"    {e['signal']}: {e['value']} ({e['deviation']} typical, z {e['z']}): {e['description']}" for e in doc.get("evidence") or []]
    return "\n".join(out)
