"""Driver-side documents from small aggregates: report, curves, public pages."""

from __future__ import annotations

import html
import json

from ..sources import places
from ..sources.sinks import write_json, write_text

NOTICE = "Pages list public integrity signals and notices; they are no finding of misconduct."


def number(x, digits: int = 3) -> str:
    return "-" if x is None else f"{x:.{digits}g}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) else str(x)


def table(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(number(c) for c in cells) + " |"
    return "\n".join([line(head), "|" + " --- |" * len(head), *map(line, rows)])


def best_run(runs: list[dict], metric: str = "ap") -> dict | None:
    """The run with the largest value; missing values come last, ties go to the first."""
    return max(runs, key=lambda r: float("-inf") if r.get(metric) is None else r[metric], default=None)


def pivot(rows: list[dict], row: str, column: str, value: str, columns: list[str]) -> list[list]:
    cells = {(r[row], r[column]): r[value] for r in rows}
    return [[k, *[cells.get((k, c)) for c in columns]] for k in sorted({r[row] for r in rows})]


def markdown_report(summary: dict, splits: list[dict], violations: int, runs: list[dict]) -> str:
    parts = ["# Experiment report", "", "## Corpus", "", table(["count", "value"], [[k, v] for k, v in sorted(summary.items()) if not isinstance(v, dict)])]
    for name in ("subfield_counts", "notice_status_counts"):
        parts += ["", f"## {name.replace('_', ' ')}", "", table(["value", "n"], [[k, v] for k, v in sorted(summary.get(name, {}).items())])]
    parts += ["", "## Splits", "", table(["task", "part", "n"], [[r["task_name"], r["part"], r["n"]] for r in splits])]
    parts += ["", "## Leakage audit", "", f"{violations} violations."]
    if runs:
        names = sorted({r["task_name"] for r in runs})
        parts += ["", "## Average precision by model", "", table(["model", *names], pivot(runs, "model", "task_name", "ap", names))]
        top = best_run(runs)
        parts += ["", f"Best: {top['model']} on {top['task_name']}, {number(top['ap'])}."]
    return "\n".join(parts) + "\n"


def replace_block(text: str, name: str, body: str) -> str:
    """text with what stands between the block's markers replaced; the block is added at the end where it is missing."""
    first, last = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = f"{first}\n{body}\n{last}"
    if first in text and last in text:
        return text[: text.index(first)] + block + text[text.index(last) + len(last) :]
    return text.rstrip("\n") + f"\n\n{block}\n"


def protocol(summary: dict, columns: tuple[str, ...]) -> str:
    """What two reviewers do with the adjudication queue."""
    steps = ("Read the record and the sources that it links to.", "Decide whether its weak label points the right way.", "Check that the public wording is factual, cautious and linked to a source.", "Take disagreements to a consensus review.")
    labels = (("official_notice", "metadata of the notice may be public"), ("curator_review", "signals need a curator before they are shown"), ("none_known_at_snapshot", "no public signal or notice at the snapshot"))
    parts = ["# Adjudication protocol", "", *[f"{k}. {x}" for k, x in enumerate(steps, 1)], "", "Fields to fill in: " + ", ".join(f"`{c}`" for c in columns) + ".", ""]
    parts += [f"- `{k}`: {v}" for k, v in labels] + ["", table(["pack", "rows"], [["requested", summary["requested_sample_size"]], ["written", summary["rows_written"]]])]
    return "\n".join(parts) + "\n"


def results_document(summary: dict, violations: int, runs: list[dict], robustness: list[dict], task_b: dict, label: str, snapshot_id: str) -> str:
    """Results of a release on real data: corpus, audit, both tasks and robustness over splits."""
    counts = [[k, v] for k, v in sorted(summary.items()) if not isinstance(v, dict)]
    head = ["task", "model", "ap", "lo", "hi", "recall_1", "recall_5", "ece"]
    parts = [f"# Results, {label}", "", f"Snapshot `{snapshot_id}`.", "", "## Corpus", "", table(["count", "value"], counts), "", f"Leakage audit: {violations} violations.", "", "## Task A", ""]
    parts.append(table(head, [[r["task_name"], r["model"], *[r.get(c) for c in head[2:]]] for r in runs]))
    splits = sorted({r["task_name"] for r in robustness})
    parts += ["", "## Robustness, average precision", "", table(["model", *splits], pivot(robustness, "model", "task_name", "ap", splits))]
    parts += ["", "## Task B", "", table(["metric", "value"], [[k, v] for k, v in sorted(task_b.items())])]
    return "\n".join(parts) + "\n"


def readme_block(text: str, summary: dict, violations: int, runs: list[dict], task_b: dict, document: str) -> str:
    """A readme with its managed block brought up to date."""
    top = best_run(runs)
    rows = [["records", summary.get("record_count")], ["leakage violations", violations], ["best task A run", f"{top['model']} on {top['task_name']}, {number(top['ap'])}" if top else None], ["task B macro F1", task_b.get("macro_f1")]]
    return replace_block(text, "results", table(["", ""], rows) + f"\n\nMore in [{document}]({document}).")


def curve_svg(series: dict[str, list[tuple[float, float]]], x_label: str, y_label: str, diagonal: bool = False) -> str:
    """Lines within the unit square."""
    size, pad = 320, 40
    at = lambda x, y: f"{pad + x * size:.1f},{pad + (1 - y) * size:.1f}"
    colours = ("#1b6ca8", "#c0392b", "#27865a", "#7d4fa0")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size + 2 * pad + 140} {size + 2 * pad}" font-family="sans-serif" font-size="12">', f'<rect x="{pad}" y="{pad}" width="{size}" height="{size}" fill="none" stroke="#999"/>']
    if diagonal:
        out.append(f'<polyline points="{at(0, 0)} {at(1, 1)}" fill="none" stroke="#bbb" stroke-dasharray="4"/>')
    for k, (name, points) in enumerate(series.items()):
        colour = colours[k % len(colours)]
        out.append(f'<polyline points="{" ".join(at(*p) for p in points)}" fill="none" stroke="{colour}" stroke-width="2"/>')
        out.append(f'<text x="{size + pad + 10}" y="{pad + 16 * (k + 1)}" fill="{colour}">{html.escape(name)}</text>')
    out.append(f'<text x="{pad + size / 2}" y="{size + pad + 28}" text-anchor="middle">{html.escape(x_label)}</text>')
    out.append(f'<text x="12" y="{pad + size / 2}" text-anchor="middle" transform="rotate(-90 12 {pad + size / 2})">{html.escape(y_label)}</text></svg>')
    return "\n".join(out)


def calibration_svg(cells: list[dict]) -> str:
    series: dict[str, list[tuple[float, float]]] = {}
    for c in sorted(cells, key=lambda c: (c["model"], c["bin"])):
        series.setdefault(c["model"], []).append((c["mean_score"], c["positive_rate"]))
    return curve_svg(series, "mean score", "share of positives", diagonal=True)


def precision_recall_svg(points: list[dict]) -> str:
    series: dict[str, list[tuple[float, float]]] = {}
    for p in sorted(points, key=lambda p: (p["model"], p["recall"])):
        series.setdefault(p["model"], []).append((p["recall"], p["precision"]))
    return curve_svg(series, "recall", "precision")


def _page(title: str, body: str, depth: int = 0) -> str:
    up = "../" * depth
    links = "".join(f'<a href="{up}{f}">{n}</a> ' for f, n in (("index.html", "Records"), ("policy.html", "Policy"), ("changes.html", "Changes")))
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><link rel="stylesheet" href="{up}styles.css"><nav>{links}</nav><main><h1>{html.escape(title)}</h1>{body}<p class="notice">{NOTICE}</p></main></html>\n'


def build_site(public: list[dict], out: str, summary: dict) -> int:
    """Static pages of publishable records (dicts with public evidence and safe links only); pages of records that are gone are removed."""
    e = lambda x: html.escape(str(x if x is not None else ""))
    label = lambda s: s.replace("_", " ").capitalize()
    public = sorted(public, key=lambda r: (str(r["publication_year"]), r["doi"]))
    cards = []
    keep = set()
    for r in public:
        keep.add(f"{r['internal_id']}.html")
        items = "".join(f'<li><a href="{e(s["source_url"])}" rel="noopener">{e(s["source_name"])}</a>, {e(s["event_date"])}: {e(label(s["observed_label"]))}</li>' for s in r["provenance"])
        body = f"<p>{e(r['venue'])}, {e(r['publication_year'])}</p><p>{e(r['public_summary'])}</p><p>{e(label(r['notice_status']))}</p><ul>{items}</ul>"
        write_text(f"{out}/records/{r['internal_id']}.html", _page(r["title"], body, 1))
        cards.append(f'<li data-status="{e(r["notice_status"])}" data-text="{e((r["title"] + " " + r["doi"]).lower())}"><a href="records/{e(r["internal_id"])}.html">{e(r["title"])}</a> {e(label(r["notice_status"]))}</li>')
    for old in places.names(places.join(out, "records"), recursive=False):
        if old.endswith(".html") and old not in keep:
            places.remove(places.join(out, "records", old))
    options = "".join(f'<option value="{e(s)}">{e(label(s))}</option>' for s in sorted({r["notice_status"] for r in public}))
    script = "const q=document.getElementById('q'),s=document.getElementById('s');function f(){for(const x of document.querySelectorAll('#list li'))x.hidden=!(x.dataset.text.includes(q.value.toLowerCase())&&(!s.value||x.dataset.status===s.value))}q.oninput=s.onchange=f;"
    write_text(f"{out}/index.html", _page("Records", f'<input id="q" placeholder="Search"><select id="s"><option value="">All</option>{options}</select><ul id="list">{"".join(cards)}</ul><script>{script}</script>'))
    write_text(f"{out}/policy.html", _page("Policy", "<p>Only records with an official notice are shown. Signals from the community go to curators and are never shown here. Records without a notice are called none known at snapshot.</p>"))
    write_text(f"{out}/changes.html", _page("Changes", "<ul>" + "".join(f"<li>{e(label(k))}: {e(v)}</li>" for k, v in sorted(summary.items()) if not isinstance(v, dict)) + "</ul>"))
    write_text(f"{out}/styles.css", "body{font-family:sans-serif;margin:2rem auto;max-width:50rem}nav a{margin-right:1rem}.notice{color:#666;font-size:.9em}li{margin:.3rem 0}\n")
    write_json(f"{out}/records.json", json.loads(json.dumps(public, default=str)))
    return len(public)
