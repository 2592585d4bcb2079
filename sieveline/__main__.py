"""Command line: python -m sieveline <verb> --root DIR ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sieveline")
    p.add_argument("--root", default=".")
    p.add_argument("--snapshot-date", default=None)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("register-snapshot", "ingest-snapshot", "materialize-canonical", "validate-snapshot", "build-core"):
        s = sub.add_parser(verb)
        s.add_argument("--snapshot-id", required=verb != "build-core")
        if verb == "register-snapshot":
            s.add_argument("--raw-root", required=True)
            s.add_argument("--label", default="")
        if verb == "build-core":
            s.add_argument("--source-dir", default=None)  # articles, official_notices and external_signals as JSON lines
        if verb == "ingest-snapshot":
            s.add_argument("--collector", required=True)
            s.add_argument("--early-scope", action="store_true")
            s.add_argument("--allowlist", default=None)  # identifiers that pass the score test, one a line
            s.add_argument("--progress-seconds", type=float, default=30.0)  # between signs of life; 0 for none
        if verb in ("ingest-snapshot", "materialize-canonical"):
            s.add_argument("--trust-registered", action="store_true")
    for verb in ("build-splits", "audit-leakage", "train-task-a", "train-task-b", "make-adjudication-set", "build-site", "build-report", "queries"):
        s = sub.add_parser(verb)
        if verb == "train-task-a":
            s.add_argument("--months", type=int, default=12)
            s.add_argument("--robust", action="store_true")  # on every split of the task
        if verb == "make-adjudication-set":
            s.add_argument("--sample-size", type=int, default=500)
    def verb(name: str, *required: str):
        s = sub.add_parser(name)
        for r in required:
            s.add_argument(f"--{r}", required=True)
        return s

    allow = verb("build-openalex-scope-allowlist", "snapshot-id", "output-path")
    allow.add_argument("--skip-pubmed", action="store_true")
    verb("scaffold-real-ingest", "raw-dir")
    verb("normalize-real-sources", "raw-dir", "normalized-dir")
    verb("extract-crossref-official-notices", "archive-path", "output-path", "snapshot-label")
    verb("extract-retraction-watch-csv", "source-csv", "output-path", "snapshot-label")
    stage = verb("stage-vendor-archive", "vendor-root", "raw-root", "snapshot-label")
    stage.add_argument("--mode", default="copy", choices=["copy", "symlink"])
    for s in (stage, verb("validate-vendor-archive", "vendor-root", "snapshot-label")):
        s.add_argument("--allow-missing-crossref", action="store_true")
    verb("build-results-v0-2", "snapshot-label", "snapshot-id", "output-path")
    verb("build-readme-v0-2", "output-path", "results-doc-path")
    verb("bootstrap-sample", "source-dir")
    verb("demo")
    a = p.parse_args(argv)
    if a.verb == "build-core" and not (a.snapshot_id or a.source_dir):
        p.error("build-core needs --snapshot-id or --source-dir")

    from pyspark.sql import SparkSession

    from .plans import catalog, report, vendor
    from .plans.workflow import Workflow
    from .schemas import SNAPSHOT_DATE
    from .sources import files, places
    from .sources.sinks import summary_payload, write_text

    if a.verb == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    day = a.snapshot_date or SNAPSHOT_DATE
    if a.verb == "validate-vendor-archive":
        out = vendor.check_archive(a.vendor_root, a.snapshot_label, a.allow_missing_crossref)
        print(json.dumps(out, indent=2))
        return int(not out["passed"])
    if a.verb in ("scaffold-real-ingest", "bootstrap-sample"):
        print(json.dumps(vendor.scaffold(a.raw_dir) if a.verb == "scaffold-real-ingest" else vendor.bootstrap_sample(a.source_dir), indent=2))
        return 0
    w = Workflow(SparkSession.builder.getOrCreate(), a.root)
    out, code = None, 0
    if a.verb == "register-snapshot":
        out = {"files": w.register(a.snapshot_id, a.raw_root, day, label=a.label)}
    elif a.verb == "ingest-snapshot":
        allowed = files.allowlist(w.spark, a.allowlist) if a.allowlist else None
        out = w.ingest(a.snapshot_id, a.collector, a.early_scope, allowed, a.trust_registered, progress=lambda event: print("ingest_progress", json.dumps(event), file=sys.stderr, flush=True), every=a.progress_seconds)
    elif a.verb == "materialize-canonical":
        out = w.materialize(a.snapshot_id, a.trust_registered)
    elif a.verb == "validate-snapshot":
        out = w.validate(a.snapshot_id)
        code = int(not out["passed"])
    elif a.verb == "build-core":
        if a.source_dir:
            sources = files.source_bundle(w.spark, a.source_dir)
        else:
            sources = (w.canonical(a.snapshot_id, "articles"), w.canonical(a.snapshot_id, "official_notices"), w.signals(a.snapshot_id))
        out = w.build_core(*sources, day)
        code = int(not out["record_count"])
    elif a.verb == "build-splits":
        out = w.build_splits()
    elif a.verb == "audit-leakage":
        out = {"violations": w.audit(day)}
        code = int(out["violations"] > 0)
    elif a.verb == "train-task-a":
        out = w.train_task_a(a.months, a.robust)
    elif a.verb == "train-task-b":
        out = w.train_task_b()
    elif a.verb == "make-adjudication-set":
        out = {"rows": w.adjudication(a.sample_size)}
    elif a.verb == "build-site":
        out = {"pages": w.build_site(summary_payload(w.records()))}
    elif a.verb == "build-openalex-scope-allowlist":
        out = w.build_allowlist(a.snapshot_id, a.output_path, not a.skip_pubmed)
    elif a.verb == "extract-crossref-official-notices":
        out = {"row_count": vendor.write_notices(vendor.archive_notices(w.spark, a.archive_path, a.snapshot_label), a.output_path)}
    elif a.verb == "extract-retraction-watch-csv":
        out = {"row_count": vendor.write_notices(vendor.retraction_notices(w.spark, a.source_csv, a.snapshot_label), a.output_path)}
    elif a.verb == "stage-vendor-archive":
        out = vendor.stage_archive(w.spark, a.vendor_root, a.raw_root, a.snapshot_label, a.mode, a.allow_missing_crossref)
    elif a.verb == "normalize-real-sources":
        out = w.normalize_sources(a.raw_dir, a.normalized_dir)
    elif a.verb in ("build-results-v0-2", "build-readme-v0-2"):
        runs, robust = ([r for m in (12, 36) for r in w.train_task_a(m, flag)] for flag in (False, True))
        summary, wrong, task_b = summary_payload(w.records()), w.audit(day), w.train_task_b()
        at = Path(a.output_path)
        if a.verb == "build-results-v0-2":
            text = report.results_document(summary, wrong, runs, robust, task_b, a.snapshot_label, a.snapshot_id)
        else:
            text = report.readme_block(at.read_text(encoding="utf-8") if at.exists() else "", summary, wrong, runs, task_b, a.results_doc_path)
        write_text(at, text)
        out = {"written": str(at)}
    elif a.verb == "demo":
        source = places.join(a.root, "sources")
        vendor.bootstrap_sample(source)
        out = {"report": w.demo(*files.source_bundle(w.spark, source), day)}
    elif a.verb == "build-report":
        out = {"report": w.build_report(summary_payload(w.records()), w.build_splits(), w.audit(day), w.train_task_a(12) + w.train_task_a(36))}
    print(json.dumps(out, default=str, indent=2))
    return code


if __name__ == "__main__":
    sys.exit(main())
