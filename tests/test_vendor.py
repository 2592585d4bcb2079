"""Vendor archives, the allowlist, incremental ingest, and verbs of the command line."""

import gzip
import hashlib
import io
import json
import shutil
import tarfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from sieveline.__main__ import main
from sieveline.operators import manifest, normalize
from sieveline.operators.manifest import SnapshotChanged
from sieveline.plans import vendor
from sieveline.plans.workflow import Workflow
from sieveline.sources import files

from test_workflow import write_raw

LABEL = "2024-02-freeze"


def write_archive(root):
    for d in ("openalex/2024-02", "crossref/2024-02", "pubmed/baseline/2024", "pubmed/updatefiles/2024-02", "retraction_watch/2024-02-20", "retraction_watch/2024-03-01"):
        (root / d).mkdir(parents=True)
        for s in vendor.SIDECARS:
            (root / d / s).write_text("x")
    with gzip.open(root / "openalex/2024-02/part_0.gz", "wt") as f:
        f.write(json.dumps({"doi": "10.5/a", "publication_year": 2015}) + "\n")
    records = [
        {"doi": "10.5/a", "notice_type": "retraction", "notice_date": "2024-01-05", "source_url": "http://n"},
        {"doi": "10.5/a", "notice_type": "retraction", "notice_date": "2024-01-05", "source_url": "http://n"},
        {"doi": "10.5/b", "notice_type": "retraction", "notice_date": "2024-03-05", "source_url": "http://n"},
        {"doi": "10.5/c", "notice_type": "retraction", "notice_date": "soon"},
        {"DOI": "10.9/n", "update-to": [{"label": "Correction", "DOI": "10.5/d", "updated": {"x": 1}, "date": "2024-02-29"}]},
    ]
    data = "\n".join(map(json.dumps, records)).encode()
    with tarfile.open(root / "crossref/2024-02/all.json.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("0.jsonl")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    for d in ("baseline/2024", "updatefiles/2024-02"):
        (root / "pubmed" / d / "p.xml").write_text("<PubmedArticleSet/>")
    csv = "OriginalPaperDOI,RetractionNature,RetractionDate,URLS\n10.5/A,Retraction,2024-01-09,http://r/1;http://r/2\n10.5/a,Retraction,2024-01-09,http://r/1\nunavailable,Retraction,2024-01-09,\n10.5/z,Retraction,2025-01-09,u\n10.5/e,Reinstatement,2024-01-09,u\n"
    (root / "retraction_watch/2024-02-20/retraction_watch.csv").write_text(csv)


def test_freeze_end():
    assert vendor.freeze_end("2024-02-freeze") == date(2024, 2, 29) and vendor.freeze_end("2023-02") == date(2023, 2, 28)
    for bad in ("2024-13-freeze", "2024", "x"):
        with pytest.raises(ValueError):
            vendor.freeze_end(bad)


def test_stage_and_check(spark, tmp_path):
    root, raw = tmp_path / "vendor", tmp_path / "raw"
    write_archive(root)
    assert vendor.check_archive(root, LABEL)["passed"]
    got = vendor.stage_archive(spark, root, raw, LABEL, mode="symlink")
    assert got == {"openalex": 1, "crossref": 2, "retraction_watch": 1, "pubmed_baseline": 1, "pubmed_updatefiles": 1}
    rows = files.csv_rows(spark, f"file://{raw}/official_notices/crossref_2024-02").collect()
    assert [(r.doi, r.notice_type, r.notice_date, r.source_name, r.rights_status) for r in rows] == [("10.5/a", "retraction", "2024-01-05", "Crossref Metadata Plus", "metadata_only"), ("10.9/n", "major_correction", "2024-02-29", "Crossref Metadata Plus", "metadata_only")]
    assert "part_0.gz" in (raw / "openalex" / "sha256_manifest.tsv").read_text() and json.loads((raw / "pubmed" / "source_versions.json").read_text())["label"] == LABEL
    w = Workflow(spark, tmp_path / "data")
    w.register("v", str(raw))
    assert w.ingest("v", "local_notice_export")["normalized"] == 3 and w.ingest("v", "openalex_bulk")["normalized"] == 1
    shutil.rmtree(root / "crossref")
    assert vendor.check_archive(root, LABEL)["problems"] == {"crossref": ["folder"]}
    assert vendor.check_archive(root, LABEL, open_data_only=True)["passed"]
    with pytest.raises(FileNotFoundError):
        vendor.stage_archive(spark, root, raw, LABEL)
    (root / "pubmed/baseline/2024/source_versions.json").unlink()
    assert main(["validate-vendor-archive", "--vendor-root", str(root), "--snapshot-label", LABEL, "--allow-missing-crossref"]) == 1


def test_ingest_again_for_another_allowlist_and_for_lost_output(spark, tmp_path):
    raw = tmp_path / "raw"
    write_raw(raw)
    w = Workflow(spark, tmp_path / "data")
    w.register("s", str(raw))
    events = []
    none = spark.createDataFrame([], "doi string")
    first = w.ingest("s", "openalex_bulk", True, none, progress=events.append)
    assert first["scope_skip"] >= 2 and [e["event"] for e in events] == ["start", "file_completed", "finished"]
    assert w.ingest("s", "openalex_bulk", True, none) == {"files": 0}
    one = spark.createDataFrame([("10.5/fourth",)], "doi string")
    again = w.ingest("s", "openalex_bulk", True, one)
    assert again["files"] == 1 and again["normalized"] == first["normalized"] + 1
    assert w.ingest("s", "openalex_bulk", True, one) == {"files": 0}
    shutil.rmtree(tmp_path / "data" / "normalized" / "s" / "openalex_bulk")
    assert w.ingest("s", "openalex_bulk", True, one)["files"] == 1
    (raw / "pubmed" / "later.jsonl").write_text("{}\n")
    with pytest.raises(SnapshotChanged, match="later.jsonl"):
        w.ingest("s", "pubmed_index", trusted=True)


def test_allowlist_verb(spark, tmp_path):
    raw = tmp_path / "raw"
    write_raw(raw)
    w = Workflow(spark, tmp_path / "data")
    w.register("s", str(raw))
    out = f"file://{tmp_path}/allow"
    assert w.build_allowlist("s", out) == {"doi_count": 4, "rows_by_collector": {"local_notice_export": 3, "pubmed_index": 1}, "include_pubmed": True}
    assert sorted(r.doi for r in files.allowlist(spark, out).collect()) == ["10.5/first", "10.5/fourth", "10.5/orphan", "10.5/second"]
    assert w.build_allowlist("s", out, include_pubmed=False)["doi_count"] == 3


def test_lines_of_two_csv_headers_and_split_files(spark, tmp_path):
    raw = tmp_path / "raw" / "official_notices"
    raw.mkdir(parents=True)
    (raw / "a.csv").write_text("doi,notice_type,notice_date\n10.5/a,retraction,2020-01-01\n10.5/b,nonsense,2020-01-01\n")
    (raw / "b +x.csv").write_text("notice_date,doi,notice_type\n2020-01-02,10.5/c,retraction\n")
    w = Workflow(spark, tmp_path / "data")
    w.register("s", str(tmp_path / "raw"))
    assert w.ingest("s", "local_notice_export")["normalized"] == 2
    assert [(r.line_number, r.error_code) for r in w.row_errors("s", "local_notice_export").collect()] == [(3, "unknown_notice_type")]
    got = {r.doi: str(r.notice_date) for r in w.normalized("s", "local_notice_export").collect()}
    assert got == {"10.5/a": "2020-01-01", "10.5/c": "2020-01-02"}


def test_hashes_are_read_in_blocks(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    blobs = {"a.gz": b"", "d/b +c.GZ": b"x" * 5000, "no.txt": b"y"}
    for name, data in blobs.items():
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: (r.content_sha256, r.size_bytes) for r in manifest.scan_files(spark, f"file://{tmp_path}", (".gz",)).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in blobs.items() if n != "no.txt"}


def test_references_of_xml(spark):
    df = spark.createDataFrame([("a&lt;b&#62;c&#x26;d&amp;lt;&nbsp;&#xe9;&#0;& x",), ("",), (None,)], "x string")
    assert [r.y for r in df.select(files.unescape(F.col("x")).alias("y")).collect()] == ["a<b>c&d&lt;&nbsp;\u00e9&#0;& x", "", None]


def test_documents_lines_and_unknown_sources(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert [r.a for r in files.json_document(spark, f"file://{tmp_path}/x.json", "a int").collect()] == [1, 2]
    (tmp_path / "l.jsonl").write_text("{}\n\n  \n{}\n")
    assert files.count_lines(spark, f"file://{tmp_path}/l.jsonl") == 2
    c = files.classify_sources(spark.createDataFrame([("/x/1", ""), ("/pubmed/2", "")], "path string, head string"))
    assert [tuple(r) for r in files.unknown_sources(c).collect()] == [("/x/1", "", "no_rule")]


def test_demo_and_robustness_on_every_holdout(spark, tmp_path):
    assert main(["--root", str(tmp_path), "--snapshot-date", "2024-06-30", "demo"]) == 0
    robust = json.loads((tmp_path / "release" / "task_a_12m_robustness.json").read_text())
    plain = json.loads((tmp_path / "release" / "task_a_12m.json").read_text())
    assert {r["model"] for r in plain} == {"metadata", "text", "fusion"} and {"lo", "hi", "scan", "ap_by_subfield", "calibration_curve"} <= set(plain[0])
    splits = {r["task_name"] for r in robust}
    assert "task_a_12m" in splits and len(splits) > 1 and all(s == "task_a_12m" or s.endswith("_holdout") for s in splits)
    for r in plain:
        assert next(x for x in robust if (x["task_name"], x["model"]) == ("task_a_12m", r["model"])) == r
    top = Workflow(spark, tmp_path).feature_importance(12, 5)
    assert len(top) == 5 and all("weight" in x for x in top)
    assert main(["--root", str(tmp_path), "--snapshot-date", "2024-06-30", "build-results-v0-2", "--snapshot-label", LABEL, "--snapshot-id", "s", "--output-path", str(tmp_path / "results.md")]) == 0
    assert "## Robustness" in (tmp_path / "results.md").read_text()
    assert (tmp_path / "release" / "adjudication_protocol.md").exists()


def test_scaffold(tmp_path):
    assert main(["scaffold-real-ingest", "--raw-dir", str(tmp_path / "raw")]) == 0
    assert all((tmp_path / "raw" / n).exists() for n in vendor.EXAMPLES)
    assert normalize.scope_allowlist is not None
