"""A raw snapshot through all stages, on rows of our own."""

import gzip
import json
import xml.etree.ElementTree as ET
from datetime import date

import pytest
from pyspark.sql import functions as F

from sieveline.operators.manifest import SnapshotChanged
from sieveline.plans import report
from sieveline.plans.workflow import Workflow


def write_raw(root):
    for d in ("openalex", "official_notices", "pubmed"):
        (root / d).mkdir(parents=True)
    works = [
        {"doi": "10.5/first", "type": "article", "publication_date": "2015-02-03", "title": "One", "abstract": "a", "openalex_life_science_score": 0.9, "authorships": [{"author": {"display_name": "Kim"}}], "venue": "V"},
        {"doi": "https://doi.org/10.5/second", "publication_year": 2018, "openalex_life_science_score": 0.8},
        {"doi": "doi:10.5/second", "publication_date": "2018-06-01", "title": "Two", "abstract": "b", "openalex_life_science_score": 0.8, "authorships": [{"author": {"display_name": "Kim"}}], "venue": "V"},
        {"ids": {"doi": "10.5/third"}, "publication_year": 2016, "type_crossref": "journal article", "primary_topic": {"subfield": {"display_name": "Genetics"}}},
        {"doi": "10.5/fourth", "publication_date": "2017-01-01", "abstract_inverted_index": {"x": [0]}, "openalex_life_science_score": 0.1},
        {"title": "no identifier"},
    ]
    with gzip.open(root / "openalex" / "works.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, works)) + "\n{broken\n")
    with gzip.open(root / "official_notices" / "official_notices.csv.gz", "wt") as f:
        f.write("doi,notice_type,notice_date,source_name,source_url\n10.5/first,retraction,2016-05-01,N,http://n/1\n10.5/second,expression of concern,2019-01-01,N,http://n/2\n10.5/orphan,retraction,2019-01-01,N,http://n/3\n10.5/first,praise,2019-01-01,N,u\n")
    (root / "pubmed" / "pubmed.xml").write_text("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal><Title>J</Title></Journal><ELocationID EIdType='doi'>10.5/FOURTH</ELocationID></Article><MeshHeadingList><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></PubmedArticleSet>")


def test_snapshot_to_release(spark, tmp_path):
    raw = tmp_path / "raw"
    write_raw(raw)
    w = Workflow(spark, tmp_path / "data")
    assert w.register("s1", str(raw)) == 3 and w.register("s1", str(raw)) == 3
    got = w.ingest("s1", "openalex_bulk")
    assert (got["files"], got["normalized"], got["quarantine"]) == (1, 5, 2)
    assert w.ingest("s1", "openalex_bulk") == {"files": 0}
    assert w.ingest("s1", "local_notice_export")["quarantine"] == 1 and w.ingest("s1", "pubmed_index")["normalized"] == 1
    assert w.store.error_counts("s1") == [
        {"collector_name": "local_notice_export", "error_code": "unknown_notice_type", "n": 1},
        {"collector_name": "openalex_bulk", "error_code": "bad_json", "n": 1},
        {"collector_name": "openalex_bulk", "error_code": "missing_doi", "n": 1},
    ]
    counts = w.materialize("s1")
    assert (counts["articles"], counts["official_notices"], counts["orphan_notices"], counts["duplicate_doi"], counts["pubmed_joins"]) == (4, 2, 1, 1, 1)
    a = {r.doi: r for r in w.canonical("s1", "articles").collect()}
    assert a["10.5/second"].publication_date == date(2018, 6, 1) and len(a["10.5/second"].source_lineage) == 2
    assert (a["10.5/second"].author_history_signal_count, a["10.5/second"].journal_history_signal_count, a["10.5/first"].author_history_signal_count) == (1, 1, 0)
    assert a["10.5/third"].task_a_date_bucket == "noisy_date" and a["10.5/fourth"].subfield == "biomedicine" and a["10.5/fourth"].is_pubmed_indexed
    assert w.validate("s1") == {"passed": True, "violations": {}, "mismatches": []}
    assert w.file_mismatches("s1").collect() == []
    (lost,) = (tmp_path / "data/normalized/s1/pubmed_index").glob("file_id=*")
    lost.rename(lost.with_name("file_id=other"))
    assert {(r.relative_path, r.recorded_rows, r.rows) for r in w.file_mismatches("s1").collect()} == {("pubmed/pubmed.xml", 1, 0), (None, 0, 1)}
    (raw / "pubmed" / "stray.jsonl").write_text("{}")
    got = w.validate("s1")
    assert not got["passed"] and got["mismatches"][:2] == ["file:not registered", "file:pubmed/pubmed.xml"] and "frozen:" in got["mismatches"][2]
    (raw / "pubmed" / "stray.jsonl").unlink()
    lost.with_name("file_id=other").rename(lost)
    assert {(r.error_code, r.line_number) for r in w.row_errors("s1", "openalex_bulk").collect()} == {("missing_doi", 6), ("bad_json", 7)}
    summary = w.build_core(w.canonical("s1", "articles"), w.canonical("s1", "official_notices"))
    assert summary["record_count"] == 4 and summary["auto_publish_count"] == 2 and w.audit() == 0
    assert w.build_site(summary) == 2 and len(list((tmp_path / "data" / "site" / "records").glob("*.html"))) == 2
    (raw / "pubmed" / "pubmed.xml").write_text("<PubmedArticleSet/>")
    with pytest.raises(SnapshotChanged, match="modified: pubmed/pubmed.xml"):
        w.ingest("s1", "pubmed_index")
    with pytest.raises(ValueError, match="other files"):
        w.register("s1", str(raw))


def test_demo_runs_all_stages(spark, tmp_path):
    rows = [(f"10.7/{i}", f"T{i} genome", "text", f"V{i % 3}", "P", date(2005 + i % 12, 1 + i % 12, 1), "day", "article", ["biology", "biomedicine"][i % 2], True, 0.9, [f"A{i % 5}"], ["I"], i, 0, 0, "open") for i in range(48)]
    a = spark.createDataFrame(rows, "doi string, title string, abstract string, venue string, publisher string, publication_date date, publication_date_precision string, work_type string, subfield string, is_pubmed_indexed boolean, openalex_life_science_score double, authors array<string>, institutions array<string>, references_count long, author_history_signal_count long, journal_history_signal_count long, oa_status string")
    n = a.where("references_count % 3 = 0").select("doi", F.lit("retraction").alias("notice_type"), F.date_add("publication_date", 90).alias("notice_date"), F.lit("N").alias("source_name"), F.lit("http://n").alias("source_url"))
    s = a.where("references_count % 5 = 1").select("doi", F.lit("image_issue").alias("tag"), F.date_add("publication_date", 400).alias("signal_date"), F.lit("S").alias("source_name"), F.lit("http://s").alias("source_url"))
    text = Workflow(spark, tmp_path).demo(a, n, s)
    assert "0 violations." in text and "| fusion |" in text and "task_b_accuracy" in text
    assert "image_issue" not in (tmp_path / "site" / "records.json").read_text()
    queue = spark.read.json(f"file://{tmp_path}/release/curation_queue").collect()
    assert queue and all("image_issue" in r.extension_tags for r in queue) and not any("curation" in p.name for p in (tmp_path / "site").rglob("*"))
    for kind in ("precision_recall", "calibration"):
        for split in ("task_a_12m", "task_a_36m", "task_a_12m_venue_holdout"):
            svg = tmp_path / "release" / "curves" / f"{split}_{kind}.svg"
            assert not svg.exists() or {"metadata", "text", "fusion"} <= set(ET.fromstring(svg.read_text()).itertext())
        assert (tmp_path / "release" / "curves" / f"task_a_12m_{kind}.svg").exists()


def test_report_parts():
    assert report.best_run([{"ap": None}, {"ap": 0.2}, {"ap": 0.2, "x": 1}]) == {"ap": 0.2}
    assert report.pivot([{"m": "a", "s": "x", "v": 1.0}], "m", "s", "v", ["x", "y"]) == [["a", 1.0, None]]
    text = report.replace_block("intro", "status", "one")
    assert report.replace_block(text, "status", "two").count("two") == 1 and "one" not in report.replace_block(text, "status", "two")
    ET.fromstring(report.calibration_svg([{"model": "m<", "bin": 0, "mean_score": 0.1, "positive_rate": 0.2}, {"model": "m<", "bin": 1, "mean_score": 0.3, "positive_rate": 0.2}]))
    ET.fromstring(report.precision_recall_svg([{"model": "m", "recall": 0.1, "precision": 0.9}]))
