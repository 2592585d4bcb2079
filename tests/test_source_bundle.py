"""The command line's build-core keeps external signals."""

import gzip
import json

import pytest

from sieveline.__main__ import main
from sieveline.plans.workflow import Workflow
from sieveline.schemas import SIGNALS
from sieveline.sources import files

ARTICLE = {"title": "T", "abstract": "a", "venue": "V", "publisher": "P", "publication_date": "2015-02-03", "work_type": "article", "subfield": "biology", "is_pubmed_indexed": True, "openalex_life_science_score": 0.9, "authors": ["Kim"], "institutions": ["I"], "references_count": 1, "oa_status": "open"}
SIGNAL = {"doi": "10.5/a", "tag": "image_issue", "signal_date": "2015-06-01", "source_name": "S", "source_url": "http://s"}


def tags(spark, root):
    return {r.doi: (r.extension_tags, r.curator_review_required, r.any_signal_or_notice_within_12m) for r in Workflow(spark, root).records().collect()}


@pytest.mark.parametrize("form", ["bundle", "snapshot"])
def test_build_core_keeps_signals(spark, tmp_path, form):
    source = tmp_path / "source" if form == "bundle" else tmp_path / "canonical" / "s1"
    (source / "external_signals").mkdir(parents=True)
    with gzip.open(source / "external_signals" / "part-0.jsonl.gz", "wt") as f:
        f.write(json.dumps(SIGNAL) + "\n")
    (source / "articles.jsonl").write_text("".join(json.dumps(ARTICLE | {"doi": d}) + "\n" for d in ("10.5/a", "10.5/b")))
    if form == "snapshot":
        articles, notices, _ = files.source_bundle(spark, source)
        articles.write.parquet(str(source / "articles"))
        notices.write.parquet(str(source / "official_notices"))
    where = ["--source-dir", str(source)] if form == "bundle" else ["--snapshot-id", "s1"]
    assert main(["--root", str(tmp_path), "build-core", *where]) == 0
    assert tags(spark, tmp_path) == {"10.5/a": (["image_issue"], True, True), "10.5/b": ([], False, False)}


def test_source_rows_order_of_forms(spark, tmp_path):
    read = lambda: [r.tag for r in files.source_rows(spark, tmp_path, "external_signals", SIGNALS).collect()]
    assert read() == []
    with gzip.open(tmp_path / "external_signals.jsonl.gz", "wt") as f:
        f.write(json.dumps(SIGNAL | {"tag": "gz"}) + "\n")
    assert read() == ["gz"]
    (tmp_path / "external_signals.jsonl").write_text(json.dumps(SIGNAL | {"tag": "plain"}) + "\n")
    assert read() == ["plain"]
