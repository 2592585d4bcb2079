"""Normalisers, sources, sinks and the stream on small fixtures of our own."""

import gzip
import io
import json
import tarfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scalars as S
from sieveline.operators import canonical, manifest, metrics, models, normalize, records, splits
from sieveline.sources import files, sinks
from sieveline.streaming import ingest


def lines_of(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), "f", i + 1, "s") for i, r in enumerate(rows)], "line string, file_id string, line_number long, snapshot_id string")


def test_works(spark):
    rows = [
        {"doi": "https://doi.org/10.1/AB", "type": "journal article", "publication_date": "2021-3-4", "title": "Genome pipeline", "authorships": [{"author": {"display_name": "A"}, "institutions": [{"display_name": "Z"}, {"name": "B"}], "raw_affiliation_strings": ["B"]}, {"raw_author_name": "C"}], "referenced_works_count": 7, "host_venue": {"display_name": "V"}, "concepts": [{"display_name": "Cell Biology", "score": 0.81}], "open_access": {"is_oa": True}},
        {"ids": {"doi": "doi:10.1/c"}, "publication_year": 2019, "locations": [{"source": {"display_name": "L", "host_organization_name": "P"}}], "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "primary_topic": {"subfield": {"display_name": "Clinical Medicine"}}},
        {"title": "no identifier"},
        {"doi": "10.1/d", "type": "book"},
        {"doi": "10.1/e", "publication_date": "x"},
        {"doi": "10.1/f", "publication_year": 2020, "authorships": {"a": 1}},
        {"doi": "10.1/g", "publication_year": 2020, "authorships": [{}]},
        {"doi": "10.1/h", "publication_year": 2020, "referenced_works_count": "not-a-number"},
        {"doi": "10.1/i", "publication_year": 2020, "openalex_life_science_score": "high"},
        '{"doi": "10.1/j"',
        "[]",
        {"doi": "10.1/k", "publication_year": 2020, "authorships": None, "referenced_works_count": "12.5"},
    ]
    got = {r.line_number: r for r in normalize.normalize_works(lines_of(spark, rows)).collect()}
    assert [got[i + 1].error_code for i in range(12)] == [None, None, "missing_doi", "unsupported_work_type", "bad_date", "bad_authorship_shape", "bad_authorship_shape", "bad_numeric", "bad_numeric", "bad_json", "bad_json", "bad_numeric"]
    a, b = got[1].row, got[2].row
    assert (a.doi, a.work_type, a.publication_date, a.authors, a.institutions, a.references_count, a.venue, a.publisher, a.openalex_life_science_score, a.oa_status, a.subfield) == ("10.1/ab", "article", date(2021, 3, 4), ["A", "C"], ["B", "Z"], 7, "V", "Unknown Publisher", 0.81, "open", "bioinformatics")
    assert (b.doi, b.publication_date_precision, b.task_a_date_bucket, b.abstract, b.venue, b.publisher, b.openalex_life_science_score, b.subfield, b.title) == ("10.1/c", "year_imputed", "noisy_date", "hello world hello", "L", "P", 0.9, "biomedicine", "Untitled work")
    assert got[10].raw_excerpt == '{"doi": "10.1/j"'


def test_early_scope_and_allow_list(spark):
    rows = [
        {"doi": "10.1/a", "publication_year": 2020, "openalex_life_science_score": 0.9},
        {"doi": "10.1/b", "publication_year": 2020, "openalex_life_science_score": 0.1},
        {"doi": "10.1/c", "publication_year": 2020, "openalex_life_science_score": 0.1},
        {"title": "x"},
        {"doi": "10.1/d", "publication_year": 1990, "openalex_life_science_score": 0.9},
    ]
    allowed = normalize.scope_allowlist(spark.createDataFrame([("10.1/b",), ("10.1/b",), ("",)], "doi string"))
    assert allowed.count() == 1
    got = {r.line_number: (r.kind, r.reason) for r in normalize.normalize_works(lines_of(spark, rows), True, allowed).collect()}
    assert got == {1: ("normalized", ""), 2: ("normalized", ""), 3: ("scope_skip", "life_science_score_below_0_70"), 4: ("scope_skip", "missing_doi"), 5: ("scope_skip", "publication_year_before_2000")}


def test_notices(spark):
    rows = [
        {"doi": "10.1/A", "notice_type": "Expression of concern", "notice_date": "2020-05", "source_name": "N", "source_url": "u"},
        {"relation": {"is-retraction-of": [{"id": "10.1/b"}, {"id": "10.1/c"}], "is-update-of": {"DOI": "10.1/d"}, "cites": {"id": "x"}}, "created": {"date-parts": [[2024, 5, 20]]}, "DOI": "10.9/N", "type": "erratum"},
        {"DOI": "10.1/e", "update-to": [{"label": "Retraction", "DOI": "10.9/r", "updated": "2024-05-20"}, {"label": "praise"}, {"type": "corrigendum", "updated": "bad"}], "created": {"date-parts": [[2023]]}},
        {"doi": "10.1/f", "notice_type": "retraction", "date": "soon"},
        {"doi": "10.1/g", "notice_type": "praise", "date": "2020"},
        {"notice_type": "retraction", "date": "2020"},
        {"title": "x"},
        {"doi": "10.1/h", "tag": "retraction", "notice_date": "2020", "relation": {"is-retraction-of": {"id": "10.1/h"}}, "source_name": "S", "url": "w"},
        "{",
    ]
    out = normalize.normalize_notices(lines_of(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.line_number, []).append(r)
    n = lambda i: sorted((r.row.doi, r.row.notice_type, str(r.row.notice_date), r.row.notice_date_precision, r.row.source_name, r.row.source_url) for r in by[i])
    assert n(1) == [("10.1/a", "expression_of_concern", "2020-05-01", "month_imputed", "N", "u")]
    assert n(2) == [(x, t, "2024-05-20", "day", "Crossref/Crossmark Export", "https://doi.org/10.9/n") for x, t in (("10.1/b", "retraction"), ("10.1/c", "retraction"), ("10.1/d", "major_correction"))]
    assert n(3) == [("10.1/e", "major_correction", "2023-01-01", "year_imputed", "Crossref/Crossmark Export", ""), ("10.1/e", "retraction", "2024-05-20", "day", "Crossref/Crossmark Export", "https://doi.org/10.9/r")]
    assert [by[i][0].error_code for i in (4, 5, 6, 7, 9)] == ["bad_date", "unknown_notice_type", "unknown_notice_type", "missing_doi", "bad_json"]
    assert len(by[8]) == 1 and by[8][0].row.doi == "10.1/h"


def test_index_rows_and_xml(spark, tmp_path):
    rows = [{"doi": "10.1/a", "pmid": 5, "mesh_terms": ["Humans", " "], "keywords": "a|b; c", "is_pubmed_indexed": "0.0"}, {"article_ids": {"doi": "10.1/b"}, "mesh_headings": "Genomics;X"}, {"pmid": 1}]
    got = {r.line_number: r for r in normalize.normalize_index_rows(lines_of(spark, rows)).collect()}
    assert (got[1].row.mesh_terms, got[1].row.keywords, got[1].row.is_pubmed_indexed, got[1].row.subfield_hint, got[1].row.pmid) == (["Humans"], ["a", "b; c"], False, "biomedicine", "5")
    assert (got[2].row.doi, got[2].row.subfield_hint, got[2].row.is_pubmed_indexed) == ("10.1/b", "bioinformatics", True) and got[3].error_code == "missing_doi"
    xml = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article><Journal><ISOAbbreviation>J</ISOAbbreviation></Journal><ELocationID EIdType='doi'>10.1/e</ELocationID><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword> k </Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='pubmed'>7</ArticleId><ArticleId IdType='doi'>10.1/X&amp;y</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    (tmp_path / "a.xml").write_text(xml)
    (row,) = files.pubmed_xml(spark, str(tmp_path)).collect()
    assert (row.doi, row.pmid, row.mesh_terms, row.keywords, row.publication_types, row.journal_title, row.error) == ("10.1/X&y", "7", ["Humans"], ["k"], ["Review"], "J", None)
    assert sorted(r.doi for r in files.xml_dois(spark, str(tmp_path)).collect()) == ["10.1/e", "10.1/x&y"]
    nested = """<ArticleId IdType="doi">10.1/<i>a</i>&lt;b&gt;c&lt;/b&gt;</ArticleId><x>10.1/no</x><ArticleId IdType="doi">\n</ArticleId><ELocationID ValidYN="Y" EIdType="doi">doi:10.1/Z</ELocationID>"""
    got = spark.createDataFrame([(nested,), ("",), (None,)], "x string").select(files.dois_in_xml(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [["10.1/ac", "10.1/z"], [], None]


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join("" if i % 5 == 0 else f"line {i}" for i in range(1, 4001)))
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("x\n\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.line == f"line {r.line_number}" for r in got if r.file.endswith("a.txt")) and len(got) == 3202
    assert sorted((r.line_number, r.line) for r in got if r.file.endswith("gz")) == [(1, "x"), (3, "y")]


def test_tar_members(spark, tmp_path):
    path = tmp_path / "all.json.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for name, data in (("a.jsonl", b'{"a": 1}\nbroken\n{"a": 2}'), ("b.json", b'[{"a": 3}, 4]'), ("c.json.gz", gzip.compress(b'{"items": [{"a": 5}], "a": 7}\n[{"a": 8}, {"a": 9}]')), ("d.json", b'{"a": 6}')):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    spark.dataSource.register(files.TarJsonSource)
    got = spark.read.format("tar_json").load(str(path)).collect()
    assert sorted((r.member, r.ordinal, json.loads(r.json)["a"]) for r in got) == [("a.jsonl", 0, 1), ("a.jsonl", 1, 2), ("b.json", 0, 3), ("c.json.gz", 0, 7), ("c.json.gz", 1, 8), ("c.json.gz", 2, 9), ("d.json", 0, 6)]


def test_driver_side_picks():
    assert files.latest_dated(["2024-01-02", "2024-02-30x", "2024-03-01"], date(2024, 2, 1)) == "2024-01-02"
    assert files.latest_dated(["2025-01-01"], date(2024, 2, 1)) is None
    assert files.first_match(["b.csv.gz", "a.csv"], ["x", ".csv"]) == "a.csv"
    assert manifest.stable_file_id("s", "c", "p") == manifest.stable_file_id("s", "c", "p") != manifest.stable_file_id("s", "c", "q")


def test_frozen_snapshot(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.JSONL").write_text("1")
    (tmp_path / "b.csv").write_text("2")
    (tmp_path / "c.bin").write_text("3")
    found = manifest.scan_files(spark, str(tmp_path), (".jsonl", ".csv"))
    kept = spark.createDataFrame(found.collect(), found.schema)
    assert sorted(r.relative_path for r in kept.collect()) == ["b.csv", "x/a.JSONL"]
    manifest.assert_frozen(kept, found)
    (tmp_path / "b.csv").write_text("4")
    (tmp_path / "d.csv").write_text("4")
    (tmp_path / "x" / "a.JSONL").unlink()
    with pytest.raises(manifest.SnapshotChanged, match="added: d.csv; missing: x/a.JSONL; modified: b.csv"):
        manifest.assert_frozen(kept, manifest.scan_files(spark, str(tmp_path), (".jsonl", ".csv")))


def test_retraction_export(spark):
    rows = [("10.1/A", "Retraction", "5/20/2024 0:00", "http://u;http://v"), ("unavailable", "Retraction", "5/20/2024", ""), ("10.1/b", "Correction", "2024-03-01", ""), ("10.1/c", "Praise", "5/20/2024", ""), ("10.1/d", "Retraction", "7/1/2024", "")]
    got = normalize.retraction_rows(spark.createDataFrame(rows, "OriginalPaperDOI string, RetractionNature string, RetractionDate string, URLS string"), "2024-05-31").collect()
    assert sorted((r.doi, r.notice_type, str(r.notice_date), r.source_url) for r in got) == [("10.1/a", "retraction", "2024-05-20", "http://u"), ("10.1/b", "major_correction", "2024-03-01", "https://doi.org/10.1/b")]


def test_bucket_readiness(spark):
    df = spark.createDataFrame([("openalex", "/a/x.gz"), ("openalex", "/a/source_versions.json"), ("pubmed", "/p/a.xml"), ("pubmed", "/p/a.doc")], "bucket string, path string")
    got = {r.bucket: (r.supported, r.sidecar, r.unsupported, r.ready) for r in files.bucket_readiness(df, {"openalex": (".gz",), "pubmed": (".xml",), "official_notices": (".csv",)}).collect()}
    assert got == {"openalex": (1, 1, 0, True), "pubmed": (1, 0, 1, False), "official_notices": (0, 0, 0, False)}


def test_stream_gives_batch_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doi": "10.1/a", "publication_year": 2020}, {"title": "x"}]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    for _ in range(2):
        ingest.ingest(ingest.raw_lines(spark, str(tmp_path / "in"), "s"), normalize.normalize_works, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.kind, r.error_code) for r in got.collect()) == [("normalized", None), ("quarantine", "missing_doi")]


def small_articles(spark):
    return spark.createDataFrame(
        [(f"d{i}", f"T{i}", "A", "V" if i % 2 else "W", "P", date(2010 + i, 1, 1), "day", "article", "biology", True, 0.9, [f"a{i % 3}"], ["I"], i, "open") for i in range(8)],
        "doi string, title string, abstract string, venue string, publisher string, publication_date date, publication_date_precision string, work_type string, subfield string, is_pubmed_indexed boolean, openalex_life_science_score double, authors array<string>, institutions array<string>, references_count long, oa_status string",
    )


def test_records_and_exports(spark, tmp_path):
    notices = spark.createDataFrame([("d1", "retraction", date(2011, 6, 1), "N", "javascript:x"), ("d2", "major_correction", date(2030, 1, 1), "N", "u")], "doi string, notice_type string, notice_date date, source_name string, source_url string")
    signals = spark.createDataFrame([("d1", "image_issue", date(2012, 1, 1), "S", "u"), ("d3", "community_flag", date(2014, 1, 1), "S", "u"), ("d3", "community_flag", date(2014, 1, 1), "S", "u")], "doi string, tag string, signal_date date, source_name string, source_url string")
    r = records.build_records(small_articles(spark), notices, signals, "2026-04-09")
    got = {x.doi: x for x in r.collect()}
    assert len(got) == 8 and got["d1"].notice_status == "retracted" and got["d1"].any_signal_or_notice_within_12m and got["d2"].notice_status == "none_known_at_snapshot"
    assert got["d3"].curator_review_required and len(got["d3"].provenance) == 1 and not got["d1"].curator_review_required
    assert got["d3"].public_summary.startswith("Public integrity signals were observed on 2014-01-01")
    assert splits.leakage_audit(r, "2026-04-09").count() == 0 and splits.banned_features() == []
    payload = sinks.export_release(r, f"file://{tmp_path}/rel")
    assert payload["record_count"] == 8 and payload["notice_status_counts"]["retracted"] == 1
    sinks.export_public(r, f"file://{tmp_path}/pub")
    (public,) = [json.loads(x) for p in (tmp_path / "pub").glob("*.gz") for x in gzip.open(p, "rt")]
    assert public["doi"] == "d1" and [e["source_url"] for e in public["provenance"]] == ["#"] and "image_issue" not in json.dumps(public)
    sinks.write_shards(r.select("doi", "publication_date"), f"file://{tmp_path}/sh", ["doi"], 3)
    parts = sorted((tmp_path / "sh").glob("*.gz"))
    rows = [json.loads(x)["doi"] for p in parts for x in gzip.open(p, "rt")]
    assert rows == sorted(rows) and len(rows) == 8 and all(sum(1 for _ in gzip.open(p, "rt")) <= 3 for p in parts)


def test_audit_names_each_leak(spark):
    a = small_articles(spark)
    none = spark.createDataFrame([], "doi string, notice_type string, notice_date date, source_name string, source_url string")
    r = records.build_records(a, none, none.select("doi", F.col("notice_type").alias("tag"), F.col("notice_date").alias("signal_date"), "source_name", "source_url"), "2026-04-09")
    pub = F.col("publication_date")
    for column, value, rule in (
        ("first_notice_date", F.date_sub(pub, 1), "notice_before_publication"),
        ("first_signal_date", F.date_sub(pub, 1), "signal_before_publication"),
        ("first_signal_date", F.lit("2027-01-01").cast("date"), "event_after_snapshot"),
        ("snapshot_date", F.lit("2020-01-01").cast("date"), "snapshot_mismatch"),
        ("task_a_feature_cutoff_date", F.date_add(pub, 1), "feature_cutoff_not_publication"),
        ("author_history_cutoff_date", F.lit(None).cast("date"), "missing_cutoff"),
        ("journal_history_cutoff_date", F.date_add(pub, 1), "journal_history_after_publication"),
    ):
        bad = r.withColumn(column, F.when(F.col("doi") == "d4", value).otherwise(F.col(column)))
        assert [tuple(x) for x in splits.leakage_audit(bad, "2026-04-09").collect()] == [(rule, "d4")]


def test_sparse_years(spark):
    df = lambda *ys: spark.createDataFrame([(y,) for y in ys], "publication_year int")
    parts = lambda *ys: {r.publication_year: r.part for r in splits.year_parts(df(*ys), []).collect()}
    assert parts(2001) == {2001: "train"} and parts(2001, 2003) == {2001: "train", 2003: "test"}
    assert parts(1, 2, 3) == {1: "train", 2: "val", 3: "test"}
    assert list(parts(*range(10)).values()).count("train") == 6


def test_history_against_brute_force(spark):
    import random

    rng = random.Random(8)
    arts = [(f"d{i}", f"V{rng.randrange(3)}", f"P{rng.randrange(3)}", date(2000 + rng.randrange(12), 1 + rng.randrange(12), 1), [f"a{rng.randrange(6)}", f"a{rng.randrange(6)}"]) for i in range(60)]
    nots = [(f"d{rng.randrange(60)}", date(2000 + rng.randrange(12), 1, 1)) for _ in range(25)]
    a = spark.createDataFrame(arts, "doi string, venue string, publisher string, publication_date date, authors array<string>")
    n = spark.createDataFrame(nots, "doi string, notice_date date")
    first = {}
    for d, day in nots:
        first[d] = min(day, first.get(d, day))
    act = {x[0]: max(x[3], first[x[0]]) for x in arts if x[0] in first}
    by = {x[0]: x for x in arts}
    journal = {x[0]: sum(act[o] < x[3] and (by[o][1] == x[1] or by[o][2] == x[2]) for o in act) for x in arts}
    author = {x[0]: sum(act[o] < x[3] and bool(set(by[o][4]) & set(x[4])) for o in act) for x in arts}
    assert {r.doi: r.journal_history_signal_count for r in canonical.venue_history(a, n).collect()} == journal
    assert {r.doi: r.author_history_signal_count for r in canonical.author_history(a, n).collect()} == author


def test_metrics_and_models(spark):
    df = spark.createDataFrame([("m", i, y, s) for i, (y, s) in enumerate(zip([1, 0, 1, 0, 1, 0], [0.91, 0.8, 0.6, 0.4, 0.2, 0.08]))], "model string, ord long, label int, score double")
    assert round(metrics.average_precision(df, ["model"]).first().ap, 4) == 0.7556
    a, b = (metrics.bootstrap_ci(df, ["model"], 200).first() for _ in range(2))
    assert a == b and 0 <= a.lo < a.hi <= 1
    with pytest.raises(ValueError):
        metrics.calibration_curve(df, ["model"], 0)
    with pytest.raises(ValueError):
        metrics.average_precision_list([1], [])
    with pytest.raises(ValueError):
        models.LogisticRegression().predict([[1.0, 2.0]])
    rows = [([float(i % 5), float(i % 3)], int(i % 5 > 2), i, "train" if i % 4 else "test", "m") for i in range(60)]
    long = spark.createDataFrame(rows, "features array<double>, label int, ord long, part string, model string")
    out = models.fit_groups(long, ["model"], epochs=3000).collect()
    assert len(out) == 15 and all((r.score > 0.5) == bool(r.label) for r in out)
    w, bias = models.fit_logistic(long.where("part = 'train'").cache(), epochs=3)
    ours = models.LogisticRegression(epochs=3).fit([r[0] for r in rows if r[3] == "train"], [r[1] for r in rows if r[3] == "train"])
    assert all(abs(x - y) < 1e-9 for x, y in zip([*w, bias], [*ours.weights, ours.bias]))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(S.normalize_doi(F.lit(x))) for x in (" HTTPS://doi.org/10.1/AB ", "\n\tdoi: 10.1/AB\r\n")] == ["10.1/ab"] * 2 and one(S.slugify(F.lit(" --"))) == "record"
    assert [one(S.coerce_bool(F.lit(x), True)) for x in ("0.0", "1.0", "false", "maybe", "NaN")] == [False, True, False, True, True]
    assert one(S.coerce_date(F.lit("2021-1-5"))["date"]) == date(2021, 1, 5) and one(S.coerce_date(F.lit("2021-02-30"))) is None
    assert one(S.author_cluster(F.array(F.lit("Ann B")), F.array().cast("array<string>"))) == "ann-b-unknown"
    assert [one(S.safe_href(F.lit(x))) for x in ("https://a/b", "javascript:a", "http:///x", "ftp://a")] == ["https://a/b", "#", "#", "#"]
    assert one(S.freeze_end(F.lit("2024-02-freeze"))) == date(2024, 2, 29)
