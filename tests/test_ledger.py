"""Control plane on shared storage: commits, compaction, identity of snapshots; collectors of one's own; signs of life."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import manifest
from sieveline.plans import collectors, ledger
from sieveline.plans.heartbeat import Heartbeat
from sieveline.plans.ledger import Ledger
from sieveline.plans.workflow import Workflow
from sieveline.sources import places

FILES = "file_id string, collector_name string, relative_path string, content_sha256 string, size_bytes long"
SNAPSHOT = {"snapshot_id": "s", "raw_root": "file:///raw", "source_family": "f", "snapshot_date": "2020-01-01", "parser_version": "v1", "label": ""}


def grants(lines, early_scope, allowed):
    """Lines with a title are kept whole, others are quarantined."""
    title = F.get_json_object("line", "$.title")
    bad = title.isNull()
    return lines.select(
        "file_id",
        "line_number",
        F.when(bad, "quarantine").otherwise("normalized").alias("kind"),
        F.when(~bad, F.struct(title.alias("title"), F.get_json_object("line", "$.sum").cast("long").alias("sum"))).alias("row"),
        F.when(bad, "no_title").alias("error_code"),
        F.when(bad, "a grant needs a title").alias("error_message"),
        F.when(bad, F.col("line")).alias("raw_excerpt"),
        F.lit("").alias("reason"),
        F.lit("extra").alias("_metadata_of_mine"),
    )


@pytest.fixture
def own_collector():
    yield collectors.register(collectors.Collector("grants", "grants", (".jsonl", ".csv"), grants, "g1"))
    collectors.unregister("grants")


def test_registration_names_one_identity(spark, tmp_path):
    store = Ledger(spark, f"file://{tmp_path}/a b")
    assert store.snapshot("s") is None and store.files("s").count() == 0 and store.error_counts("s") == [] and store.artifacts("s").count() == 0
    files = spark.createDataFrame([("1", "c", "c/x", "aa", 1), ("2", "c", "c/y", None, None)], FILES)
    assert store.register(SNAPSHOT, files) == 2 and store.register(SNAPSHOT, files) == 2
    for k in ledger.IDENTITY:
        with pytest.raises(ValueError, match=f"another {k}"):
            store.register(SNAPSHOT | {k: "other"}, files)
    for other in (files.where("file_id = '1'"), files.withColumn("content_sha256", F.lit("zz")), files.withColumn("file_id", F.concat("file_id", F.lit("0")))):
        with pytest.raises(ValueError, match="other files"):
            store.register(SNAPSHOT, other)
    assert {(r.parse_status, r.parsed_rows, r.quarantined_rows) for r in store.files("s").collect()} == {("pending", 0, 0)}
    assert store.files("s", "none").count() == 0


def test_commits_are_whole_and_compaction_keeps_the_latest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "COMPACT_AFTER", 4)
    store, other = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    store.replace_artifacts("s", {"a": {"a/1": 1, "a/2": 2}, "b": {"b/1": 5}})
    other.replace_artifacts("s", {"a": {"a/2": 20, "a/3": 3}})
    found = lambda: [(r.kind, r.relative_path, r.row_count) for r in store.artifacts("s").collect()]
    assert found() == [("a", "a/2", 20), ("a", "a/3", 3), ("b", "b/1", 5)]
    # rows without their document are of no commit
    spark.createDataFrame([("s", "b", "b/9", 1, "9", False)], ledger.TABLES["artifacts"][1] + ", commit_id string, gone boolean").write.parquet(f"{store.at}/artifacts/99999999999999999999-half")
    assert len(found()) == 3
    for n in range(7):
        store.put_artifact("s", "b", "b/1", n)
        other.put_artifact("t", "b", "b/1", n)
    store.delete_artifact("s", "a", "a/3")
    assert found() == [("a", "a/2", 20), ("b", "b/1", 6)] and [r.row_count for r in other.artifacts("t", "b").collect()] == [6]
    live, replaced = store._commits()
    assert len(live) <= 4 and len(live) + len(replaced) == len(places.names(f"{store.at}/commits")) < 15
    store.compact()
    assert found() == [("a", "a/2", 20), ("b", "b/1", 6)]


def test_writers_at_once_lose_no_commit(spark, tmp_path):
    stores = [Ledger(spark, str(tmp_path)) for _ in range(4)]
    tasks = [threading.Thread(target=s.put_artifact, args=("s", "k", f"p{i}", i)) for i, s in enumerate(stores)]
    [t.start() for t in tasks]
    [t.join() for t in tasks]
    assert [(r.relative_path, r.row_count) for r in stores[0].artifacts("s").collect()] == [(f"p{i}", i) for i in range(4)]


def test_a_collector_of_ones_own_through_a_uri_root(spark, tmp_path, own_collector):
    raw = tmp_path / "raw"
    (raw / "grants" / "deep").mkdir(parents=True)
    (raw / "grants" / "deep" / "a.jsonl").write_text('{"title": "one", "sum": 3}\n{"sum": 4}\n')
    (raw / "grants" / "b.csv").write_text("sum,title\n7,two\n")
    (raw / "grants" / "empty.jsonl").write_text("")
    w = Workflow(spark, f"file://{tmp_path}/data")
    assert w.register("s", f"file://{raw}") == 3 == w.register("s", str(raw))
    events = []
    assert w.ingest("s", "grants", progress=events.append, every=0.05) == {"files": 3, "normalized": 2, "quarantine": 1}
    kinds = [e["event"] for e in events]
    assert kinds[0] == "start" and kinds[-1] == "finished" and "heartbeat" in kinds and kinds.count("file_completed") == 3
    assert events[-1]["observed"] == {"rows": 3, "normalized": 2, "quarantine": 1}
    assert {(e["path"], e["normalized_rows"], e["quarantined_rows"]) for e in events if e["event"] == "file_completed"} == {("grants/b.csv", 1, 0), ("grants/deep/a.jsonl", 1, 1), ("grants/empty.jsonl", 0, 0)}
    last = json.loads((tmp_path / "data/control/heartbeat.json").read_text())
    assert last["state"] == "finished" and last["collector"] == "grants" and all(e["tasks_done"] <= e["tasks"] for e in events if e["event"] == "heartbeat")
    assert {(r.title, r.sum) for r in w.normalized("s", "grants").collect()} == {("one", 3), ("two", 7)}
    assert w.ingest("s", "grants") == {"files": 0} and w.file_mismatches("s").count() == 0
    assert w.store.error_counts("s") == [{"collector_name": "grants", "error_code": "no_title", "n": 1}]
    assert [r.status for r in w.store.table("runs", "s").collect()] == ["success"] and places.names(f"{w.root}/control/work") == []
    # another version of the parser is another configuration
    collectors.unregister("grants")
    collectors.register(collectors.Collector("grants", "grants", (".jsonl", ".csv"), grants, "g2"))
    assert w.ingest("s", "grants")["files"] == 3


def test_what_a_collector_must_give(spark, own_collector):
    with pytest.raises(ValueError, match="already is a collector"):
        collectors.register(collectors.Collector("mine", "grants", (".jsonl",), grants))
    with pytest.raises(ValueError, match="no collector 'absent'"):
        collectors.get("absent")
    lines = spark.createDataFrame([("f", 1, "{}", "s")], "file_id string, line_number long, line string, snapshot_id string")
    with pytest.raises(TypeError, match="gives no row, reason"):
        collectors.Collector("x", "x", (), lambda lines, early_scope, allowed: grants(lines, early_scope, allowed).drop("row", "reason")).outcomes(lines)
    with pytest.raises(TypeError, match="no struct"):
        collectors.Collector("x", "x", (), lambda lines, early_scope, allowed: grants(lines, early_scope, allowed).withColumn("row", F.lit(1))).outcomes(lines)
    assert collectors.get("grants").outcomes(lines).columns == list(collectors.OUTCOME)


def test_a_failed_run_is_told_and_kept(spark, tmp_path, own_collector):
    (tmp_path / "raw" / "grants").mkdir(parents=True)
    (tmp_path / "raw" / "grants" / "a.jsonl").write_text("{}\n")
    collectors.unregister("grants")
    collectors.register(collectors.Collector("grants", "grants", (".jsonl",), lambda lines, early_scope, allowed: grants(lines, early_scope, allowed).withColumn("reason", F.raise_error(F.lit("broken")))))
    w, events = Workflow(spark, tmp_path / "data"), []
    w.register("s", str(tmp_path / "raw"))
    with pytest.raises(Exception, match="broken"):
        w.ingest("s", "grants", progress=events.append)
    assert events[-1]["event"] == "failed" and [r.status for r in w.store.table("runs", "s").collect()] == ["failed"]
    assert json.loads((tmp_path / "data/control/heartbeat.json").read_text())["state"] == "failed"
    assert [r.parse_status for r in w.store.files("s").collect()] == ["pending"]


def test_heartbeat_outlives_its_document(spark, tmp_path):
    (tmp_path / "taken").write_text("")
    events = []
    with Heartbeat(spark, events.append, 0.02, str(tmp_path / "taken" / "beat.json"), label="x"):
        time.sleep(0.2)
    assert len(events) > 1 and events[0]["label"] == "x"
    with Heartbeat(spark, events.append, 0, str(tmp_path / "beat.json")) as quiet:
        assert quiet.thread is None
    assert (tmp_path / "beat.json").exists()


def test_file_ids_of_columns_and_of_strings_agree(spark):
    rows = [("c", "a/b.jsonl"), ("c", "ü ß.csv"), ("", "")]
    df = spark.createDataFrame(rows, "c string, p string").select("c", "p", manifest.file_id("s1", F.col("c"), F.col("p")).alias("id"))
    assert all(r.id == manifest.stable_file_id("s1", r.c, r.p) for r in df.collect())


def test_places(tmp_path):
    at = places.join(f"file://{tmp_path}", "x", "y+z %20.txt")
    assert places.names(f"{tmp_path}/none") == [] and not places.exists(at)
    places.write_text(at, "ä")
    places.write_text(at, "ö")
    assert places.read_text(at) == "ö" and places.names(str(tmp_path)) == ["x/y+z %20.txt"] and places.folders(str(tmp_path)) == ["x"]
    places.remove(places.join(tmp_path, "x"))
    places.remove(at)
    assert places.names(str(tmp_path)) == []
