"""Registered queries over small tables, against brute force: no row is left out."""

from collections import Counter

from sieveline.plans import catalog

from oracle import SF, duck


def test_inverted_abstract_restores_every_document(spark, tmp_path):
    texts = ["", " ", "one", "a b a  b\na", " ".join(f"w{i % 700}" for i in range(6000))]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.abstract for r in catalog.QUERIES["inverted_abstract"](spark, str(tmp_path)).collect()}
    assert got == {i: " ".join(t.split()) for i, t in enumerate(texts)}


def test_relation_explode_parses_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect()
    got = Counter(tuple(r) for r in catalog.QUERIES["relation_explode"](spark, SF).collect())
    want = Counter((e.event_id, f"10.1/{e.event_id}", "retraction", "2024-01-05", f"https://doi.org/10.9/x{e.user_id}") for e in events)
    assert got == want
    assert Counter(duck(SF).sql(catalog.ORACLE_SQL["relation_explode"]).fetchall()) == want
