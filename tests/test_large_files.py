"""Files that are read in many pieces: line numbers, elements across borders, archive members by many tasks."""

import gzip
import io
import json
import random
import tarfile

from pyspark.sql import functions as F

from sieveline.sources import files


def test_numbers_hold_across_splits_without_a_window_over_a_file(spark, tmp_path):
    rng = random.Random(1)
    lines = {f"{n}.txt": ["" if rng.random() < 0.2 else f"{n} {k} " + "x" * rng.randrange(80) for k in range(1, 3000)] for n in "abc"}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {(r.file[-5:], r.line_number): r.line for r in df.collect()}
        plan = df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(n, k): x.strip() for n, own in lines.items() for k, x in enumerate(own, 1) if x}
    assert "row_number" not in plan  # the one window is over the counts of splits


def test_elements_across_borders_are_found_once(spark, tmp_path):
    rng = random.Random(2)
    parts, want = [], []
    for k in range(400):
        parts.append("é" * rng.randrange(60) + f"<x>{k}</x>")
        inner = f"10.1/{k}" if k % 3 else f"<ELocationID EIdType='doi'>10.1/{k}</ELocationID>"
        parts.append(f"<ArticleId IdType=\"doi\">{inner}</ArticleId>")
        want.append(f"10.1/{k}")
    text = "".join(parts)
    (tmp_path / "a.xml").write_text(text)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(text.replace("10.1/", "10.2/"))
    (tmp_path / "empty.xml").write_text("")
    for chunk in (97, 1000, 1 << 20):
        got = [r.doi for r in files.xml_dois(spark, str(tmp_path), chunk, 300).collect()]
        assert sorted(got) == sorted(want + [w.replace("10.1/", "10.2/") for w in want])
    sizes = files.byte_ranges(spark, str(tmp_path), 1000).where(F.col("file").endswith("a.xml")).count()
    assert sizes == -(-len(text.encode()) // 1000)


def archive(path, mode):
    want = []
    with tarfile.open(path, mode) as tar:
        for k in range(40):
            data = "\n".join(["not json"] + [json.dumps({"k": k, "i": i}) for i in range(5)] + [json.dumps([{"k": k, "i": 5}, 7, {"k": k, "i": 6}]), '"text"', "3"]).encode()
            name = f"part-{k}.jsonl" + ".gz" * (k % 2)
            info = tarfile.TarInfo(name if k % 5 else "long/" * 40 + name)
            data = gzip.compress(data) if k % 2 else data
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            want += [(info.name, i, k) for i in range(7)]
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    return sorted(want)


def test_members_are_parsed_by_many_tasks(spark, tmp_path):
    for name, mode in (("plain.tar", "w"), ("packed.tar.gz", "w:gz")):
        want = archive(tmp_path / name, mode)
        df = files.tar_records(spark, str(tmp_path / name), 300).withColumn("task", F.spark_partition_id())
        rows = df.collect()
        assert sorted((r.member, r.ordinal, json.loads(r.json)["k"]) for r in rows) == want
        assert len({r.task for r in rows}) > 10
        assert all(json.loads(r.json)["i"] == r.ordinal for r in rows)
