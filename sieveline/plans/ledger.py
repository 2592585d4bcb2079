"""Control-plane state of a data folder as Parquet tables on the folder's own storage.

A commit writes rows of one or more tables, each below `control/<table>/<commit>`, and then appears at once by the rename
of its small document in `control/commits`. Of rows with one key the latest commit's holds; a row may say that its key is
gone. Commits of several writers never meet in one file, so none is lost. A driver reads documents of commits; rows of
files stay in DataFrames.

An empty folder gives empty tables. Two writers that change one key at once leave the later one's row. Readers that
began before a commit do not see it. What a compaction replaced goes with the next one, not before.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest
from ..sources import places

#: Keys and columns of each table.
TABLES = {
    "snapshots": (["snapshot_id"], "snapshot_id string, raw_root string, source_family string, snapshot_date string, parser_version string, label string, registered_at string"),
    "files": (["file_id"], "snapshot_id string, file_id string, collector_name string, relative_path string, content_sha256 string, size_bytes long"),
    "results": (["file_id"], "snapshot_id string, file_id string, config string, parse_status string, parsed_rows long, errors map<string, long>"),
    "runs": (["run_id"], "snapshot_id string, run_id string, stage string, collector_name string, status string, started_at string, ended_at string"),
    "artifacts": (["snapshot_id", "kind", "relative_path"], "snapshot_id string, kind string, relative_path string, row_count long"),
}
_STATE = ", commit_id string, gone boolean"

#: Live commits from which on the next one makes one of them.
COMPACT_AFTER = 64

#: What a second registration must agree in.
IDENTITY = ("raw_root", "source_family", "snapshot_date", "parser_version")


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.at = spark, places.join(root, "control")

    # commits

    def _commits(self) -> tuple[dict[str, list[str]], list[str]]:
        """Tables of each live commit, in order, and the commits that others replaced."""
        found = {n.removesuffix(".json"): json.loads(places.read_text(places.join(self.at, "commits", n))) for n in places.names(places.join(self.at, "commits")) if n.endswith(".json") and not n.startswith(".")}
        replaced = {r for c in found.values() for r in c["replaces"]}
        return {k: c["tables"] for k, c in sorted(found.items()) if k not in replaced}, sorted(replaced & set(found))

    def _publish(self, tables: dict[str, DataFrame], after: str, replaces: list[str]) -> str:
        # later than what it was made from, also where clocks differ
        name = f"{max(time.time_ns(), int(after[:20] or 0) + 1):020d}-{uuid.uuid4().hex[:8]}"
        for table, df in tables.items():
            rows = df if "commit_id" in df.columns else df.withColumn("commit_id", F.lit(name))
            rows.write.parquet(places.join(self.at, table, name))
        places.write_text(places.join(self.at, "commits", f"{name}.json"), json.dumps({"tables": sorted(tables), "replaces": replaces}))
        return name

    def commit(self, gone: dict[str, DataFrame] | None = None, **changes: DataFrame) -> None:
        """Put rows of tables and remove keys, all at once. Columns that are not given are null."""
        rows: dict[str, DataFrame] = {}
        for is_gone, given in ((False, changes), (True, gone or {})):
            for table, df in given.items():
                kinds = self.spark.createDataFrame([], TABLES[table][1]).schema
                shaped = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]).withColumn("gone", F.lit(is_gone))
                rows[table] = rows[table].unionByName(shaped) if table in rows else shaped
        live, _ = self._commits()
        self._publish(rows, max(live, default=""), [])
        if len(live) + 1 > COMPACT_AFTER:
            self.compact()

    def compact(self) -> None:
        """One commit of the latest rows in place of all that are live; what the compaction before replaced is removed."""
        live, dead = self._commits()
        tables = {t: self._latest(t, [c for c, has in live.items() if t in has]) for t in TABLES if any(t in has for has in live.values())}
        self._publish(tables, max(live, default=""), list(live))
        for name in dead:
            for table in TABLES:
                places.remove(places.join(self.at, table, name))
            places.remove(places.join(self.at, "commits", f"{name}.json"))

    def _latest(self, table: str, commits: list[str], snapshot_id: str | None = None) -> DataFrame:
        keys, columns = TABLES[table]
        if not commits:
            return self.spark.createDataFrame([], columns + _STATE)
        rows = self.spark.read.schema(columns + _STATE).parquet(*[places.join(self.at, table, c) for c in commits])
        if snapshot_id is not None:
            rows = rows.where(F.col("snapshot_id") == snapshot_id)
        return manifest.latest_version(rows, keys, F.struct("commit_id", ~F.col("gone")))

    def table(self, table: str, snapshot_id: str | None = None) -> DataFrame:
        """Rows of a table as of now, of one snapshot or all."""
        live, _ = self._commits()
        return self._latest(table, [c for c, has in live.items() if table in has], snapshot_id).where(~F.col("gone")).drop("commit_id", "gone")

    def _rows(self, table: str, *rows: dict) -> DataFrame:
        kinds = self.spark.createDataFrame([], TABLES[table][1]).schema
        return self.spark.createDataFrame([tuple(r.get(c) for c in kinds.names) for r in rows], kinds).coalesce(1)

    # snapshots and their files

    def snapshot(self, snapshot_id: str) -> dict | None:
        found = self.table("snapshots", snapshot_id).first()  # one row, by its key
        return found.asDict() if found else None

    def files(self, snapshot_id: str, collector: str | None = None) -> DataFrame:
        """Registered files with what came of them: pending, or their configuration, rows and errors."""
        files = self.table("files", snapshot_id)
        if collector is not None:
            files = files.where(F.col("collector_name") == collector)
        results = self.table("results", snapshot_id).drop("snapshot_id")
        errors = F.aggregate(F.map_values("errors"), F.lit(0).cast("long"), lambda a, b: a + b)
        return files.join(results, "file_id", "left").select(
            *files.columns,
            F.coalesce("config", F.lit("")).alias("config"),
            F.coalesce("parse_status", F.lit("pending")).alias("parse_status"),
            F.coalesce("parsed_rows", F.lit(0)).alias("parsed_rows"),
            F.coalesce(errors, F.lit(0)).alias("quarantined_rows"),
        )

    def register(self, snapshot: dict, files: DataFrame) -> int:
        """Insert once, and give the number of files; a second registration must name the same root, family, date, parser version and files."""
        name = snapshot["snapshot_id"]
        have = self.snapshot(name)
        if have:
            for k in IDENTITY:
                if have[k] != snapshot[k]:
                    raise ValueError(f"snapshot {name} is registered with another {k}")
            if not manifest.snapshot_diff(self.table("files", name), files, "file_id", "content_sha256").isEmpty():
                raise ValueError(f"snapshot {name} is registered with other files")
        else:
            self.commit(snapshots=self._rows("snapshots", snapshot | {"registered_at": now()}), files=files.withColumn("snapshot_id", F.lit(name)))
        return self.table("files", name).count()

    # runs and what they made

    def start_run(self, snapshot_id: str, stage: str, collector: str = "") -> dict:
        run = {"run_id": uuid.uuid4().hex, "snapshot_id": snapshot_id, "stage": stage, "collector_name": collector, "status": "running", "started_at": now()}
        self.commit(runs=self._rows("runs", run))
        return run

    def finish_run(self, run: dict, status: str, results: DataFrame | None = None) -> None:
        """A run's end and, where it has them, the results of its files, in one commit."""
        made = {} if results is None else {"results": results}
        self.commit(runs=self._rows("runs", run | {"status": status, "ended_at": now()}), **made)

    def error_counts(self, snapshot_id: str) -> list[dict]:
        """Quarantined rows by collector and code, a few rows."""
        errors = self.table("results", snapshot_id).select("file_id", F.explode("errors").alias("error_code", "n"))
        found = errors.join(self.table("files", snapshot_id), "file_id").groupBy("collector_name", "error_code").agg(F.sum("n").alias("n"))
        return [r.asDict() for r in found.orderBy("collector_name", "error_code").collect()]

    def put_artifact(self, snapshot_id: str, kind: str, path: str, rows: int) -> None:
        self.commit(artifacts=self._rows("artifacts", {"snapshot_id": snapshot_id, "kind": kind, "relative_path": path, "row_count": rows}))

    def replace_artifacts(self, snapshot_id: str, made: dict[str, dict[str, int]]) -> None:
        """The artifacts of each kind given, by path, in place of those that were; other kinds stay."""
        rows = self._rows("artifacts", *[{"snapshot_id": snapshot_id, "kind": k, "relative_path": p, "row_count": n} for k, paths in made.items() for p, n in paths.items()])
        old = self.table("artifacts", snapshot_id).where(F.col("kind").isin(*made)).join(rows, TABLES["artifacts"][0], "left_anti")
        self.commit(gone={"artifacts": old}, artifacts=rows)

    def delete_artifact(self, snapshot_id: str, kind: str, path: str) -> None:
        self.commit(gone={"artifacts": self._rows("artifacts", {"snapshot_id": snapshot_id, "kind": kind, "relative_path": path})})

    def artifacts(self, snapshot_id: str, kind: str | None = None) -> DataFrame:
        found = self.table("artifacts", snapshot_id)
        return (found if kind is None else found.where(F.col("kind") == kind)).orderBy("kind", "relative_path")
