"""Sinks: release bundle, sorted shards, flat CSV, sidecars and driver-side documents."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..operators.records import flat_rows, release_summary, summary_breakdown
from .places import write_text

SHARD_ROWS = 100_000


def write_json(path: str | Path, value) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Gzip JSON lines with columns in alphabetical order; the commit protocol makes the folder appear whole."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def _sharded(df: DataFrame, order: list[str], rows: int) -> DataFrameWriter:
    """A writer of globally sorted files of exactly `rows` rows but the last.

    Rows are numbered over the whole order, and ranges of whole shards are tasks, so files end where shards do.
    """
    numbered = ranked(df, [], [F.asc_nulls_first(c) for c in order], rank="_row")
    shard = F.floor((F.col("_row") - 1) / rows)
    ranges = numbered.withColumn("_shard", shard).repartitionByRange("_shard").sortWithinPartitions("_row").drop("_row", "_shard")
    return ranges.write.mode("overwrite").option("maxRecordsPerFile", rows)


def write_shards(df: DataFrame, path: str, order: list[str], rows: int = SHARD_ROWS) -> None:
    """Globally sorted JSON-line shards of exactly `rows` rows but the last; what was there before goes."""
    _sharded(df, order, rows).option("compression", "gzip").json(path)


def write_tables(df: DataFrame, path: str, order: list[str], rows: int = SHARD_ROWS) -> None:
    """The same as Parquet."""
    _sharded(df, order, rows).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary_payload(records: DataFrame) -> dict:
    """The release summary as a document: one row of counts and two breakdowns reach the driver."""
    out = release_summary(records).first().asDict()
    for r in summary_breakdown(records).collect():
        out.setdefault(f"{r.field}_counts", {})[r.value] = r.n
    return out


def export_release(records: DataFrame, path: str) -> dict:
    """Records as JSON lines and flat CSV, and their summary."""
    write_json_lines(records.orderBy("publication_date", "doi"), f"{path}/records")
    write_csv(flat_rows(records), f"{path}/records_csv")
    payload = summary_payload(records)
    write_json(f"{path}/summary.json", payload)
    return payload


def export_curation_queue(records: DataFrame, path: str) -> None:
    """Records for curators with all their evidence, never part of public output."""
    write_json_lines(records.where("curator_review_required").select("doi", "title", "extension_tags", "first_signal_date", "provenance"), path)


def export_public(records: DataFrame, path: str) -> None:
    """Publishable records with public evidence and safe links."""
    from ..functions.scalars import safe_href
    from ..operators.records import public_rows

    rows = public_rows(records)
    links = F.transform("provenance", lambda e: e.withField("source_url", safe_href(e["source_url"])))
    write_json_lines(rows.select("doi", "internal_id", "title", "venue", "publication_year", "notice_status", "public_summary", links.alias("provenance")), path)


def sha256_manifest(paths: list[Path], base: Path, out: Path) -> None:
    """path, size and hash of local files, tab-separated, by path."""
    lines = []
    for p in sorted(paths):
        digest = hashlib.sha256()
        with open(p, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        lines.append(f"{p.relative_to(base).as_posix()}\t{p.stat().st_size}\t{digest.hexdigest()}")
    write_text(out, "path\tsize_bytes\tsha256\n" + "\n".join(lines) + "\n" * bool(lines))
