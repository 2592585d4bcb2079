"""Vendor archives: notice rows out of them, staging into a raw snapshot, and checks of what is there."""

from __future__ import annotations

import calendar
import json
import re
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize
from ..sources import files, sinks
from .ledger import now

# Columns of the notice export, and sidecar files of a bucket.
NOTICE_COLUMNS = ("doi", "notice_type", "notice_date", "source_name", "source_url", "rights_status")
SIDECARS = ("source_versions.json", "sha256_manifest.tsv")
OPENALEX_EXTRAS = ("manifest", "LICENSE.txt", "RELEASE_NOTES.txt")


def freeze_end(label: str) -> date:
    """The last day of the month that a 'YYYY-MM-freeze' label names."""
    found = re.fullmatch(r"(\d{4})-(\d{2})(-freeze)?", label)
    if not found or not 1 <= int(found[2]) <= 12:
        raise ValueError(f"no freeze label: {label}")
    year, month = int(found[1]), int(found[2])
    return date(year, month, calendar.monthrange(year, month)[1])


def archive_notices(spark: SparkSession, archive: str, label: str) -> DataFrame:
    """Notice rows of a tar archive of records, as of the freeze's end, without repeats; records without a usable notice give none."""
    raw = files.tar_records(spark, archive)
    lines = raw.select(F.col("json").alias("line"), F.col("member").alias("file_id"), (F.col("ordinal") + 1).alias("line_number"), F.lit(label).alias("snapshot_id"))
    rows = normalize.normalize_notices(lines).where("kind = 'normalized'").select("row.*")
    rows = rows.withColumns({"source_name": F.lit("Crossref Metadata Plus"), "rights_status": F.lit("metadata_only")})
    return rows.where(F.col("notice_date") <= F.lit(str(freeze_end(label))).cast("date")).select(*NOTICE_COLUMNS).distinct()


def retraction_notices(spark: SparkSession, csv: str, label: str) -> DataFrame:
    """Notice rows of a retraction database export as of the freeze's end."""
    rows = normalize.retraction_rows(files.csv_rows(spark, csv), str(freeze_end(label)))
    return rows.withColumn("rights_status", F.lit("metadata_only")).select(*NOTICE_COLUMNS)


def write_notices(rows: DataFrame, out: str) -> int:
    """Rows by identifier, date, type and address as gzip CSV below the folder `out`; returns their number."""
    order = ("doi", "notice_date", "notice_type", "source_url")
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip").csv(out)
    return files.csv_rows(rows.sparkSession, out).count()


def _below(folder: Path) -> list[Path]:
    return sorted(p for p in folder.rglob("*") if p.is_file()) if folder.is_dir() else []


@dataclass(frozen=True)
class Part:
    """One part of a vendor archive: where it lies for a freeze's end, what it needs to hold, and the bucket of a raw snapshot that it goes to.

    rows: the function that turns the needed file, the first of those that it prefers, into notice rows; without one, files are put below `below` as they
    are, and so are those named in `beside`.
    """

    name: str
    folder: Callable[[date], str]
    needed: str
    bucket: str
    below: str = ""
    beside: tuple[str, ...] = ()
    prefer: tuple[str, ...] = ()
    rows: Callable[[SparkSession, str, str], DataFrame] | None = None

    def place(self, root: Path, end: date) -> Path | None:
        """The part's folder. A name that ends with * stands for its latest dated folder up to the end."""
        at = root / self.folder(end)
        if at.name != "*":
            return at if at.is_dir() else None
        dated = files.latest_dated([p.name for p in at.parent.iterdir() if p.is_dir()], end) if at.parent.is_dir() else None
        return at.parent / dated if dated else None

    def files(self, at: Path | None) -> list[Path]:
        return [p for p in _below(at) if re.search(self.needed, p.name)] if at else []


_MONTH = "%Y-%m"
PARTS = (
    Part("openalex", lambda end: f"openalex/{end:{_MONTH}}", r"\.gz$", "openalex", beside=OPENALEX_EXTRAS),
    Part("crossref", lambda end: f"crossref/{end:{_MONTH}}", r"^all\.json\.tar\.gz$", "official_notices", prefer=("all.json.tar.gz",), rows=archive_notices),
    Part("retraction_watch", lambda end: "retraction_watch/*", r"\.csv(\.gz)?$", "official_notices", prefer=("retraction_watch.csv", "retraction_watch.csv.gz", ".csv", ".csv.gz"), rows=retraction_notices),
    Part("pubmed_baseline", lambda end: f"pubmed/baseline/{end.year}", r"\.xml(\.gz)?$", "pubmed", "baseline"),
    Part("pubmed_updatefiles", lambda end: f"pubmed/updatefiles/{end:{_MONTH}}", r"\.xml(\.gz)?$", "pubmed", "updatefiles"),
)
#: The part that an archive of open data alone does without.
LICENSED = "crossref"


def check_archive(root: str | Path, label: str, open_data_only: bool = False) -> dict:
    """{"passed", "problems"}: for each part of a vendor archive that is not complete, what it lacks; open_data_only: the licensed part may lack anything."""
    root, end = Path(root), freeze_end(label)
    problems: dict[str, list[str]] = {}
    for part in PARTS:
        at = part.place(root, end)
        lacks = ["folder"] if at is None else [s for s in SIDECARS if not (at / s).exists()] + ([] if part.files(at) else [f"a file like {part.needed}"])
        if lacks and not (open_data_only and part.name == LICENSED):
            problems[part.name] = lacks
    return {"label": label, "as_of": str(end), "passed": not problems, "problems": problems}


def _put(sources: list[Path], top: Path, out: Path, link: bool) -> int:
    """Copies of files below top, or links to them, at the same places below out."""
    for p in sources:
        to = out / p.relative_to(top)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.unlink(missing_ok=True)
        if link:
            to.symlink_to(p.resolve())
        else:
            shutil.copy2(p, to)
    return len(sources)


def write_sidecars(bucket: Path, label: str, taken: list[dict]) -> None:
    """What a bucket was made from, and the size and hash of each of its files."""
    sinks.write_json(bucket / SIDECARS[0], {"label": label, "at": now(), "taken": taken})
    sinks.sha256_manifest([p for p in _below(bucket) if p.name not in (SIDECARS[1], "fetch.log")], bucket, bucket / SIDECARS[1])


def stage_archive(spark: SparkSession, root: str | Path, raw: str | Path, label: str, mode: str = "copy", open_data_only: bool = False) -> dict[str, int]:
    """A raw snapshot from a vendor archive, part by part; returns what each part gave: notice rows, or files. Parts that need not be there give nothing."""
    if mode not in ("copy", "symlink"):
        raise ValueError("mode is copy or symlink")
    root, raw, end = Path(root), Path(raw), freeze_end(label)
    gave: dict[str, int] = {}
    taken: dict[str, list[dict]] = {p.bucket: [] for p in PARTS}
    places = {p.name: p.place(root, end) for p in PARTS}
    for part in PARTS:  # before anything is written
        optional = part.name == "pubmed_updatefiles" and places[part.name] or open_data_only and part.name == LICENSED  # a month can be without updates
        if not optional and not part.files(places[part.name]):
            raise FileNotFoundError(f"{part.name} needs a file like {part.needed} below {root / part.folder(end)}")
    for part in PARTS:
        at = places[part.name]
        found = part.files(at)
        if not found:
            continue
        if part.rows:
            named = {p.name: p for p in found}
            best = named[files.first_match(list(named), list(part.prefer))]
            out = raw / part.bucket / f"{part.name}_{at.name}"
            gave[part.name] = write_notices(part.rows(spark, f"file://{best.resolve()}", label), f"file://{out.resolve()}")
        else:
            found += [p for p in _below(at) if p.name in part.beside and p not in found]
            gave[part.name] = _put(found, at, raw / part.bucket / part.below, mode == "symlink")
        taken[part.bucket].append({"part": part.name, "from": str(at), "gave": gave[part.name]})
    for bucket, rows in taken.items():
        write_sidecars(raw / bucket, label, rows)
    return gave


#: One example row of each raw bucket, as the normalisers read them.
EXAMPLES = {
    "openalex/works.example.jsonl": {"doi": "10.9999/example.a", "type": "article", "title": "An example", "publication_date": "2021-05-04", "openalex_life_science_score": 0.9, "authorships": [{"author": {"display_name": "A. Writer"}}]},
    "official_notices/notices.example.jsonl": {"doi": "10.9999/example.a", "notice_type": "retraction", "notice_date": "2022-06-01", "source_name": "Journal", "source_url": "https://example.org/n/1"},
    "pubmed/index.example.jsonl": {"doi": "10.9999/example.a", "pmid": "1", "mesh_terms": ["Genomics"], "keywords": ["example"], "publication_types": ["Journal Article"], "journal_title": "Journal"},
}


def scaffold(raw: str | Path) -> list[str]:
    """The folders of a raw snapshot, each with one example row, and a note."""
    raw = Path(raw)
    for name, row in EXAMPLES.items():
        sinks.write_text(raw / name, json.dumps(row, sort_keys=True) + "\n")
    note = "# Raw snapshot\n\nWorks go to `openalex/`, notices to `official_notices/`, index rows to `pubmed/`. Replace the example files.\n"
    sinks.write_text(raw / "README.md", note)
    return ["README.md", *EXAMPLES]


def sample_rows() -> dict[str, list[dict]]:
    """A small invented corpus by rule: articles over twelve years, notices for some of them and signals for others."""
    fields, works = ("biology", "biomedicine", "bioinformatics"), []
    for i in range(36):
        works.append(
            {
                "doi": f"10.9999/sample.{i}",
                "title": f"Study {i} of {fields[i % 3]}",
                "abstract": "" if i % 9 == 0 else f"A cohort and a genome, part {i}.",
                "venue": f"Journal {i % 4}",
                "publisher": f"Press {i % 2}",
                "publication_date": f"{2008 + i % 12}-{1 + i % 12:02d}-15",
                "publication_date_precision": "year_imputed" if i % 12 == 11 else "day",
                "work_type": "review" if i % 5 == 0 else "article",
                "subfield": fields[i % 3],
                "is_pubmed_indexed": i % 2 == 0,
                "openalex_life_science_score": 0.75 + (i % 5) / 20,
                "authors": [f"Author {i % 7}", f"Author {7 + i % 5}"],
                "institutions": [f"Institute {i % 3}"],
                "references_count": 10 + i,
                "author_history_signal_count": 0,
                "journal_history_signal_count": 0,
                "oa_status": "open" if i % 2 else "closed",
            }
        )
    day = lambda w, months: f"{int(w['publication_date'][:4]) + months // 12}-{w['publication_date'][5:7]}-20"
    kinds = ("retraction", "expression_of_concern", "major_correction")
    notices = [{"doi": w["doi"], "notice_type": kinds[i % 3], "notice_date": day(w, 12 * (i % 3)), "source_name": w["venue"], "source_url": f"https://example.org/n/{i}", "rights_status": "metadata_only"} for i, w in enumerate(works) if i % 3 == 0]
    tags = ("image_issue", "community_flag", "metadata_anomaly")
    signals = [{"doi": w["doi"], "tag": tags[i % 3], "signal_date": day(w, 12 * (i % 4)), "source_name": "Reader comments", "source_url": f"https://example.org/s/{i}", "rights_status": "link_only", "curator_required": True, "summary": ""} for i, w in enumerate(works) if i % 4 == 1]
    return {"articles": works, "official_notices": notices, "external_signals": signals}


def bootstrap_sample(out: str | Path) -> dict[str, int]:
    """The sample as a source bundle: JSON lines a table."""
    rows = sample_rows()
    for name, part in rows.items():
        sinks.write_text(f"{out}/{name}.jsonl", "".join(json.dumps(r, sort_keys=True) + "\n" for r in part))
    return {name: len(part) for name, part in rows.items()}
