"""Collectors: which files of a raw snapshot a name stands for, and how their lines become outcome rows.

A collector of one's own is registered once and then works in every stage that takes a name:

    register(Collector("grants", "grants", (".jsonl", ".csv.gz"), lambda lines, early_scope, allowed: ...))

Its function gets lines(file_id, line_number, line, snapshot_id), CSV rows and XML records as JSON objects, and gives
rows with the columns OUTCOME, of which `row` is a struct of the collector's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import normalize

OUTCOME = ("file_id", "line_number", "kind", "row", "error_code", "error_message", "raw_excerpt", "reason")


@dataclass(frozen=True)
class Collector:
    name: str
    folder: str
    suffixes: tuple[str, ...]
    parse: Callable[[DataFrame, bool, DataFrame | None], DataFrame]
    #: Part of the key under which a file counts as done.
    version: str = ""

    def outcomes(self, lines: DataFrame, early_scope: bool = False, allowed: DataFrame | None = None) -> DataFrame:
        """Parsed lines with exactly the columns OUTCOME; TypeError where the function leaves one out."""
        out = self.parse(lines, early_scope, allowed)
        if lacking := [c for c in OUTCOME if c not in out.columns]:
            raise TypeError(f"collector {self.name} gives no {', '.join(lacking)}")
        if out.schema["row"].dataType.typeName() != "struct":
            raise TypeError(f"collector {self.name}: row is no struct")
        return out.select(*OUTCOME)


COLLECTORS: dict[str, Collector] = {}


def register(collector: Collector) -> Collector:
    """Make a collector known. One name and one folder belong to one collector: ValueError if they are another's."""
    for c in COLLECTORS.values():
        if c != collector and (c.name == collector.name or c.folder == collector.folder):
            raise ValueError(f"{c.name} already is a collector of folder {c.folder}")
    COLLECTORS[collector.name] = collector
    return collector


def unregister(name: str) -> None:
    COLLECTORS.pop(name, None)


def get(name: str) -> Collector:
    if name not in COLLECTORS:
        raise ValueError(f"no collector {name!r}; there are {', '.join(sorted(COLLECTORS))}")
    return COLLECTORS[name]


register(Collector("openalex_bulk", "openalex", (".jsonl", ".gz"), normalize.normalize_works))
register(Collector("local_notice_export", "official_notices", (".jsonl", ".jsonl.gz", ".csv", ".csv.gz"), lambda lines, early_scope, allowed: normalize.normalize_notices(lines)))
register(Collector("pubmed_index", "pubmed", (".jsonl", ".jsonl.gz", ".csv", ".csv.gz", ".xml", ".xml.gz"), lambda lines, early_scope, allowed: normalize.normalize_index_rows(lines)))
