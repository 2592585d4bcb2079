"""The stages of a data folder, from raw files to report: each reads what the one before wrote.

Layout below the root, a local path or a URI: raw/<snapshot>/{openalex,official_notices,pubmed}, normalized/, canonical/,
release/, site/, and control/ with the Parquet tables of `ledger.py`.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import canonical, manifest, metrics, models, normalize, records, splits
from ..operators.ranks import ranked
from ..schemas import NOTICES, SIGNALS, SNAPSHOT_DATE
from ..sources import files, places, sinks
from . import collectors, report
from .heartbeat import Heartbeat
from .ledger import Ledger

#: Part of the key under which a file counts as done; a change of the parsers changes it.
PARSER_VERSION = "v2"
# Columns that reviewers fill in.
REVIEW_COLUMNS = ("reviewer_a_decision", "reviewer_b_decision", "consensus_decision", "wording_review", "notes")


class Workflow:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, places.uri(root)
        self.store = Ledger(spark, self.root)

    def _at(self, *parts: str) -> str:
        return places.join(self.root, *parts)

    # raw snapshot

    def scan(self, raw_root: str) -> DataFrame:
        """(relative_path, content_sha256, size_bytes, collector_name) of the raw files of all collectors."""
        out = None
        for c in collectors.COLLECTORS.values():
            at = places.join(raw_root, c.folder)
            if places.names(at):
                df = manifest.scan_files(self.spark, at, c.suffixes).withColumn("collector_name", F.lit(c.name)).withColumn("relative_path", F.concat(F.lit(f"{c.folder}/"), "relative_path"))
                out = df if out is None else out.unionByName(df)
        if out is None:
            raise FileNotFoundError(f"no raw files below {raw_root}")
        return out

    def register(self, snapshot_id: str, raw_root: str, snapshot_date: str = SNAPSHOT_DATE, family: str = "openalex_notices", label: str = "") -> int:
        found = self.scan(raw_root)
        found = found.withColumn("file_id", manifest.file_id(snapshot_id, F.col("collector_name"), F.col("relative_path")))
        return self.store.register({"snapshot_id": snapshot_id, "raw_root": places.uri(raw_root), "source_family": family, "snapshot_date": snapshot_date, "parser_version": PARSER_VERSION, "label": label}, found)

    def _raw_root(self, snapshot_id: str) -> str:
        snap = self.store.snapshot(snapshot_id)
        if snap is None:
            raise KeyError(snapshot_id)
        return snap["raw_root"]

    def assert_frozen(self, snapshot_id: str) -> None:
        found = self.scan(self._raw_root(snapshot_id))
        manifest.assert_frozen(self.store.table("files", snapshot_id), found)

    def _lines(self, snapshot_id: str, todo: DataFrame) -> DataFrame:
        """Raw rows of the files to do as JSON lines; CSV and XML rows are written as objects first. One reader for each format, and for CSV one for each header.

        The names of the files reach the driver, as Spark's readers take them from there.
        """
        raw = self._raw_root(snapshot_id)
        paths = [places.join(raw, r.relative_path) for r in todo.select("relative_path").orderBy("relative_path").collect()]
        kind = lambda p: next((k for k in ("csv", "xml") if p.lower().endswith((f".{k}", f".{k}.gz"))), "json")
        of = lambda k: [p for p in paths if kind(p) == k]
        parts = []
        if of("json"):
            parts.append(files.numbered_lines(self.spark, of("json")))
        heads: dict[str, list[str]] = {}
        for r in files.first_lines(self.spark, of("csv")).orderBy("file").collect() if of("csv") else []:
            heads.setdefault(r.head, []).append(r.file)
        for same in heads.values():
            rows = files.csv_rows(self.spark, same)
            line = F.to_json(F.struct(*rows.columns))
            numbered = files.with_ordinal(rows.withColumn("line", line))
            parts.append(numbered.select("file", (F.col("ordinal") + 1).alias("line_number"), "line"))  # the header is line 1
        if of("xml"):
            rows = files.pubmed_xml(self.spark, of("xml"))
            line = F.when(F.col("error").isNotNull(), F.substring("error", 1, 500)).otherwise(F.to_json(F.struct("doi", "pmid", "mesh_terms", "keywords", "publication_types", "journal_title")))
            parts.append(rows.select("file", F.col("ordinal").alias("line_number"), line.alias("line")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        wanted = todo.select("relative_path", "file_id")
        relative = F.regexp_replace(F.substring_index(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), places.opened(raw)[1] + "/", -1), "^/+", "")
        # every line belongs to a file that was asked for; one that does not is an error, not a row to leave out
        placed = out.withColumn("relative_path", relative).join(wanted, "relative_path", "left")
        file_id = F.when(F.col("file_id").isNull(), F.raise_error(F.concat(F.lit("file is not registered: "), "relative_path"))).otherwise(F.col("file_id"))
        return placed.select(file_id.alias("file_id"), "line_number", "line", F.lit(snapshot_id).alias("snapshot_id"))

    def _unregistered(self, snapshot_id: str, collector: str) -> list[str]:
        """Raw files of a collector that are not registered, 20 of them at most, for a message."""
        c = collectors.get(collector)
        there = [(f"{c.folder}/{n}",) for n in places.names(places.join(self._raw_root(snapshot_id), c.folder)) if n.lower().endswith(c.suffixes)]
        listed = self.spark.createDataFrame(there, "relative_path string")
        return [r.relative_path for r in listed.join(self.store.files(snapshot_id, collector), "relative_path", "left_anti").orderBy("relative_path").limit(20).collect()]

    def pending(self, snapshot_id: str, collector: str, config: str) -> DataFrame:
        """Files that are not done under this configuration, or whose output is gone."""
        rows = self.store.files(snapshot_id, collector)
        out = self._at("normalized", snapshot_id, collector)
        kept = [(n.removeprefix("file_id="),) for n in places.folders(out) if n.startswith("file_id=")]
        there = self.spark.createDataFrame(kept, "file_id string").withColumn("_there", F.lit(True))
        done = rows.join(there, "file_id", "left").where(F.col("_there") | (F.col("parsed_rows") + F.col("quarantined_rows") == 0)).drop("_there")
        return manifest.pending_files(rows.drop("config").withColumn("config", F.lit(config)), done, ["file_id", "content_sha256", "config"])

    def ingest(self, snapshot_id: str, collector: str, early_scope: bool = False, allowed: DataFrame | None = None, trusted: bool = False, progress=None, every: float = 0.0) -> dict:
        """Parse files that are not done under this configuration; returns counts by kind.

        The configuration is the versions of the parsers, the scope and the allowlist's contents. progress(event) is told
        of the start, of tasks done every so many seconds (0: never), of each file's counts and of the end, with the rows
        that the writing pass observed; `control/heartbeat.json` keeps the last sign of life. Counts by file are those of the rows
        written: a pass that lost executors may observe a row twice.
        """
        source = collectors.get(collector)
        if not trusted:
            self.assert_frozen(snapshot_id)
        if stray := self._unregistered(snapshot_id, collector):
            raise manifest.SnapshotChanged("not registered: " + ", ".join(stray))
        config = f"{PARSER_VERSION}{source.version},early={early_scope}"
        if allowed is not None:
            n, total = allowed.select("doi").distinct().agg(F.count("*"), F.sum(F.xxhash64("doi").cast("decimal(38,0)"))).first()
            config += f",allowed={n}:{total}"
        tell = progress or (lambda event: None)
        todo = self.pending(snapshot_id, collector, config).select("file_id", "relative_path")
        n_files = todo.count()
        tell({"event": "start", "collector": collector, "total_files": n_files})
        if not n_files:
            return {"files": 0}
        run = self.store.start_run(snapshot_id, "ingest", collector)
        work = self._at("control", "work", run["run_id"])
        try:
            with Heartbeat(self.spark, tell, every, self._at("control", "heartbeat.json"), collector=collector, snapshot_id=snapshot_id):
                todo.write.parquet(f"{work}/todo")
                todo = self.spark.read.parquet(f"{work}/todo")
                seen = Observation()
                kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("normalized", "quarantine")]
                rows = source.outcomes(self._lines(snapshot_id, todo), early_scope, allowed).observe(seen, F.count(F.lit(1)).alias("rows"), *kinds)
                out = self._at("normalized", snapshot_id, collector)
                # only the folders of the files of this run are replaced
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(out)
                observed = seen.get
                done = self.spark.read.parquet(out).withColumn("file_id", F.col("file_id").cast("string")).join(todo, "file_id", "left_semi")
                normalize.outcome_counts(done).write.parquet(f"{work}/counts")
                counts = self.spark.read.parquet(f"{work}/counts")
                parsed = F.sum(F.when(F.col("kind") == "normalized", F.col("n")))
                errors = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "quarantine", F.struct("code", "n"))))  # an entry for each code
                results = todo.join(counts.groupBy("file_id").agg(parsed.alias("parsed_rows"), errors.alias("errors")), "file_id", "left")
                results = results.withColumns({"parsed_rows": F.coalesce("parsed_rows", F.lit(0)), "errors": F.coalesce("errors", F.create_map().cast("map<string, long>")), "snapshot_id": F.lit(snapshot_id), "config": F.lit(config), "parse_status": F.lit("success")})
                self.store.finish_run(run, "success", results)
            if progress:
                for k, r in enumerate(results.orderBy("relative_path").toLocalIterator(), 1):
                    tell({"event": "file_completed", "collector": collector, "file_index": k, "total_files": n_files, "path": r.relative_path, "normalized_rows": r.parsed_rows, "quarantined_rows": sum(r.errors.values())})
            totals = {"files": n_files} | {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        except Exception:
            self.store.finish_run(run, "failed")
            tell({"event": "failed", "collector": collector})
            raise
        finally:
            places.remove(work)
        tell({"event": "finished", "collector": collector, "observed": observed} | totals)
        return totals

    def row_errors(self, snapshot_id: str, collector: str) -> DataFrame:
        """(file_id, line_number, error_code, error_message, raw_excerpt) of quarantined rows; a file's rows are replaced when it is parsed again."""
        at = self._at("normalized", snapshot_id, collector)
        return self.spark.read.parquet(at).where("kind = 'quarantine'").select("file_id", "line_number", "error_code", "error_message", "raw_excerpt")

    def normalize_sources(self, raw_root: str, out: str) -> dict:
        """Normalised articles, notices and index rows of a raw folder as JSON lines, without a registered snapshot of its own."""
        snapshot_id = "export-" + manifest.stable_file_id("", "", places.uri(raw_root))[:12]
        self.register(snapshot_id, raw_root)
        counts = {}
        for name, collector in (("articles", "openalex_bulk"), ("official_notices", "local_notice_export"), ("pubmed_index", "pubmed_index")):
            if not self.store.files(snapshot_id, collector).isEmpty():
                self.ingest(snapshot_id, collector, trusted=True)
                rows = self.normalized(snapshot_id, collector)
                sinks.write_json_lines(canonical.merge_articles(rows) if name == "articles" else rows, f"{out}/{name}")
                counts[name] = files.count_lines(self.spark, f"{out}/{name}")
        return counts

    def build_allowlist(self, snapshot_id: str, out: str, include_pubmed: bool = True) -> dict:
        """Distinct identifiers of normalised notices and index rows as sorted text below `out`, with the rows that each collector gave."""
        self.assert_frozen(snapshot_id)
        names = ["local_notice_export"] + ["pubmed_index"] * include_pubmed
        found = {}
        for name in names:
            if not self.store.files(snapshot_id, name).isEmpty():
                self.ingest(snapshot_id, name, trusted=True)
                found[name] = self.normalized(snapshot_id, name)
        counts = {name: df.where("doi <> ''").count() for name, df in found.items()}
        dois = normalize.scope_allowlist(*found.values()) if found else self.spark.createDataFrame([], "doi string")
        dois.orderBy("doi").write.mode("overwrite").text(out)
        return {"doi_count": files.count_lines(self.spark, out), "rows_by_collector": counts, "include_pubmed": include_pubmed}

    def normalized(self, snapshot_id: str, collector: str) -> DataFrame | None:
        if not places.folders(self._at("normalized", snapshot_id, collector)):
            return None
        return self.spark.read.parquet(self._at("normalized", snapshot_id, collector)).where("kind = 'normalized'").select("row.*")

    def materialize(self, snapshot_id: str, trusted: bool = False) -> dict:
        if not trusted:
            self.assert_frozen(snapshot_id)
        works = self.normalized(snapshot_id, "openalex_bulk")
        raw_notices = self.normalized(snapshot_id, "local_notice_export")
        index = self.normalized(snapshot_id, "pubmed_index")
        articles = canonical.merge_articles(works)
        if index is not None:
            articles = canonical.enrich_with_pubmed(articles, index)
        if raw_notices is None:
            raw_notices = self.spark.createDataFrame([], NOTICES)
        notices = canonical.dedupe_notices(raw_notices, ["source_file_id", "source_line_number"])
        matched, orphans = canonical.match_notices(articles, notices)
        out = {"articles": canonical.with_history(articles, matched), "official_notices": matched, "orphan_notices": orphans}
        counts = {}
        for name, df in out.items():
            order = ["publication_date", "doi"] if name == "articles" else ["doi", "notice_date", "notice_type", "source_name", "source_url"]
            sinks.write_tables(df, self._at("canonical", snapshot_id, name), order)
            counts[name] = self.canonical(snapshot_id, name).count()
        # what an earlier run made under these kinds goes
        self.store.replace_artifacts(snapshot_id, {k: {f"canonical/{snapshot_id}/{k}": n} for k, n in counts.items()})
        counts["duplicate_doi"] = canonical.duplicate_count(works, "doi").first()[0]
        counts["pubmed_joins"] = self.canonical(snapshot_id, "articles").where("pmid != ''").count()
        row = manifest.collection_summary(self.canonical(snapshot_id, "articles")).first().asDict()
        sinks.write_json(self._at("canonical", snapshot_id, "collection_summary.json"), counts | row | {"errors": self.store.error_counts(snapshot_id)})
        return counts

    def canonical(self, snapshot_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at("canonical", snapshot_id, name))

    def signals(self, snapshot_id: str) -> DataFrame:
        """External signals laid beside the canonical tables; none if there is no such file."""
        return files.source_rows(self.spark, self._at("canonical", snapshot_id), "external_signals", SIGNALS)

    def file_mismatches(self, snapshot_id: str) -> DataFrame:
        """(relative_path, collector_name, recorded_rows, rows, recorded_errors, errors) of files whose normalised or quarantined rows are not as many as were recorded; rows of no registered file have no path."""
        recorded = self.store.files(snapshot_id).select("file_id", "relative_path", "collector_name", F.col("parsed_rows").alias("recorded_rows"), F.col("quarantined_rows").alias("recorded_errors"))
        found = self.spark.createDataFrame([], "file_id string, rows long, errors long")
        for collector in sorted(collectors.COLLECTORS):
            at = self._at("normalized", snapshot_id, collector)
            if places.folders(at):
                rows = self.spark.read.parquet(at)
                found = found.unionByName(rows.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(F.count_if(F.col("kind") == "normalized").alias("rows"), F.count_if(F.col("kind") == "quarantine").alias("errors")))
        both = recorded.join(found, "file_id", "full").na.fill(0, ["recorded_rows", "rows", "recorded_errors", "errors"])
        return both.where((F.col("recorded_rows") != F.col("rows")) | (F.col("recorded_errors") != F.col("errors"))).select("relative_path", "collector_name", "recorded_rows", "rows", "recorded_errors", "errors")

    def validate(self, snapshot_id: str) -> dict:
        """Broken promises of the canonical snapshot, all written below its folder and counted by rule; recorded counts that do not hold, of tables and of files; and raw files that are no longer as registered."""
        day = self.store.snapshot(snapshot_id)["snapshot_date"]
        at = self._at("canonical", snapshot_id, "violations")
        splits.validate_snapshot(self.canonical(snapshot_id, "articles"), self.canonical(snapshot_id, "official_notices"), day).write.mode("overwrite").parquet(at)
        rules = {r.rule: r["count"] for r in self.spark.read.parquet(at).groupBy("rule").count().collect()}
        made = {a.kind: a.row_count for a in self.store.artifacts(snapshot_id).collect()}  # a row for each table
        actual = {kind: self.canonical(snapshot_id, kind).count() for kind in made}
        wrong = [f"row_count:{kind}" for kind, n in made.items() if actual[kind] != n]
        summary = self._at("canonical", snapshot_id, "collection_summary.json")
        if not places.exists(summary):
            wrong.append("summary:missing")
        else:
            recorded = json.loads(places.read_text(summary))
            wrong += [f"summary:{k}" for k in ("articles", "official_notices", "orphan_notices") if recorded.get(k) != actual.get(k)]
        files_at = self._at("canonical", snapshot_id, "file_mismatches")
        self.file_mismatches(snapshot_id).write.mode("overwrite").parquet(files_at)
        unlike = self.spark.read.parquet(files_at)
        wrong += [f"file:{r.relative_path or 'not registered'}" for r in unlike.orderBy("relative_path").limit(20).collect()]  # a sample for the message, all are written
        try:
            self.assert_frozen(snapshot_id)
        except manifest.SnapshotChanged as e:
            wrong.append(f"frozen:{e}")
        return {"passed": not rules and not wrong, "violations": rules, "mismatches": wrong}

    # release

    def build_core(self, articles: DataFrame, notices: DataFrame, signals: DataFrame | None = None, snapshot_date: str = SNAPSHOT_DATE) -> dict:
        signals = signals if signals is not None else self.spark.createDataFrame([], SIGNALS)
        r = records.build_records(articles, notices, signals, snapshot_date)
        r.write.mode("overwrite").parquet(self._at("release", "core"))
        return sinks.export_release(self.records(), self._at("release"))

    def records(self) -> DataFrame:
        return self.spark.read.parquet(self._at("release", "core"))

    def build_splits(self) -> list[dict]:
        r = self.records()
        time = splits.time_splits(r).select("task_name", "split_kind", F.lit(None).cast("string").alias("group_field"), F.lit(None).cast("string").alias("holdout_value"), "doi", "publication_date", "part")
        group = splits.group_splits(r).select(*time.columns)
        time.unionByName(group).write.mode("overwrite").parquet(self._at("release", "splits"))
        sizes = self.spark.read.parquet(self._at("release", "splits")).groupBy("task_name", "split_kind", "group_field", "part").agg(F.count("*").alias("n"))
        return [x.asDict() for x in sizes.orderBy("task_name", "split_kind", "group_field", "part").collect()]

    def audit(self, snapshot_date: str = SNAPSHOT_DATE) -> int:
        splits.leakage_audit(self.records(), snapshot_date).write.mode("overwrite").parquet(self._at("release", "leakage"))
        return self.spark.read.parquet(self._at("release", "leakage")).count()

    def train_task_a(self, months: int = 12, robust: bool = False) -> list[dict]:
        """Metrics of the metadata, text and combined models on the time split, or with robust on every split of the task that has rows to train and test on."""
        task, label = f"task_a_{months}m", f"any_signal_or_notice_within_{months}m"
        parts = self.spark.read.parquet(self._at("release", "splits")).where((F.col("task_name") == task) & ((F.col("split_kind") == "time") | F.lit(robust)))
        parts = parts.select("doi", "part", F.coalesce(F.concat(F.lit(f"{task}_"), "group_field", F.lit("_holdout")), F.lit(task)).alias("split"))
        name = f"{task}_robustness" if robust else task
        split_names = sorted(r.split for r in parts.select("split").distinct().collect())  # one time split and a holdout for each field
        scored = None
        for split in split_names:
            part = self._task_a_features(label, parts.where(F.col("split") == split).drop("split")).withColumn("split", F.lit(split))
            scored = part if scored is None else scored.unionByName(part)
        if scored is None:
            return []
        fitted = models.fit_groups(scored, ["split", "model"], keep=["doi"])
        fitted.write.mode("overwrite").parquet(self._at("release", name))
        scores = self.spark.read.parquet(self._at("release", name)).join(self.records().select("doi", "subfield"), "doi")
        by = ["split", "model"]
        rows = metrics.ranking_metrics(scores, by).join(metrics.bootstrap_ci(scores, by), by).collect()
        sub = metrics.average_precision(scores, [*by, "subfield"]).collect()
        curve = metrics.calibration_curve(scores, by).collect()
        scan = metrics.at_k(scores, by, [0.5, 1.0, 2.0, 5.0, 10.0]).collect()
        own = lambda found, r: [x.asDict() for x in found if (x.split, x.model) == (r.split, r.model)]
        out = []
        for r in sorted(rows, key=lambda r: (r.split, r.model)):
            out.append(
                {"task_name": r.split, "model": r.model}
                | {k: round(r[k], 4) for k in ("ap", "lo", "hi", "ece", "precision_1", "precision_5", "recall_1", "recall_5")}
                | {"ap_by_subfield": {x["subfield"]: round(x["ap"], 4) for x in sorted(own(sub, r), key=lambda x: x["subfield"])}}
                | {"calibration_curve": sorted(({k: x[k] for k in ("bin", "n", "mean_score", "positive_rate")} for x in own(curve, r)), key=lambda x: x["bin"])}
                | {"scan": {f"top_{x['percent']:g}pct": {"k": x["k"], "precision": round(x["precision"], 4), "recall": round(x["recall"], 4)} for x in sorted(own(scan, r), key=lambda x: x["percent"])}}
            )
        sinks.write_json(self._at("release", f"{name}.json"), out)
        points = metrics.at_k(scores, by, [0.5, 1.0, 2.0, *range(5, 101, 5)]).collect()  # a few numbers for each run
        for split in split_names:
            at = self._at("release", "curves")
            sinks.write_text(f"{at}/{split}_precision_recall.svg", report.precision_recall_svg([x.asDict() for x in points if x.split == split]))
            sinks.write_text(f"{at}/{split}_calibration.svg", report.calibration_svg([x.asDict() for x in curve if x.split == split]))
        return out

    @staticmethod
    def _in_order(records: DataFrame) -> DataFrame:
        """records with their number `ord` by publication date and identifier, which settles ties."""
        return ranked(records, [], [F.col("publication_date").asc_nulls_first(), F.asc("doi")], rank="ord")

    def _task_a_features(self, label: str, part: DataFrame) -> DataFrame:
        """(doi, ord, label, part, model, idx, value) of one split: each row's features as sparse places and values, for each of the three models."""
        r = self._in_order(self.records()).join(part, "doi").withColumn("label", F.col(label).cast("int"))
        train = r.where("part = 'train'")
        dictionary = models.category_dictionary(train)
        width = dictionary.count()
        text = F.concat_ws(" ", "title", "abstract")
        vocab = models.vocabulary(train, text)
        places = {v.token: k for k, v in enumerate(vocab.select("token").orderBy("token").collect())}  # the 128 words of the vocabulary
        cell = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
        hot = models.one_hot(r, dictionary).groupBy("doi").agg(F.collect_list(cell(F.col("idx"), F.lit(1.0))).alias("hot"))
        token = self.spark.createDataFrame(list(places.items()), "token string, k int") if places else self.spark.createDataFrame([], "token string, k int")
        words = models.tf_idf(r, "doi", text, vocab).join(F.broadcast(token), "token").groupBy("doi").agg(F.collect_list(cell(F.col("k"), F.col("tf_idf"))).alias("words"))
        none = F.array().cast("array<struct<i: int, v: double>>")
        numbers = F.transform(models.numeric_features(), lambda v, i: cell(F.lit(width) + i, v))
        meta = F.concat(F.coalesce("hot", none), numbers)
        shifted = F.transform(F.coalesce("words", none), lambda c: cell(c["i"] + width + 6, c["v"]))
        kinds = [("metadata", meta), ("text", F.coalesce("words", none)), ("fusion", F.concat(meta, shifted))]
        model = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("features")) for n, c in kinds]))
        return r.join(hot, "doi", "left").join(words, "doi", "left").select("doi", "ord", "label", "part", model.alias("m")).select("doi", "ord", "label", "part", "m.model", "m.features")

    def feature_importance(self, months: int = 12, top: int = 20) -> list[dict]:
        """The features of the metadata model with the largest weights, either sign, ties in the order of the features."""
        task, label = f"task_a_{months}m", f"any_signal_or_notice_within_{months}m"
        part = self.spark.read.parquet(self._at("release", "splits")).where((F.col("task_name") == task) & (F.col("split_kind") == "time")).select("doi", "part")
        rows = self._task_a_features(label, part).where("model = 'metadata'").withColumn("split", F.lit(task))
        train = self._in_order(self.records()).join(part.where("part = 'train'"), "doi")
        named = {r.idx: r.feature for r in models.category_dictionary(train).collect()}
        named |= {len(named) + k: n for k, n in enumerate(models.NUMERIC_NAMES)}
        weights = models.fit_weights(rows, ["split"]).collect()
        weights = sorted(weights, key=lambda r: (-abs(r.weight), r.idx))[:top]
        return [{"feature": named.get(r.idx, str(r.idx)), "weight": round(r.weight, 6)} for r in weights]

    def train_task_b(self) -> dict:
        """Accuracy of the predicted status, macro F1 of predicted tags, and coverage."""
        r = self.records().withColumns({"truth": F.concat("core_tags", "extension_tags"), "predicted": models.predicted_tags(models.evidence_text())}).withColumn("status", models.predicted_status(F.col("predicted")))
        f1 = metrics.macro_f1(r, "truth", "predicted", list(models.TAG_WORDS)).agg(F.avg("f1")).first()[0]
        return {"accuracy": metrics.accuracy(r, "notice_status", "status").first()[0], "macro_f1": f1, "coverage": metrics.provenance_coverage(r, "source_names", "source_urls").first()[0]}

    def adjudication(self, sample: int = 500) -> int:
        """The queue for double review as CSV, with its summary and the reviewers' protocol."""
        rows = splits.adjudication_rows(self.records(), ["notice_status", "subfield"], ["publication_date", "doi"], sample)
        eligible = F.when(F.col("auto_publish"), "official_notice").when(F.col("curator_review_required"), "curator_review").otherwise("none_known_at_snapshot")
        rows = rows.select("doi", "title", "publication_date", "subfield", "notice_status", F.array_join("core_tags", ";").alias("core_tags"), F.array_join("extension_tags", ";").alias("extension_tags"), eligible.alias("public_release_eligibility"), *[F.lit("").alias(c) for c in REVIEW_COLUMNS])
        at = self._at("release", "adjudication")
        sinks.write_csv(rows.coalesce(1), at)  # `sample` rows at most
        written = files.csv_rows(self.spark, at)
        strata = {r.stratum: r.n for r in splits.strata_counts(written, ["notice_status", "subfield"]).collect()}
        summary = {"requested_sample_size": sample, "rows_written": sum(strata.values()), "coverage_complete": sum(strata.values()) >= sample, "strata_counts": strata}
        sinks.write_json(self._at("release", "adjudication_summary.json"), summary)
        sinks.write_text(self._at("release", "adjudication_protocol.md"), report.protocol(summary, REVIEW_COLUMNS))
        return summary["rows_written"]

    def build_site(self, summary: dict) -> int:
        """Pages for the publishable records; the number of pages is the number of rows that reach the driver. What curators alone see goes to the release's folder, not to the site's."""
        sinks.export_curation_queue(self.records(), self._at("release", "curation_queue"))
        public = records.public_rows(self.records()).select("doi", "internal_id", "title", "venue", "publication_year", "notice_status", "public_summary", F.transform("provenance", lambda e: e.withField("source_url", S.safe_href(e["source_url"]))).alias("provenance"))
        return report.build_site([r.asDict(recursive=True) for r in public.toLocalIterator()], self._at("site"), summary)

    def build_report(self, summary: dict, sizes: list[dict], violations: int, runs: list[dict]) -> str:
        text = report.markdown_report(summary, sizes, violations, runs)
        sinks.write_text(self._at("release", "report.md"), text)
        sinks.write_json(self._at("release", "report.json"), {"summary": summary, "splits": sizes, "violations": violations, "runs": runs})
        return text

    def demo(self, articles: DataFrame, notices: DataFrame, signals: DataFrame, snapshot_date: str = SNAPSHOT_DATE) -> str:
        """All release stages in order."""
        summary = self.build_core(articles, notices, signals, snapshot_date)
        sizes = self.build_splits()
        violations = self.audit(snapshot_date)
        runs = self.train_task_a(12) + self.train_task_a(36)
        self.train_task_a(12, robust=True)
        self.train_task_a(36, robust=True)
        summary["task_b_accuracy"] = self.train_task_b()["accuracy"]
        self.adjudication()
        self.build_site(summary)
        return self.build_report(summary, sizes, violations, runs)
