"""Benchmark records: scope filter, as-of join of events, derived labels, summaries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import INCLUDED_WORK_TYPES, TASK_A_FIELDS


def in_scope(first_year: int = 2000, last_year: int = 2024, least_score: float = 0.70) -> Column:
    return (
        F.lower("work_type").isin(*INCLUDED_WORK_TYPES)
        & F.year("publication_date").between(first_year, last_year)
        & (F.col("is_pubmed_indexed") | (F.col("openalex_life_science_score") >= least_score))
    )


def early_skip_reason(has_doi: Column, first_year: int = 2000, last_year: int = 2024, least_score: float = 0.70, allowed: Column | None = None) -> Column:
    """Why a raw row is skipped before it is built; '' if it is not. An allow-listed row passes the score test only."""
    year = F.year("publication_date")
    return (
        F.when(~has_doi, F.lit("missing_doi"))
        .when(~F.lower("work_type").isin(*INCLUDED_WORK_TYPES), F.lit("unsupported_work_type"))
        .when(year < first_year, F.lit(f"publication_year_before_{first_year}"))
        .when(year > last_year, F.lit(f"publication_year_after_{last_year}"))
        .when((F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(False)), F.lit(""))
        .when(F.col("openalex_life_science_score") < least_score, F.lit("life_science_score_below_0_70"))
        .otherwise(F.lit(""))
    )


def as_events(notices: DataFrame, signals: DataFrame, snapshot: str) -> DataFrame:
    """Both event tables in one form, as far as known at the snapshot. `ord` is the input order within a table."""

    def part(df: DataFrame, kind: int, label: str, date: str) -> DataFrame:
        has = set(df.columns)
        opt = lambda c, d="": F.coalesce(F.col(c), F.lit(d)) if c in has else F.lit(d)
        text = F.replace(F.col(label), F.lit("_"), F.lit(" "))
        summary = (
            F.concat(F.lit("Official "), text, F.lit(" notice recorded in "), F.col("source_name"), F.lit("."))
            if kind == 0
            else F.coalesce(S.nonblank(opt("summary")), F.concat(F.lit("External integrity signal: "), text, F.lit(".")))
        )
        return df.where(F.col(date) <= F.lit(snapshot).cast("date")).select(
            "doi",
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(date).alias("date"),
                (F.col("ord") if "ord" in has else F.lit(0)).cast("long").alias("ord"),
                F.col(label).alias("label"),
                opt("source_name").alias("source_name"),
                opt("source_url").alias("source_url"),
                opt("rights_status", "metadata_only" if kind == 0 else "link_only").alias("rights_status"),
                summary.alias("summary"),
            ).alias("e"),
        )

    return part(notices, 0, "notice_type", "notice_date").unionByName(part(signals, 1, "tag", "signal_date"))


def provenance(events: Column) -> Column:
    """Sorted events without later repeats of (source, address, date, kind, label)."""
    key = lambda e: F.struct(e["source_name"], e["source_url"], e["date"], e["kind"], e["label"])
    keys = F.transform(events, key)
    kept = F.filter(events, lambda e, i: F.array_position(keys, key(e)) == i + 1)
    return F.transform(
        kept,
        lambda e: F.struct(
            e["source_name"].alias("source_name"),
            e["source_url"].alias("source_url"),
            e["date"].alias("event_date"),
            F.when(e["kind"] == 0, F.lit("official_notice")).otherwise(F.lit("external_signal")).alias("event_kind"),
            e["label"].alias("observed_label"),
            e["rights_status"].alias("rights_status"),
            e["summary"].alias("summary"),
            (e["kind"] == 0).alias("publicly_visible"),
        ),
    )


def build_records(articles: DataFrame, notices: DataFrame, signals: DataFrame, snapshot: str, **scope) -> DataFrame:
    """One record per article in scope, with the events known at the snapshot.

    Both event tables go through one aggregation by identifier, so the plan has one shuffle of events and one of
    articles; all derivations are expressions over the grouped events.
    """
    grouped = as_events(notices, signals, snapshot).groupBy("doi").agg(F.array_sort(F.collect_list("e")).alias("events"))
    df = articles.where(in_scope(**scope)).join(grouped, "doi", "left")
    of = lambda kind: F.filter(F.col("events"), lambda e: e["kind"] == kind)
    labels = lambda kind: F.coalesce(F.array_distinct(F.transform(of(kind), lambda e: e["label"])), F.array().cast("array<string>"))
    day = F.lit(snapshot).cast("date")
    has = set(articles.columns)
    opt = lambda c, d: F.coalesce(F.col(c), d) if c in has else d
    df = df.withColumns(
        {
            "core_tags": labels(0),
            "extension_tags": labels(1),
            "first_notice_date": F.get(of(0), 0)["date"],
            "first_signal_date": F.get(of(1), 0)["date"],
            "provenance": F.coalesce(provenance(F.col("events")), F.array()),
            "task_a_date_bucket": opt("task_a_date_bucket", F.when(F.col("publication_date_precision") == "year_imputed", F.lit("noisy_date")).otherwise(F.lit("primary"))),
        }
    )
    status = S.notice_status(F.col("core_tags"))
    df = df.withColumns(
        {
            "internal_id": S.internal_id(F.col("doi")),
            "publication_year": F.year("publication_date"),
            "author_cluster": S.author_cluster(F.col("authors"), F.col("institutions")),
            "notice_status": status,
            "snapshot_date": day,
            "task_a_feature_cutoff_date": F.col("publication_date"),
            "author_history_cutoff_date": opt("author_history_cutoff_date", F.col("publication_date")),
            "journal_history_cutoff_date": opt("journal_history_cutoff_date", F.col("publication_date")),
            "auto_publish": status != "none_known_at_snapshot",
            "source_names": F.transform("provenance", lambda e: e["source_name"]),
            "source_urls": F.transform("provenance", lambda e: e["source_url"]),
        }
    )
    first = F.least("first_notice_date", "first_signal_date")
    primary = F.col("task_a_date_bucket") == "primary"
    df = df.withColumn("curator_review_required", ~F.col("auto_publish") & (F.size("extension_tags") > 0))
    flags = F.array(
        F.lit("task_a_prepublication"),
        F.lit("task_b_core_metadata"),
        F.when(F.col("oa_status") == "open", F.lit("task_b_open_text")),
        F.when(F.size("extension_tags") > 0, F.lit("task_b_link_only_signals")),
        F.when(F.col("auto_publish"), F.lit("site_auto_publish")).when(F.col("curator_review_required"), F.lit("site_curator_review")),
    )
    return df.withColumns(
        {
            "allowed_feature_view": F.array_compact(flags),
            "any_signal_or_notice_within_12m": S.within_months(F.col("publication_date"), first, 12),
            "any_signal_or_notice_within_36m": S.within_months(F.col("publication_date"), first, 36),
            "eligible_for_task_a_12m": primary & (F.col("publication_date") <= F.add_months(day, -12)),
            "eligible_for_task_a_36m": primary & (F.col("publication_date") <= F.add_months(day, -36)),
            "public_summary": F.when(F.col("notice_status") == "retracted", F.concat(F.lit("Retracted via an official notice recorded on "), F.col("first_notice_date").cast("string"), F.lit(".")))
            .when(F.col("notice_status") == "editorial_notice", F.concat(F.lit("Official editorial update on "), F.col("first_notice_date").cast("string"), F.lit(" with tags: "), F.array_join("core_tags", ", "), F.lit(".")))
            .when(F.size("extension_tags") > 0, F.concat(F.lit("Public integrity signals were observed on "), F.col("first_signal_date").cast("string"), F.lit(". Curator review is required before public display.")))
            .otherwise(F.lit("No public integrity signal or official notice is known at the snapshot date.")),
        }
    ).drop("events")


def release_summary(records: DataFrame) -> DataFrame:
    """One row of counts."""
    return records.agg(
        F.count("*").alias("record_count"),
        F.coalesce(F.sum(F.size("extension_tags")), F.lit(0)).cast("long").alias("total_extension_tags"),
        F.count_if("auto_publish").alias("auto_publish_count"),
        F.count_if("curator_review_required").alias("curated_review_count"),
        F.count_if("eligible_for_task_a_12m").alias("task_a_12m_eligible_count"),
        F.count_if("eligible_for_task_a_36m").alias("task_a_36m_eligible_count"),
        F.count_if(F.col("task_a_date_bucket") == "noisy_date").alias("task_a_noisy_date_count"),
    )


def summary_breakdown(records: DataFrame) -> DataFrame:
    """Counts by subfield and by notice status in one pass: (field, value, n)."""
    pairs = F.array(F.struct(F.lit("subfield").alias("field"), F.col("subfield").alias("value")), F.struct(F.lit("notice_status").alias("field"), F.col("notice_status").alias("value")))
    return records.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def slice_counts(records: DataFrame) -> DataFrame:
    """Counts by subfield and by publisher in one pass: (field, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("subfield", "publisher")])
    return records.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def status_options(records: DataFrame) -> DataFrame:
    return records.select("notice_status").distinct()


def public_rows(records: DataFrame) -> DataFrame:
    """Publishable records with their public evidence only."""
    return records.where("auto_publish").withColumn("provenance", F.filter("provenance", lambda e: e["publicly_visible"]))


def curation_queue(records: DataFrame) -> DataFrame:
    return records.where("curator_review_required")


def task_a_view(records: DataFrame) -> DataFrame:
    return records.select("doi", *[c for c in TASK_A_FIELDS if c in records.columns])


def flat_rows(records: DataFrame) -> DataFrame:
    """The flat export: every simple column as text."""
    kinds = [(n, t) for n, t in records.dtypes if "struct" not in t]
    return records.select(*[S.flat(F.col(n), t).alias(n) for n, t in kinds])
