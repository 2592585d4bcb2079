"""Schemas of the core tables, always given to readers."""

from __future__ import annotations

LINEAGE = "array<struct<collector_name: string, source_file_id: string, source_line_number: bigint>>"

ARTICLES = (
    "doi string, title string, abstract string, venue string, publisher string, publication_date date, work_type string, "
    "subfield string, is_pubmed_indexed boolean, openalex_life_science_score double, authors array<string>, "
    "institutions array<string>, references_count bigint, author_history_signal_count bigint, "
    "journal_history_signal_count bigint, oa_status string, publication_date_precision string, pmid string, "
    "mesh_terms array<string>, keywords array<string>, pubmed_publication_types array<string>, pubmed_journal_title string, "
    "author_history_cutoff_date date, journal_history_cutoff_date date, source_file_id string, source_line_number bigint, "
    f"source_lineage {LINEAGE}, ingest_snapshot_id string, task_a_date_bucket string"
)
NOTICES = (
    "doi string, notice_type string, notice_date date, source_name string, source_url string, notice_date_precision string, "
    "rights_status string, source_file_id string, source_line_number bigint, ingest_snapshot_id string"
)
SIGNALS = "doi string, tag string, signal_date date, source_name string, source_url string, rights_status string, curator_required boolean, summary string"
PUBMED = (
    "doi string, pmid string, is_pubmed_indexed boolean, mesh_terms array<string>, keywords array<string>, "
    "pubmed_publication_types array<string>, pubmed_journal_title string, subfield_hint string, source_file_id string, "
    "source_line_number bigint, ingest_snapshot_id string"
)

# Fixed values of the domain.
INCLUDED_WORK_TYPES = ("article", "review")
ALLOWED_NOTICE_TYPES = ("retraction", "expression_of_concern", "major_correction")
TASK_A_FIELDS = (
    "title",
    "abstract",
    "venue",
    "publisher",
    "publication_year",
    "subfield",
    "is_pubmed_indexed",
    "openalex_life_science_score",
    "references_count",
    "author_history_signal_count",
    "journal_history_signal_count",
    "oa_status",
    "authors",
    "institutions",
)
BANNED_FIELDS = (
    "notice_status",
    "core_tags",
    "extension_tags",
    "first_signal_date",
    "first_notice_date",
    "source_names",
    "source_urls",
    "allowed_feature_view",
    "public_summary",
    "auto_publish",
    "curator_review_required",
)
HOLDOUT_FIELDS = ("author_cluster", "venue", "publisher")
SNAPSHOT_DATE = "2026-04-09"
