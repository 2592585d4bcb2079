"""Queries over records: build, summaries, winners, history, splits, audit, control plane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import canonical, manifest, normalize, records, splits
from .standins import CTES, SCOPE, SNAPSHOT, articles, notices, read, signals

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, ctes: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (CTES if ctes else "") + sql
        return f

    return add


def built(spark, d) -> DataFrame:
    return records.build_records(articles(spark, d), notices(spark, d), signals(spark, d), SNAPSHOT, **SCOPE)


def text(*cols: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in cols]


@query(
    "core_records",
    """SELECT doi, 'rec-' || doi AS internal_id, CAST(publication_date AS VARCHAR) AS publication_date, CAST(publication_year AS INTEGER) AS publication_year, author_cluster,
  core_tags, extension_tags, CAST(first_notice_date AS VARCHAR) AS first_notice_date, CAST(first_signal_date AS VARCHAR) AS first_signal_date,
  notice_status, bucket AS task_a_date_bucket, notice_status <> 'none_known_at_snapshot' AS auto_publish,
  notice_status = 'none_known_at_snapshot' AND n_ext > 0 AS curator_review_required,
  y12 AS any_signal_or_notice_within_12m, y36 AS any_signal_or_notice_within_36m, e12 AS eligible_for_task_a_12m, e36 AS eligible_for_task_a_36m,
  'task_a_prepublication;task_b_core_metadata' || CASE WHEN oa_status = 'open' THEN ';task_b_open_text' ELSE '' END
    || CASE WHEN n_ext > 0 THEN ';task_b_link_only_signals' ELSE '' END
    || CASE WHEN notice_status <> 'none_known_at_snapshot' THEN ';site_auto_publish' WHEN n_ext > 0 THEN ';site_curator_review' ELSE '' END AS allowed_feature_view
FROM records""",
)
def core_records(spark, d):
    r = built(spark, d)
    join = lambda c: F.array_join(c, ";").alias(c)
    return r.select(
        "doi", "internal_id", *text("publication_date"), "publication_year", "author_cluster", join("core_tags"), join("extension_tags"), *text("first_notice_date", "first_signal_date"),
        "notice_status", "task_a_date_bucket", "auto_publish", "curator_review_required", "any_signal_or_notice_within_12m", "any_signal_or_notice_within_36m",
        "eligible_for_task_a_12m", "eligible_for_task_a_36m", join("allowed_feature_view"),
    )


@query(
    "release_summary",
    """SELECT count(*) AS record_count, CAST(coalesce(sum(n_ext), 0) AS BIGINT) AS total_extension_tags, count(*) FILTER (notice_status <> 'none_known_at_snapshot') AS auto_publish_count,
  count(*) FILTER (notice_status = 'none_known_at_snapshot' AND n_ext > 0) AS curated_review_count, count(*) FILTER (e12) AS task_a_12m_eligible_count,
  count(*) FILTER (e36) AS task_a_36m_eligible_count, count(*) FILTER (bucket = 'noisy_date') AS task_a_noisy_date_count FROM records""",
)
def release_summary(spark, d):
    return records.release_summary(built(spark, d))


@query("summary_breakdown", "SELECT 'subfield' AS field, subfield AS value, count(*) AS n FROM records GROUP BY ALL UNION ALL SELECT 'notice_status', notice_status, count(*) FROM records GROUP BY ALL")
def summary_breakdown(spark, d):
    return records.summary_breakdown(built(spark, d))


@query("public_rows", "SELECT doi, notice_status, title FROM records WHERE notice_status <> 'none_known_at_snapshot'")
def public_rows(spark, d):
    return records.public_rows(built(spark, d)).select("doi", "notice_status", "title")


@query("curation_queue", "SELECT doi, extension_tags FROM records WHERE notice_status = 'none_known_at_snapshot' AND n_ext > 0")
def curation_queue(spark, d):
    return records.curation_queue(built(spark, d)).select("doi", F.array_join("extension_tags", ";").alias("extension_tags"))


_PROVENANCE = """, once AS (SELECT *, row_number() OVER (PARTITION BY doi, source_name, source_url, d, kind, label ORDER BY ord) AS k FROM known),
placed AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY kind, d, ord) AS pos FROM once WHERE k = 1)
SELECT p.doi, CAST(pos AS BIGINT) AS pos, p.source_name, CAST(d AS VARCHAR) AS event_date, CASE kind WHEN 0 THEN 'official_notice' ELSE 'external_signal' END AS event_kind, label AS observed_label
FROM placed p JOIN records r USING (doi)"""


@query("provenance_explode", _PROVENANCE)
def provenance_explode(spark, d):
    e = built(spark, d).select("doi", F.posexplode("provenance").alias("pos", "e"))
    return e.select("doi", (F.col("pos") + 1).cast("long").alias("pos"), "e.source_name", F.col("e.event_date").cast("string").alias("event_date"), "e.event_kind", "e.observed_label")


@query("public_provenance", _PROVENANCE + " WHERE kind = 0 AND notice_status <> 'none_known_at_snapshot'")
def public_provenance(spark, d):
    e = records.public_rows(built(spark, d)).select("doi", F.posexplode("provenance").alias("pos", "e"))
    return e.select("doi", (F.col("pos") + 1).cast("long").alias("pos"), "e.source_name", F.col("e.event_date").cast("string").alias("event_date"), "e.event_kind", "e.observed_label")


@query(
    "flat_row",
    """SELECT doi, title, venue, CAST(publication_date AS VARCHAR) AS publication_date, CASE WHEN is_pubmed_indexed THEN 'True' ELSE 'False' END AS is_pubmed_indexed,
  author1 || ';' || author2 AS authors, coalesce(institution, '') AS institutions, core_tags, coalesce(CAST(first_notice_date AS VARCHAR), '') AS first_notice_date FROM records""",
)
def flat_row(spark, d):
    return records.flat_rows(built(spark, d)).select("doi", "title", "venue", "publication_date", "is_pubmed_indexed", "authors", "institutions", "core_tags", "first_notice_date")


@query("task_a_view", "SELECT doi, title, abstract, venue, publisher, CAST(publication_year AS INTEGER) AS publication_year, subfield, is_pubmed_indexed, score AS openalex_life_science_score, references_count, oa_status FROM records")
def task_a_view(spark, d):
    return records.task_a_view(built(spark, d)).drop("authors", "institutions")


# winners and joins

_DUPES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) AS k FROM lineitem) WHERE k = 1"""


@query("winner_rank", _DUPES, ctes=False)
def winner_rank(spark, d):
    df = read(spark, d, "lineitem")
    best = canonical.winners(df, ["l_orderkey", "l_linenumber"], [F.col("l_quantity"), F.col("l_extendedprice")], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("lineage_union", "SELECT CAST(l_orderkey AS VARCHAR) AS doi, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ';' ORDER BY CAST(l_suppkey AS VARCHAR)) AS lineage FROM lineitem GROUP BY 1", ctes=False)
def lineage_union(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doi"), F.array(F.col("l_suppkey").cast("string")).alias("source_lineage"))
    return canonical.lineage(rows).select("doi", F.array_join("_lineage", ";").alias("lineage"))


@query("dup_count", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem", ctes=False)
def dup_count(spark, d):
    return canonical.duplicate_count(read(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber")), "key")


@query(
    "merge_articles",
    """, raw AS (SELECT *, CASE WHEN custkey % 2 = 0 THEN 'f1' ELSE 'f2' END AS file_id, CAST(doi AS BIGINT) AS line_no, CAST(CAST(doi AS BIGINT) % 500 AS VARCHAR) AS key FROM articles),
best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abstract <> '' DESC, CASE publication_date_precision WHEN 'day' THEN 2 WHEN 'month_imputed' THEN 1 ELSE 0 END DESC,
  (institution IS NOT NULL) DESC, score DESC, file_id || ':' || lpad(CAST(line_no AS VARCHAR), 8, '0')) AS k FROM raw)
SELECT key AS doi, title, publication_date_precision, (SELECT count(*) FROM raw r WHERE r.key = b.key) AS n_lineage FROM best b WHERE k = 1""",
)
def merge_articles(spark, d):
    a = articles(spark, d).withColumns({"source_file_id": F.when(F.col("custkey") % 2 == 0, "f1").otherwise("f2"), "source_line_number": F.col("doi").cast("long")})
    a = a.withColumn("source_lineage", F.array(F.struct(F.lit("c").alias("collector_name"), "source_file_id", "source_line_number")))
    m = canonical.merge_articles(a.withColumn("doi", (F.col("doi").cast("long") % 500).cast("string")))
    return m.select("doi", "title", "publication_date_precision", F.size("source_lineage").cast("long").alias("n_lineage"))


@query(
    "enrich_best_match",
    """, best AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_name) DESC, c_name DESC, c_custkey) AS k FROM customer)
SELECT a.doi, coalesce('p' || b.c_name, '') AS pmid, CASE WHEN b.c_custkey IS NOT NULL AND a.subfield = 'biology' THEN 'biomedicine' ELSE a.subfield END AS subfield
FROM articles a LEFT JOIN best b ON b.k = 1 AND b.c_nationkey = a.custkey % 30""",
)
def enrich_best_match(spark, d):
    none = F.array().cast("array<string>")
    a = articles(spark, d).withColumn("real", F.col("doi")).withColumn("doi", (F.col("custkey") % 30).cast("string"))
    a = a.withColumns({"pmid": F.lit(""), "mesh_terms": none, "keywords": none, "pubmed_publication_types": none, "pubmed_journal_title": F.lit(""), "source_lineage": F.array().cast("array<struct<collector_name:string,source_file_id:string,source_line_number:bigint>>")})
    p = read(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("doi"), F.concat(F.lit("p"), "c_name").alias("pmid"), F.lit(True).alias("is_pubmed_indexed"), F.split("c_name", "").alias("mesh_terms"), none.alias("keywords"),
        none.alias("pubmed_publication_types"), F.lit("J").alias("pubmed_journal_title"), F.lit("biomedicine").alias("subfield_hint"), F.lit("f").alias("source_file_id"), F.col("c_custkey").alias("source_line_number"),
    )
    return canonical.enrich_with_pubmed(a, p).select(F.col("real").alias("doi"), "pmid", "subfield")


_SOME = "(SELECT doi FROM articles WHERE venue <> '5-LOW')"


def _some(spark, d):
    return articles(spark, d).where("venue != '5-LOW'")


@query("notice_semi", f"SELECT doi, notice_type, CAST(notice_date AS VARCHAR) AS notice_date, ord FROM notices WHERE doi IN {_SOME}")
def notice_semi(spark, d):
    return canonical.match_notices(_some(spark, d), notices(spark, d))[0].select("doi", "notice_type", *text("notice_date"), "ord")


@query("notice_anti", f"SELECT doi, notice_type, CAST(notice_date AS VARCHAR) AS notice_date, ord FROM notices WHERE doi NOT IN {_SOME}")
def notice_anti(spark, d):
    return canonical.match_notices(_some(spark, d), notices(spark, d))[1].select("doi", "notice_type", *text("notice_date"), "ord")


@query("notice_dedupe", "SELECT doi, notice_type, CAST(notice_date AS VARCHAR) AS notice_date, source_name, min(ord) AS ord FROM notices GROUP BY doi, notice_type, notice_date, source_name, source_url")
def notice_dedupe(spark, d):
    return canonical.dedupe_notices(notices(spark, d), ["ord"]).select("doi", "notice_type", *text("notice_date"), "source_name", "ord")


_ACTIVE = """, act AS (SELECT a.doi, a.venue, a.publisher, a.author1, a.author2, greatest(a.publication_date, min(n.notice_date)) AS active
  FROM articles a JOIN notices n USING (doi) GROUP BY a.doi, a.venue, a.publisher, a.author1, a.author2, a.publication_date)"""


@query(
    "author_history",
    _ACTIVE
    + """, wrote AS (SELECT doi, author1 AS author, active FROM act UNION SELECT doi, author2, active FROM act),
mine AS (SELECT doi, author1 AS author, publication_date FROM articles UNION SELECT doi, author2, publication_date FROM articles)
SELECT a.doi, (SELECT count(DISTINCT w.doi) FROM mine m JOIN wrote w ON w.author = m.author AND w.active < m.publication_date WHERE m.doi = a.doi) AS author_history_signal_count FROM articles a""",
)
def author_history(spark, d):
    return canonical.author_history(articles(spark, d), notices(spark, d))


@query(
    "venue_history",
    _ACTIVE
    + """, v AS (SELECT venue, active, count(*) AS n FROM act GROUP BY ALL), p AS (SELECT publisher, active, count(*) AS n FROM act GROUP BY ALL), b AS (SELECT venue, publisher, active, count(*) AS n FROM act GROUP BY ALL)
SELECT doi, CAST(coalesce((SELECT sum(n) FROM v WHERE v.venue = a.venue AND v.active < a.publication_date), 0) + coalesce((SELECT sum(n) FROM p WHERE p.publisher = a.publisher AND p.active < a.publication_date), 0)
  - coalesce((SELECT sum(n) FROM b WHERE b.venue = a.venue AND b.publisher = a.publisher AND b.active < a.publication_date), 0) AS BIGINT) AS journal_history_signal_count FROM articles a""",
)
def venue_history(spark, d):
    return canonical.venue_history(articles(spark, d), notices(spark, d))


# splits, audit, adjudication

_YEARS = """, member AS (SELECT 'task_a_12m' AS task_name, * FROM records WHERE e12 UNION ALL SELECT 'task_a_36m', * FROM records WHERE e36 UNION ALL SELECT 'task_b', * FROM records
  UNION ALL SELECT 'task_a_12m_noisy_date', * FROM records WHERE bucket = 'noisy_date' AND publication_year <= 2024 UNION ALL SELECT 'task_a_36m_noisy_date', * FROM records WHERE bucket = 'noisy_date' AND publication_year <= 2022),
years AS (SELECT task_name, publication_year, row_number() OVER (PARTITION BY task_name ORDER BY publication_year) AS i, count(*) OVER (PARTITION BY task_name) AS n FROM (SELECT DISTINCT task_name, publication_year FROM member)),
cuts AS (SELECT *, greatest(1, CAST(floor(n * 0.6) AS BIGINT)) AS a, least(greatest(greatest(1, CAST(floor(n * 0.6) AS BIGINT)) + 1, CAST(floor(n * 0.8) AS BIGINT)), n - 1) AS b FROM years),
parts AS (SELECT task_name, publication_year, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE i WHEN 1 THEN 'train' ELSE 'test' END WHEN i <= a THEN 'train' WHEN i <= b THEN 'val' ELSE 'test' END AS part FROM cuts)
"""


@query("time_split", _YEARS + "SELECT m.task_name, m.doi, p.part FROM member m JOIN parts p ON m.task_name = p.task_name AND m.publication_year = p.publication_year WHERE m.task_name NOT LIKE '%noisy%'")
def time_split(spark, d):
    return splits.time_splits(built(spark, d)).where("task_name not like '%noisy%'").select("task_name", "doi", "part")


@query("noisy_split", _YEARS + "SELECT m.task_name, m.doi, p.part FROM member m JOIN parts p ON m.task_name = p.task_name AND m.publication_year = p.publication_year WHERE m.task_name LIKE '%noisy%'")
def noisy_split(spark, d):
    return splits.time_splits(built(spark, d)).where("task_name like '%noisy%'").select("task_name", "doi", "part")


_GROUPS = """, member AS (SELECT 'task_a_12m' AS task_name, y12 AS y, * FROM records WHERE e12 UNION ALL SELECT 'task_a_36m', y36, * FROM records WHERE e36 UNION ALL SELECT 'task_b', NULL, * FROM records),
long AS (SELECT task_name, y, doi, publication_date, publication_year, 'author_cluster' AS group_field, author_cluster AS value FROM member UNION ALL SELECT task_name, y, doi, publication_date, publication_year, 'venue', venue FROM member
  UNION ALL SELECT task_name, y, doi, publication_date, publication_year, 'publisher', publisher FROM member),
grp AS (SELECT task_name, group_field, value, count(*) AS n, count(DISTINCT y) AS ys, max(publication_date) AS newest, arg_min(doi, (-epoch(publication_date), doi)) AS head FROM long GROUP BY ALL),
fit AS (SELECT *, row_number() OVER (PARTITION BY task_name, group_field ORDER BY newest DESC, head) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY task_name, group_field) AS total FROM grp)
  WHERE n >= 2 AND total - n >= 3 AND (task_name = 'task_b' OR ys = 2)),
picked AS (SELECT task_name, group_field, value AS holdout_value FROM fit WHERE k = 1)
"""


@query("holdout_groups", _GROUPS + "SELECT * FROM picked")
def holdout_groups(spark, d):
    return splits.holdout_groups(built(spark, d))


@query(
    "group_holdout",
    _GROUPS
    + """, rest AS (SELECT l.*, holdout_value FROM long l JOIN picked USING (task_name, group_field) WHERE value <> holdout_value),
years AS (SELECT task_name, group_field, publication_year, row_number() OVER (PARTITION BY task_name, group_field ORDER BY publication_year) AS i, count(*) OVER (PARTITION BY task_name, group_field) AS n
  FROM (SELECT DISTINCT task_name, group_field, publication_year FROM rest)),
cuts AS (SELECT *, greatest(1, CAST(floor(n * 0.6) AS BIGINT)) AS a, least(greatest(greatest(1, CAST(floor(n * 0.6) AS BIGINT)) + 1, CAST(floor(n * 0.8) AS BIGINT)), n - 1) AS b FROM years),
parts AS (SELECT task_name, group_field, publication_year, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE i WHEN 1 THEN 'train' ELSE 'test' END WHEN i <= a THEN 'train' WHEN i <= b THEN 'val' ELSE 'test' END AS part FROM cuts),
good AS (SELECT task_name, group_field FROM parts GROUP BY ALL HAVING count(*) FILTER (part = 'train') > 0 AND count(*) FILTER (part = 'val') > 0)
SELECT task_name, group_field, holdout_value, doi, part FROM (
  SELECT l.task_name, l.group_field, holdout_value, doi, 'test' AS part FROM long l JOIN picked USING (task_name, group_field) WHERE value = holdout_value
  UNION ALL SELECT r.task_name, r.group_field, holdout_value, doi, p.part FROM rest r JOIN parts p ON p.task_name = r.task_name AND p.group_field = r.group_field AND p.publication_year = r.publication_year WHERE p.part <> 'test')
SEMI JOIN good USING (task_name, group_field)""",
)
def group_holdout(spark, d):
    return splits.group_splits(built(spark, d)).select("task_name", "group_field", "holdout_value", "doi", "part")


@query(
    "leakage_audit",
    """SELECT 'notice_before_publication' AS rule, doi FROM records WHERE first_notice_date < publication_date
UNION ALL SELECT 'signal_before_publication', doi FROM records WHERE first_signal_date < publication_date""",
)
def leakage_audit(spark, d):
    return splits.leakage_audit(built(spark, d), SNAPSHOT)


@query(
    "snapshot_validation",
    f"""SELECT 'publication_after_snapshot' AS rule, doi FROM articles WHERE publication_date > DATE '{SNAPSHOT}'
UNION ALL SELECT 'imputed_year_in_primary', doi FROM articles WHERE publication_date_precision = 'year_imputed' AND CAST(doi AS BIGINT) % 20 = 0
UNION ALL SELECT 'notice_before_publication', doi FROM notices JOIN articles USING (doi) WHERE notice_date < publication_date
UNION ALL SELECT 'notice_after_snapshot', doi FROM notices WHERE notice_date > DATE '{SNAPSHOT}'""",
)
def snapshot_validation(spark, d):
    a = articles(spark, d).withColumn("task_a_date_bucket", F.when(F.col("doi").cast("long") % 20 == 0, "primary").otherwise("noisy_date"))
    return splits.validate_snapshot(a, notices(spark, d), SNAPSHOT)


@query("summary_mismatches", "SELECT 'record_count' AS field, count(*) + 1 AS expected, count(*) AS actual FROM records")
def summary_mismatches(spark, d):
    s = records.release_summary(built(spark, d))
    return splits.summary_mismatches(s.withColumn("record_count", F.col("record_count") + 1), s, ["record_count", "auto_publish_count"])


@query(
    "adjudication_round_robin",
    """SELECT doc_id, lang, source, turn_no FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS turn_no FROM documents)
ORDER BY turn_no, lang, source LIMIT 200""",
    ctes=False,
)
def adjudication_round_robin(spark, d):
    return splits.adjudication_rows(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], ["n_chars", "doc_id"], 200).select("doc_id", "lang", "source", "turn_no")


@query("strata_counts", "SELECT lang || '|' || source AS stratum, count(*) AS n FROM documents GROUP BY 1", ctes=False)
def strata_counts(spark, d):
    return splits.strata_counts(read(spark, d, "documents"), ["lang", "source"])


@query("slice_counts", "SELECT 'subfield' AS field, subfield AS value, count(*) AS n FROM records GROUP BY ALL UNION ALL SELECT 'publisher', publisher, count(*) FROM records GROUP BY ALL")
def slice_counts(spark, d):
    return records.slice_counts(built(spark, d))


@query("collector_counts", "SELECT c_mktsegment AS collector_name, count(*) AS files, CAST(sum(c_custkey) AS BIGINT) AS parsed_rows, CAST(sum(c_nationkey) AS BIGINT) AS quarantined_rows FROM customer GROUP BY 1", ctes=False)
def collector_counts(spark, d):
    return manifest.collector_counts(read(spark, d, "customer").select(F.col("c_mktsegment").alias("collector_name"), F.col("c_custkey").alias("parsed_rows"), F.col("c_nationkey").cast("long").alias("quarantined_rows")))


@query("inventory", "SELECT p_brand AS bucket, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1", ctes=False)
def inventory(spark, d):
    return manifest.inventory(read(spark, d, "part").select(F.col("p_brand").alias("bucket"), F.col("p_size").cast("long").alias("size_bytes")))


@query("status_options", "SELECT DISTINCT notice_status FROM records")
def status_options(spark, d):
    return records.status_options(built(spark, d))


# control plane

_FILES = """WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'added' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v"""


@query("file_diff_full_outer", _FILES, ctes=False)
def file_diff(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return manifest.snapshot_diff(p.where("k % 3 != 0"), p.where("k % 5 != 0").withColumn("v", F.when(F.col("k") % 11 == 0, -1).otherwise(F.col("v"))), "k", "v")


@query(
    "upsert_latest",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    ctes=False,
)
def upsert_latest(spark, d):
    e = read(spark, d, "events")
    return manifest.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query(
    "asof_latest",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id) AS k FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15') WHERE k = 1",
    ctes=False,
)
def asof_latest(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return manifest.latest_as_of(e, ["user_id"], "day", F.lit("2024-01-15").cast("date"), [F.col("event_id")]).select("user_id", "event_id")


@query("incremental_skip", "SELECT event_id FROM events WHERE NOT (event_id % 3 = 0 AND event_type <> 'view')", ctes=False)
def incremental_skip(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("content_sha256"), F.lit("c1").alias("config"), "event_type")
    done = e.where("event_id % 3 = 0").withColumn("parse_status", F.when(F.col("event_type") == "view", "failed").otherwise("success"))
    return manifest.pending_files(e, done.select("content_sha256", "config", "parse_status")).select("event_id")


@query("error_counts", "SELECT c_mktsegment AS collector_name, o_orderstatus AS error_code, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL", ctes=False)
def error_counts(spark, d):
    files = read(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("collector_name"))
    return manifest.error_counts(files, read(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderstatus").alias("error_code")))


@query(
    "collection_summary",
    """SELECT count(*) AS articles, round(count(*) FILTER (abstract = '') / greatest(1, count(*)), 4) AS missing_abstract_rate, round(0.0, 4)::DOUBLE AS missing_authors_rate, round(0.0, 4)::DOUBLE AS missing_venue_rate,
  count(*) FILTER (publication_date_precision = 'day') AS day_precision, count(*) FILTER (publication_date_precision = 'month_imputed') AS month_precision, count(*) FILTER (publication_date_precision = 'year_imputed') AS year_precision FROM articles""",
)
def collection_summary(spark, d):
    return manifest.collection_summary(articles(spark, d))


@query("allowlist_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", ctes=False)
def allowlist_semi(spark, d):
    allowed = normalize.scope_allowlist(read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("doi")))
    return normalize.allowed_rows(articles(spark, d), allowed).select(F.col("doi").cast("long").alias("o_orderkey"))
