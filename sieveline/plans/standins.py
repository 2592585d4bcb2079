"""The engine's entities over the driver tables, for the registered queries: orders are articles, line items events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "1999-06-30"
SCOPE = {"first_year": 1996, "last_year": 2000, "least_score": 0.5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.cast("string").alias("doi"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("text of "), k.cast("string"))).alias("abstract"),
        F.col("o_orderpriority").alias("venue"),
        F.col("o_orderstatus").alias("publisher"),
        F.col("o_orderdate").cast("date").alias("publication_date"),
        F.when(k % 10 == 0, "year_imputed").when(k % 10 == 1, "month_imputed").otherwise("day").alias("publication_date_precision"),
        F.when(k % 7 == 0, "editorial").when(k % 2 == 0, "Article").otherwise("review").alias("work_type"),
        F.when(k % 3 == 0, "biology").when(k % 3 == 1, "biomedicine").otherwise("bioinformatics").alias("subfield"),
        (k % 5 == 0).alias("is_pubmed_indexed"),
        ((k % 100) / 100.0).alias("openalex_life_science_score"),
        F.array(F.concat(F.lit("Author "), (F.col("o_custkey") % 40).cast("string")), F.concat(F.lit("Writer "), (k % 60).cast("string"))).alias("authors"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Inst. "), (F.col("o_custkey") % 9).cast("string")))).alias("institutions"),
        (k % 90).cast("long").alias("references_count"),
        F.when(k % 2 == 0, "open").otherwise("closed").alias("oa_status"),
        F.col("o_custkey").alias("custkey"),
    )


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doi"),
        F.col("l_shipdate").cast("date").alias("day"),
        ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).cast("long").alias("ord"),
        F.concat(F.lit("Source "), (F.col("l_suppkey") % 7).cast("string")).alias("source_name"),
        F.concat(F.lit("http://s/"), (F.col("l_suppkey") % 7).cast("string")).alias("source_url"),
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "retraction").when(F.col("l_returnflag") == "A", "expression_of_concern").otherwise("major_correction")
    return _line(spark, sf_dir).where("l_linenumber <= 3").select("doi", kind.alias("notice_type"), F.col("day").alias("notice_date"), "source_name", "source_url", "ord")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("l_linestatus") == "O", "community_flag").when(F.col("l_returnflag") == "R", "image_issue").otherwise("tortured_phrase")
    return _line(spark, sf_dir).where("l_linenumber > 3").select("doi", tag.alias("tag"), F.col("day").alias("signal_date"), "source_name", "source_url", "ord")


# The same in SQL, stated apart from the Column code above.
CTES = f"""
WITH articles AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doi, 'Order ' || o_orderkey AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'text of ' || o_orderkey END AS abstract,
    o_orderpriority AS venue, o_orderstatus AS publisher, CAST(o_orderdate AS DATE) AS publication_date,
    CASE o_orderkey % 10 WHEN 0 THEN 'year_imputed' WHEN 1 THEN 'month_imputed' ELSE 'day' END AS publication_date_precision,
    CASE WHEN o_orderkey % 7 = 0 THEN 'editorial' WHEN o_orderkey % 2 = 0 THEN 'Article' ELSE 'review' END AS work_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'biology' WHEN 1 THEN 'biomedicine' ELSE 'bioinformatics' END AS subfield,
    o_orderkey % 5 = 0 AS is_pubmed_indexed, CAST((o_orderkey % 100) AS DOUBLE) / 100.0 AS score,
    'Author ' || (o_custkey % 40) AS author1, 'Writer ' || (o_orderkey % 60) AS author2,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Inst. ' || (o_custkey % 9) END AS institution,
    CAST(o_orderkey % 90 AS BIGINT) AS references_count,
    CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'closed' END AS oa_status, o_custkey AS custkey
  FROM orders),
line AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doi, CAST(l_shipdate AS DATE) AS day,
    (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey AS ord,
    'Source ' || (l_suppkey % 7) AS source_name, 'http://s/' || (l_suppkey % 7) AS source_url,
    l_linenumber, l_returnflag, l_linestatus FROM lineitem),
notices AS (
  SELECT doi, CASE l_returnflag WHEN 'R' THEN 'retraction' WHEN 'A' THEN 'expression_of_concern' ELSE 'major_correction' END AS notice_type,
    day AS notice_date, source_name, source_url, ord FROM line WHERE l_linenumber <= 3),
signals AS (
  SELECT doi, CASE WHEN l_linestatus = 'O' THEN 'community_flag' WHEN l_returnflag = 'R' THEN 'image_issue' ELSE 'tortured_phrase' END AS tag,
    day AS signal_date, source_name, source_url, ord FROM line WHERE l_linenumber > 3),
known AS (
  SELECT doi, 0 AS kind, notice_type AS label, notice_date AS d, source_name, source_url, ord FROM notices WHERE notice_date <= DATE '{SNAPSHOT}'
  UNION ALL
  SELECT doi, 1, tag, signal_date, source_name, source_url, ord FROM signals WHERE signal_date <= DATE '{SNAPSHOT}'),
tags AS (
  SELECT doi, kind, label, row_number() OVER (PARTITION BY doi, kind ORDER BY min(d), arg_min(ord, (d, ord))) AS seq
  FROM known GROUP BY doi, kind, label),
taglists AS (
  SELECT doi, string_agg(label, ';' ORDER BY seq) FILTER (kind = 0) AS core_tags, string_agg(label, ';' ORDER BY seq) FILTER (kind = 1) AS extension_tags,
    count(*) FILTER (kind = 1) AS n_ext FROM tags GROUP BY doi),
firsts AS (
  SELECT doi, min(d) FILTER (kind = 0) AS first_notice_date, min(d) FILTER (kind = 1) AS first_signal_date FROM known GROUP BY doi),
records AS (
  SELECT a.*, year(publication_date) AS publication_year,
    coalesce(core_tags, '') AS core_tags, coalesce(extension_tags, '') AS extension_tags, coalesce(n_ext, 0) AS n_ext,
    first_notice_date, first_signal_date,
    CASE WHEN core_tags LIKE '%retraction%' THEN 'retracted' WHEN coalesce(core_tags, '') <> '' THEN 'editorial_notice' ELSE 'none_known_at_snapshot' END AS notice_status,
    CASE WHEN publication_date_precision = 'year_imputed' THEN 'noisy_date' ELSE 'primary' END AS bucket,
    regexp_replace(lower(author1 || '-' || coalesce(institution, 'unknown')), '[^a-z0-9]+', '-', 'g') AS author_cluster,
    coalesce(least(first_notice_date, first_signal_date) BETWEEN publication_date AND CAST(publication_date + INTERVAL 12 MONTH AS DATE), false) AS y12,
    coalesce(least(first_notice_date, first_signal_date) BETWEEN publication_date AND CAST(publication_date + INTERVAL 36 MONTH AS DATE), false) AS y36,
    publication_date_precision <> 'year_imputed' AND publication_date <= CAST(DATE '{SNAPSHOT}' - INTERVAL 12 MONTH AS DATE) AS e12,
    publication_date_precision <> 'year_imputed' AND publication_date <= CAST(DATE '{SNAPSHOT}' - INTERVAL 36 MONTH AS DATE) AS e36
  FROM articles a LEFT JOIN taglists USING (doi) LEFT JOIN firsts USING (doi)
  WHERE lower(work_type) IN ('article', 'review') AND year(publication_date) BETWEEN 1996 AND 2000 AND (is_pubmed_indexed OR score >= 0.5))
"""
