"""Queries over scalar functions, JSON and text extraction, routing and source classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import normalize, records
from ..sources import files
from .standins import CTES, articles, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "doi_normalize",
    """SELECT o_orderkey, lower(trim(regexp_replace(regexp_replace(trim(x), '(?i)^https?://(dx\\.)?doi\\.org/', ''), '(?i)^doi:\\s*', ''))) AS doi FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' https://doi.org/10.1/A' || o_orderkey WHEN 1 THEN 'HTTP://dx.DOI.org/10.1/b' || o_orderkey || ' ' WHEN 2 THEN 'doi: 10.1/C' || o_orderkey ELSE '10.1/d' || o_orderkey END AS x FROM orders)""",
)
def doi_normalize(spark, d):
    k = F.col("o_orderkey")
    ks = k.cast("string")
    x = F.when(k % 4 == 0, F.concat(F.lit(" https://doi.org/10.1/A"), ks)).when(k % 4 == 1, F.concat(F.lit("HTTP://dx.DOI.org/10.1/b"), ks, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("doi: 10.1/C"), ks)).otherwise(F.concat(F.lit("10.1/d"), ks))
    return read(spark, d, "orders").select("o_orderkey", S.normalize_doi(x).alias("doi"))


@query("slugify", "SELECT page_id, CASE s WHEN '' THEN 'record' ELSE s END AS slug FROM (SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)")
def slugify(spark, d):
    return read(spark, d, "pages").select("page_id", S.slugify(F.col("url")).alias("slug"))


@query(
    "tokenize",
    """SELECT doc_id, CAST(len(t) AS BIGINT) AS n, coalesce(array_to_string(t, ' '), '') AS tokens FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 2) AS t FROM documents)""",
)
def tokenize(spark, d):
    t = S.tokenize(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query(
    "coerce_bool",
    """SELECT event_id, CASE WHEN x IN ('1','true','t','yes','y') THEN true WHEN x IN ('0','false','f','no','n') THEN false WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL THEN TRY_CAST(x AS DOUBLE) <> 0 ELSE true END AS b
FROM (SELECT event_id, lower(trim(CASE event_id % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'f' WHEN 2 THEN '0.0' WHEN 3 THEN CAST(value AS VARCHAR) WHEN 4 THEN event_type WHEN 5 THEN NULL ELSE 'TRUE' END)) AS x FROM events)""",
)
def coerce_bool(spark, d):
    e = F.col("event_id") % 7
    x = F.when(e == 0, " Yes ").when(e == 1, "f").when(e == 2, "0.0").when(e == 3, F.col("value").cast("string")).when(e == 4, F.col("event_type")).when(e == 5, F.lit(None).cast("string")).otherwise("TRUE")
    return read(spark, d, "events").select("event_id", S.coerce_bool(x, True).alias("b"))


@query(
    "coerce_date",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(d AS VARCHAR) WHEN 1 THEN strftime(d, '%Y-%m') || '-01' WHEN 2 THEN strftime(d, '%Y') || '-01-01' WHEN 3 THEN CAST(d AS VARCHAR) ELSE NULL END AS date,
  CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month_imputed' WHEN 2 THEN 'year_imputed' WHEN 3 THEN 'day' ELSE NULL END AS precision FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def coerce_date(spark, d):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    loose = F.concat(F.year(day).cast("string"), F.lit("-"), F.month(day).cast("string"), F.lit("-"), F.dayofmonth(day).cast("string"))
    x = F.when(k == 0, day.cast("string")).when(k == 1, F.substring(day.cast("string"), 1, 7)).when(k == 2, F.substring(day.cast("string"), 1, 4)).when(k == 3, loose).otherwise("spring")
    c = S.coerce_date(x)
    return read(spark, d, "orders").select("o_orderkey", c["date"].cast("string").alias("date"), c["precision"].alias("precision"))


@query("coerce_list", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ; '), ';'), lambda x: trim(x)), lambda x: x <> ''), ',') AS items FROM part")
def coerce_list(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(S.coerce_list(F.replace("p_name", F.lit(" "), F.lit(" ; "))), ",").alias("items"))


@query("safe_href", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '#' WHEN url LIKE 'http%://%' THEN url ELSE '#' END AS href FROM pages")
def safe_href(spark, d):
    x = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("javascript:"), "url")).when(F.col("page_id") % 6 == 3, F.lit("//nowhere")).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", S.safe_href(x).alias("href"))


@query("add_months", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS a, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 36 MONTH AS DATE) AS VARCHAR) AS b FROM orders")
def add_months(spark, d):
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", F.add_months(day, 1).cast("string").alias("a"), F.add_months(day, -36).cast("string").alias("b"))


@query(
    "inverted_abstract",
    "SELECT doc_id, coalesce(array_to_string(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), ' '), '') AS abstract FROM documents",
)
def inverted_abstract(spark, d):
    # rows are dealt first: a file may be one row group, which one task reads
    docs = read(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    words = F.split(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "), " ")
    return docs.select("doc_id", S.restore_abstract(S.invert_words(words)).alias("abstract"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_RELATED = "json_object('relation', json_object('is-retraction-of', json_array(json_object('id', '10.1/' || event_id))), 'created', '2024-01-05', 'DOI', '10.9/X' || user_id)"


@query("relation_explode", "SELECT event_id, '10.1/' || event_id AS doi, 'retraction' AS notice_type, '2024-01-05' AS notice_date, 'https://doi.org/10.9/x' || user_id AS source_url FROM events")
def relation_explode(spark, d):
    e = F.col("event_id").cast("string")
    line = F.concat(F.lit('{"relation": {"is-retraction-of": [{"id": "10.1/'), e, F.lit('"}], "is-cited-by": {"id": "x"}}, "created": {"date-parts": [[2024, 1, 5]]}, "DOI": "10.9/X'), F.col("user_id").cast("string"), F.lit('"}'))
    lines = read(spark, d, "events").select(line.alias("line"), F.lit("f").alias("file_id"), F.col("event_id").alias("line_number"), F.lit("s").alias("snapshot_id"))
    n = normalize.normalize_notices(lines).where("kind = 'normalized'")
    return n.select(F.col("line_number").alias("event_id"), "row.doi", "row.notice_type", F.col("row.notice_date").cast("string").alias("notice_date"), "row.source_url")


@query(
    "notice_routing",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'normalized' WHEN 5 THEN 'normalized' ELSE 'quarantine' END AS kind,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'unknown_notice_type' WHEN 2 THEN 'missing_doi' WHEN 3 THEN 'bad_date' WHEN 4 THEN 'bad_json' ELSE '' END AS error_code FROM events""",
)
def notice_routing(spark, d):
    e = F.col("event_id") % 6
    line = (
        F.when(e == 0, '{"doi": "10.1/a", "notice_type": "Erratum", "notice_date": "2020"}')
        .when(e == 1, '{"doi": "10.1/a", "notice_type": "praise", "notice_date": "2020"}')
        .when(e == 2, '{"title": "nothing"}')
        .when(e == 3, '{"doi": "10.1/a", "tag": "retraction", "date": "soon"}')
        .when(e == 4, '{"doi": "10.1/a", ')
        .otherwise('{"DOI": "10.1/a", "update-to": [{"label": "Retraction", "updated": {"x": 1}, "date": "2021-02-03"}]}')
    )
    lines = read(spark, d, "events").select(line.alias("line"), F.lit("f").alias("file_id"), F.col("event_id").alias("line_number"), F.lit("s").alias("snapshot_id"))
    return normalize.normalize_notices(lines).select(F.col("line_number").alias("event_id"), "kind", F.coalesce("error_code", F.lit("")).alias("error_code"))


_WORK_LINE = ("work", "authors", "numbers")


@query(
    "quarantine_routing",
    """SELECT event_type AS file_id, kind, code, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 8 IN (0, 7) THEN 'normalized' ELSE 'quarantine' END AS kind,
  CASE event_id % 8 WHEN 1 THEN 'bad_json' WHEN 2 THEN 'missing_doi' WHEN 3 THEN 'unsupported_work_type' WHEN 4 THEN 'bad_date' WHEN 5 THEN 'bad_authorship_shape' WHEN 6 THEN 'bad_numeric' ELSE '' END AS code FROM events) GROUP BY ALL""",
)
def quarantine_routing(spark, d):
    e = F.col("event_id") % 8
    line = (
        F.when(e == 0, '{"doi": "10.1/a", "type": "journal article", "publication_year": 2020, "referenced_works_count": 3}')
        .when(e == 1, '{"doi": "10.1/a"')
        .when(e == 2, '{"title": "x"}')
        .when(e == 3, '{"doi": "10.1/a", "type": "book"}')
        .when(e == 4, '{"doi": "10.1/a", "publication_date": "soon"}')
        .when(e == 5, '{"doi": "10.1/a", "publication_year": 2020, "authorships": "me"}')
        .when(e == 6, '{"doi": "10.1/a", "publication_year": 2020, "cited_by_count": "many"}')
        .otherwise('{"ids": {"doi": "https://doi.org/10.1/B"}, "publication_date": "2021-3-4", "authorships": [{"author": {"display_name": "A"}}]}')
    )
    lines = read(spark, d, "events").select(line.alias("line"), F.col("event_type").alias("file_id"), F.col("event_id").alias("line_number"), F.lit("s").alias("snapshot_id"))
    return normalize.outcome_counts(normalize.normalize_works(lines))


@query(
    "scope_skip_reasons",
    CTES
    + """SELECT doi, CASE WHEN lower(work_type) NOT IN ('article', 'review') THEN 'unsupported_work_type' WHEN publication_year < 1997 THEN 'publication_year_before_1997' WHEN publication_year > 2000 THEN 'publication_year_after_2000'
  WHEN CAST(doi AS BIGINT) % 9 = 0 THEN '' WHEN score < 0.7 THEN 'life_science_score_below_0_70' ELSE '' END AS reason FROM (SELECT *, year(publication_date) AS publication_year FROM articles)""",
)
def scope_skip_reasons(spark, d):
    return articles(spark, d).select("doi", records.early_skip_reason(F.lit(True), 1997, 2000, 0.7, F.col("doi").cast("long") % 9 == 0).alias("reason"))


@query("regex_extract_all", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def regex_extract_all(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("xml_doi_scan", "SELECT page_id, unnest(['10.1/' || page_id || 'a&b', '10.2/e' || page_id]) AS doi FROM pages")
def xml_doi_scan(spark, d):
    k = F.col("page_id").cast("string")
    ids = F.concat(F.lit('<ArticleId IdType="doi">10.1/<i>'), k, F.lit('</i>&lt;sub&gt;A&lt;/sub&gt;&amp;&#x42;</ArticleId><ArticleId IdType="pubmed">7</ArticleId>'))
    ids = F.concat(ids, F.lit("<ELocationID ValidYN='Y' EIdType='DOI'> https://doi.org/10.2/E"), k, F.lit(' </ELocationID><ArticleId IdType="doi"> </ArticleId>'))
    return read(spark, d, "pages").select("page_id", F.explode(files.dois_in_xml(F.concat("html", ids))).alias("doi"))


@query("strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(files.strip_tags(F.col("html"))).alias("digest"))


@query(
    "source_classification",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'openalex' WHEN 2 THEN 'official_notices' ELSE CASE WHEN page_id % 8 = 7 THEN 'pubmed' ELSE 'unknown' END END AS bucket,
  CASE page_id % 4 WHEN 0 THEN 'xml_root' WHEN 1 THEN 'json_key' WHEN 2 THEN 'path' ELSE CASE WHEN page_id % 8 = 7 THEN 'override' ELSE 'no_rule' END END AS reason FROM pages""",
)
def source_classification(spark, d):
    k = F.col("page_id")
    df = read(spark, d, "pages").select(
        "page_id",
        F.concat(F.when(k % 4 == 2, F.lit("/crossref/")).otherwise(F.lit("/x/")), k.cast("string")).alias("path"),
        F.when(k % 4 == 0, "<PubmedArticleSet><PubmedArticle>").when(k % 4 == 1, '{"authorships": []}').otherwise("").alias("head"),
    )
    over = df.where("page_id % 8 = 7").select("path", F.lit("pubmed").alias("bucket"))
    return files.apply_overrides(files.classify_sources(df), over).select("page_id", "bucket", "reason")


@query(
    "status_labels",
    """SELECT DISTINCT label, list_aggregate(list_transform(string_split(replace(label, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS shown
FROM (SELECT event_type AS label FROM events UNION ALL SELECT event_type || '_' || (event_id % 3) || '_seen' FROM events)""",
)
def status_labels(spark, d):
    e = F.col("event_type")
    labels = read(spark, d, "events").select(F.explode(F.array(e, F.concat(e, F.lit("_"), (F.col("event_id") % 3).cast("string"), F.lit("_seen")))).alias("label"))
    return labels.select("label", S.title_status(F.col("label")).alias("shown")).distinct()


@query("freeze_period", "SELECT o_orderkey, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS freeze_end FROM orders")
def freeze_period(spark, d):
    label = F.concat(F.substring(F.col("o_orderdate").cast("date").cast("string"), 1, 7), F.lit("-freeze"))
    return read(spark, d, "orders").select("o_orderkey", S.freeze_end(label).cast("string").alias("freeze_end"))
