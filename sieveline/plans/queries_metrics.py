"""Queries over features, models and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics, models
from .standins import CTES, read
from .queries_records import built

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def scored(spark, d) -> DataFrame:
    """(lang, ord, label, score) of labelled documents; the score is a made-up one with ties."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    y = read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(y, "doc_id").select("lang", F.col("doc_id").alias("ord"), "label", ((F.col("n_chars") % 101) / 100.0).alias("score"))


_SCORED = """WITH scored AS (SELECT lang, doc_id AS ord, quality AS label, CAST(n_chars % 101 AS DOUBLE) / 100.0 AS score FROM documents JOIN labels USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, ord) AS rank, sum(label) OVER (PARTITION BY lang ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING) AS hits FROM scored)
"""


@query("average_precision", _SCORED.replace("PARTITION BY lang ", "") + "SELECT round(sum(CASE WHEN label = 1 THEN hits / rank END) / sum(label), 6) AS ap FROM ranked")
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d), []).select(F.round("ap", 6).alias("ap"))


@query("ap_by_group", _SCORED + "SELECT lang, round(sum(CASE WHEN label = 1 THEN hits / rank END) / sum(label), 6) AS ap FROM ranked GROUP BY lang")
def ap_by_group(spark, d):
    return metrics.average_precision(scored(spark, d), ["lang"]).select("lang", F.round("ap", 6).alias("ap"))


@query(
    "precision_recall_at_k",
    _SCORED
    + """, n AS (SELECT lang, count(*) AS n, sum(label) AS pos FROM scored GROUP BY lang), shares AS (SELECT lang, pos, percent, greatest(1, CAST(round_even(n * percent / 100, 0) AS BIGINT)) AS k FROM n, (VALUES (0.5::DOUBLE), (1), (2), (5), (10)) v(percent))
SELECT s.lang, percent, k, round(sum(CASE WHEN rank <= k THEN label ELSE 0 END) / k, 6) AS precision, round(sum(CASE WHEN rank <= k THEN label ELSE 0 END) / any_value(pos), 6) AS recall FROM shares s JOIN ranked r ON r.lang = s.lang GROUP BY s.lang, percent, k""",
)
def precision_recall_at_k(spark, d):
    return metrics.at_k(scored(spark, d), ["lang"], [0.5, 1, 2, 5, 10]).select("lang", "percent", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("calibration_curve", _SCORED + "SELECT lang, CAST(least(4, floor(score * 5)) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate FROM scored GROUP BY 1, 2")
def calibration_curve(spark, d):
    return metrics.calibration_curve(scored(spark, d), ["lang"], 5).select("lang", "bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positive_rate", 6).alias("positive_rate"))


@query("ece", _SCORED + "SELECT lang, round(sum(n * abs(s - y)) / sum(n), 6) AS ece FROM (SELECT lang, count(*) AS n, avg(score) AS s, avg(label) AS y FROM scored GROUP BY lang, least(9, floor(score * 10))) GROUP BY lang")
def ece(spark, d):
    return metrics.expected_calibration_error(scored(spark, d), ["lang"]).select("lang", F.round("ece", 6).alias("ece"))


@query(
    "ranking_metrics",
    _SCORED
    + """, n AS (SELECT lang, greatest(1, CAST(round_even(count(*) / 100, 0) AS BIGINT)) AS k1, greatest(1, CAST(round_even(count(*) * 5.0::DOUBLE / 100, 0) AS BIGINT)) AS k5, sum(label) AS pos FROM scored GROUP BY lang),
tops AS (SELECT lang, sum(CASE WHEN label = 1 THEN hits / rank END) / any_value(pos) AS ap, sum(label) FILTER (rank <= k1) AS t1, sum(label) FILTER (rank <= k5) AS t5, any_value(k1) AS k1, any_value(k5) AS k5, any_value(pos) AS pos FROM ranked JOIN n USING (lang) GROUP BY lang),
cells AS (SELECT lang, sum(n * abs(s - y)) / sum(n) AS ece FROM (SELECT lang, count(*) AS n, avg(score) AS s, avg(label) AS y FROM scored GROUP BY lang, least(9, floor(score * 10))) GROUP BY lang)
SELECT lang, round(ap, 6) AS ap, round(ece, 6) AS ece, round(t1 / k1, 6) AS precision_1, round(t5 / k5, 6) AS precision_5, round(t1 / pos, 6) AS recall_1, round(t5 / pos, 6) AS recall_5 FROM tops JOIN cells USING (lang)""",
)
def ranking_metrics(spark, d):
    m = metrics.ranking_metrics(scored(spark, d), ["lang"])
    return m.select("lang", *[F.round(c, 6).alias(c) for c in ("ap", "ece", "precision_1", "precision_5", "recall_1", "recall_5")])


@query("accuracy", "SELECT round(avg(CASE WHEN quality = CAST(n_chars % 2 AS INTEGER) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id)")
def accuracy(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").withColumn("p", F.col("n_chars") % 2)
    return metrics.accuracy(df, "quality", "p").select(F.round("accuracy", 6).alias("accuracy"))


# labels of this data are notice types and tags; a summary is the label in words, and a correction is "major" in both
_TAGGED = CTES + """, evidence AS (SELECT doi, string_agg(source_name || ' ' || label || ' ' || CASE kind WHEN 0 THEN 'Official ' || replace(label, '_', ' ') || ' notice recorded in ' || source_name || '.'
  ELSE 'External integrity signal: ' || replace(label, '_', ' ') || '.' END, chr(10)) AS t FROM known GROUP BY doi),
pred AS (SELECT r.doi, r.core_tags || ';' || r.extension_tags AS truth, lower(coalesce(t, '')) AS t FROM records r LEFT JOIN evidence USING (doi)),
flags AS (SELECT doi, tag, contains(truth, tag) AS y, CASE tag WHEN 'retraction' THEN contains(t, 'retraction') WHEN 'expression_of_concern' THEN contains(t, 'expression_of_concern') OR contains(t, 'expression of concern')
  WHEN 'major_correction' THEN contains(t, 'major_correction') OR contains(t, 'major correction') WHEN 'community_flag' THEN contains(t, 'community') WHEN 'image_issue' THEN contains(t, 'image') OR contains(t, 'figure') OR contains(t, 'duplication')
  WHEN 'tortured_phrase' THEN contains(t, 'tortured phrase') WHEN 'metadata_anomaly' THEN contains(t, 'metadata') OR contains(t, 'authorship') OR contains(t, 'revision timing') ELSE contains(t, 'paper mill') OR contains(t, 'template family') END AS p
  FROM pred, (VALUES ('retraction'), ('expression_of_concern'), ('major_correction'), ('community_flag'), ('image_issue'), ('paper_mill_signal'), ('tortured_phrase'), ('metadata_anomaly')) v(tag))
"""


def tagged(spark, d) -> DataFrame:
    return built(spark, d).select("doi", F.concat("core_tags", "extension_tags").alias("truth"), models.predicted_tags(models.evidence_text()).alias("predicted"))


@query("keyword_tagger", _TAGGED + "SELECT doi, coalesce(string_agg(tag, ';' ORDER BY tag) FILTER (p), '') AS tags FROM flags GROUP BY doi")
def keyword_tagger(spark, d):
    return tagged(spark, d).select("doi", F.array_join("predicted", ";").alias("tags"))


@query("macro_f1", _TAGGED + """SELECT tag, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn,
  round(CASE WHEN count(*) FILTER (y OR p) = 0 THEN 0 ELSE 2.0 * count(*) FILTER (y AND p) / (2 * count(*) FILTER (y AND p) + count(*) FILTER (y <> p)) END, 6)::DOUBLE AS f1 FROM flags GROUP BY tag""")
def macro_f1(spark, d):
    return metrics.macro_f1(tagged(spark, d), "truth", "predicted", list(models.TAG_WORDS)).select("tag", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("coverage", CTES + "SELECT round(avg(CASE WHEN core_tags <> '' OR n_ext > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM records")
def coverage(spark, d):
    return metrics.provenance_coverage(built(spark, d), "source_names", "source_urls").select(F.round("coverage", 6).alias("coverage"))


_TOKENS = """WITH tok AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 2) AS t FROM documents),
vocab AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM tok) GROUP BY token ORDER BY df DESC, token LIMIT 128)
"""


@query("doc_freq_top128", _TOKENS + "SELECT token, df FROM vocab")
def doc_freq_top128(spark, d):
    return models.vocabulary(read(spark, d, "documents"), F.col("text")).select("token", "df")


@query(
    "tfidf",
    _TOKENS
    + """, one AS (SELECT doc_id, unnest(t) AS token, len(t) AS total FROM tok), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, one.token, round(count(*) / any_value(total) * (ln(1 + any_value(n.n) / (1 + any_value(df))) + 1), 5) AS tf_idf FROM one JOIN vocab ON one.token = vocab.token, n GROUP BY doc_id, one.token""",
)
def tfidf(spark, d):
    docs = read(spark, d, "documents")
    return models.tf_idf(docs, "doc_id", F.col("text"), models.vocabulary(docs, F.col("text"))).select("doc_id", "token", F.round("tf_idf", 5).alias("tf_idf"))


@query(
    "onehot",
    CTES
    + """, f AS (SELECT CAST(doi AS BIGINT) AS o, doi, unnest([{'p': 0, 'f': 'venue=' || venue}, {'p': 1, 'f': 'publisher=' || publisher}, {'p': 2, 'f': 'subfield=' || subfield}, {'p': 3, 'f': 'oa_status=' || oa_status}]) AS x FROM records),
dict AS (SELECT x.f AS f, row_number() OVER (ORDER BY min((o, x.p))) - 1 AS idx FROM f GROUP BY x.f)
SELECT doi, CAST(idx AS INTEGER) AS idx FROM f JOIN dict ON f.x.f = dict.f""",
)
def onehot(spark, d):
    r = built(spark, d).withColumn("ord", F.col("doi").cast("long"))
    return models.one_hot(r, models.category_dictionary(r))


@query("dot_product", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS sq FROM embeddings")
def dot_product(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("embedding")), 4).alias("sq"))


@query("sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS s FROM events")
def sigmoid(spark, d):
    return read(spark, d, "events").select("event_id", F.round(S.sigmoid((F.col("value") - 50) / 10), 6).alias("s"))


@query(
    "robustness_pivot",
    """SELECT o_orderstatus AS model, round(max(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS "1-URGENT", round(max(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 2) AS "2-HIGH",
  round(max(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 2) AS "5-LOW" FROM orders GROUP BY o_orderstatus""",
)
def robustness_pivot(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("split"), F.col("o_totalprice").alias("auprc"))
    splits = ["1-URGENT", "2-HIGH", "5-LOW"]
    return metrics.score_table(o, "model", "split", "auprc", splits).select("model", *[F.round(F.col(f"`{s}`"), 2).alias(s) for s in splits])


@query("best_run", "SELECT o_orderpriority AS task, arg_max(o_orderkey, (coalesce(o_totalprice, -1e308), -o_orderkey)) AS run FROM orders GROUP BY 1")
def best_run(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("run"), "o_totalprice")
    return metrics.best_runs(o, ["task"], "run", "o_totalprice")


@query("bootstrap_ci", None)
def bootstrap_ci(spark, d):
    return metrics.bootstrap_ci(scored(spark, d), ["lang"])


@query(
    "logistic_gd",
    """WITH RECURSIVE scored AS (SELECT lang, doc_id AS ord, CAST(quality AS DOUBLE) AS y, CAST(n_chars % 101 AS DOUBLE) / 100.0 AS x0, (doc_id % 7) / 7.0::DOUBLE AS x1 FROM documents JOIN labels USING (doc_id)),
step AS (
  SELECT 0 AS e, lang, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS b FROM scored WHERE ord % 3 <> 0 GROUP BY lang
  UNION ALL
  SELECT any_value(e) + 1, s.lang, any_value(w0) - 0.25::DOUBLE * (avg((1 / (1 + exp(-(w0 * x0 + w1 * x1 + b))) - y) * x0) + 0.001::DOUBLE * any_value(w0)),
    any_value(w1) - 0.25::DOUBLE * (avg((1 / (1 + exp(-(w0 * x0 + w1 * x1 + b))) - y) * x1) + 0.001::DOUBLE * any_value(w1)),
    any_value(b) - 0.25::DOUBLE * avg(1 / (1 + exp(-(w0 * x0 + w1 * x1 + b))) - y)
  FROM step s JOIN scored USING (lang) WHERE ord % 3 <> 0 AND e < 400 GROUP BY s.lang)
SELECT lang, ord, CAST(y AS INTEGER) AS label, round(1 / (1 + exp(-(w0 * x0 + w1 * x1 + b))), 6) AS score FROM scored JOIN step USING (lang) WHERE e = 400 AND ord % 3 = 0""",
)
def logistic_gd(spark, d):
    df = scored(spark, d).withColumn("features", F.array("score", (F.col("ord") % 7) / 7.0)).withColumn("part", F.when(F.col("ord") % 3 == 0, "test").otherwise("train"))
    fitted = models.fit_groups(df.withColumn("label", F.col("label").cast("int")), ["lang"], task_cells=0)  # by distributed steps, as groups of any size can be
    return fitted.select("lang", "ord", "label", F.round("score", 6).alias("score"))
