"""Time and group-holdout splits, leakage audit, snapshot validation and adjudication samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import cut
from ..schemas import ALLOWED_NOTICE_TYPES, BANNED_FIELDS, HOLDOUT_FIELDS, TASK_A_FIELDS

#: task name, rows it takes, its label
TASKS = (
    ("task_a_12m", "eligible_for_task_a_12m", "any_signal_or_notice_within_12m"),
    ("task_a_36m", "eligible_for_task_a_36m", "any_signal_or_notice_within_36m"),
    ("task_b", "true", None),
)


def year_parts(years: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, publication_year, part) for distinct years(keys, publication_year): about 60/20/20 of the years in order.

    One year is all train, two are train and test; else the first cut is at least one year, the second at least one
    more, and the last year is always test.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy("publication_year"))
    df = years.withColumn("_n", n).withColumn("_i", i)
    a = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.6))
    b = F.least(F.greatest(a + 1, F.floor(F.col("_n") * 0.8)), F.col("_n") - 1)
    part = (
        F.when(F.col("_n") == 1, "train")
        .when(F.col("_n") == 2, F.when(F.col("_i") == 1, "train").otherwise("test"))
        .when(F.col("_i") <= a, "train")
        .when(F.col("_i") <= b, "val")
        .otherwise("test")
    )
    return df.select(*keys, "publication_year", part.alias("part"))


def time_splits(records: DataFrame) -> DataFrame:
    """(task_name, split_kind, doi, publication_date, publication_year, part) of all tasks and the noisy-date tasks."""
    noisy = lambda last: f"task_a_date_bucket = 'noisy_date' and publication_year <= {last}"
    members = F.array_compact(
        F.array(
            *[F.when(F.expr(cond), F.lit(name)) for name, cond, _ in TASKS],
            F.when(F.expr(noisy(2024)), F.lit("task_a_12m_noisy_date")),
            F.when(F.expr(noisy(2022)), F.lit("task_a_36m_noisy_date")),
        )
    )
    rows = records.select(F.explode(members).alias("task_name"), "doi", "publication_date", "publication_year")
    parts = year_parts(rows.select("task_name", "publication_year").distinct(), ["task_name"])
    return rows.join(F.broadcast(parts), ["task_name", "publication_year"]).withColumn("split_kind", F.lit("time"))


def holdout_groups(records: DataFrame, fields: tuple[str, ...] = HOLDOUT_FIELDS) -> DataFrame:
    """(task_name, group_field, holdout_value) for each task and field that has a fitting group.

    Of groups with two rows or more that leave three, and for the label tasks with both labels, the one with the
    newest record, ties to the least identifier. All tasks and fields go through one aggregation.
    """
    cells = [
        F.when(F.expr(cond), F.struct(F.lit(name).alias("task_name"), F.lit(f).alias("group_field"), F.col(f).alias("holdout_value"), (F.col(label) if label else F.lit(None).cast("boolean")).alias("y")))
        for name, cond, label in TASKS
        for f in fields
    ]
    long = records.select("doi", "publication_date", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("doi", "publication_date", "c.*").where("holdout_value is not null")
    first = F.when(F.col("publication_date").isNotNull(), F.struct((-F.unix_date("publication_date")).alias("d"), F.col("doi").alias("i")))
    groups = long.groupBy("task_name", "group_field", "holdout_value").agg(
        F.count("*").alias("n"),
        (F.min("y") != F.max("y")).alias("both"),
        F.max("publication_date").alias("newest"),
        F.min(first)["i"].alias("head"),
    )
    total = Window.partitionBy("task_name", "group_field")
    fit = groups.where("head is not null").withColumn("total", F.sum("n").over(total))
    fit = fit.where((F.col("n") >= 2) & (F.col("total") - F.col("n") >= 3) & ((F.col("task_name") == "task_b") | F.col("both")))
    rn = F.row_number().over(total.orderBy(F.desc("newest"), F.asc("head")))
    return fit.withColumn("rn", rn).where("rn = 1").select("task_name", "group_field", "holdout_value")


def group_splits(records: DataFrame, fields: tuple[str, ...] = HOLDOUT_FIELDS) -> DataFrame:
    """The chosen group is test; the other rows of train and validation years keep their part and those of test years leave.

    A split without training or validation rows is dropped. The columns that matter are written once, as five steps read them.
    """
    records = cut(records.select("doi", "publication_date", "publication_year", *fields, *{cond: F.expr(cond).alias(cond) for _, cond, _ in TASKS if cond != "true"}.values(), *{label: F.col(label) for _, _, label in TASKS if label}.values()))
    picked = holdout_groups(records, fields)
    cells = [F.when(F.expr(cond), F.struct(F.lit(name).alias("task_name"), F.lit(f).alias("group_field"), F.col(f).alias("value"))) for name, cond, _ in TASKS for f in fields]
    long = records.select("doi", "publication_date", "publication_year", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("doi", "publication_date", "publication_year", "c.*")
    rows = long.join(F.broadcast(picked), ["task_name", "group_field"])
    held = rows.where(F.col("value").eqNullSafe(F.col("holdout_value"))).withColumn("part", F.lit("test"))
    rest = rows.where(~F.col("value").eqNullSafe(F.col("holdout_value")))
    parts = year_parts(rest.select("task_name", "group_field", "publication_year").distinct(), ["task_name", "group_field"])
    good = parts.groupBy("task_name", "group_field").agg(F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "val").alias("v")).where("t > 0 and v > 0")
    kept = rest.join(F.broadcast(parts.where("part != 'test'")), ["task_name", "group_field", "publication_year"])
    out = held.unionByName(kept.select(*held.columns))
    out = out.join(F.broadcast(good.select("task_name", "group_field")), ["task_name", "group_field"], "left_semi")
    return out.select("task_name", "group_field", "holdout_value", "doi", "publication_date", "publication_year", "part").withColumn("split_kind", F.lit("group_holdout"))


def _violations(df: DataFrame, rules: list[tuple[str, Column]], key: str = "doi") -> DataFrame:
    """(rule, key): one row for each rule that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))
    return df.select(F.col(key).alias("doi"), F.explode(broken).alias("rule")).select("rule", "doi")


def leakage_audit(records: DataFrame, snapshot: str, fields: tuple[str, ...] = TASK_A_FIELDS) -> DataFrame:
    """(rule, doi) of records that break time censoring; a feature that tells the outcome is one row, named in place of the identifier."""
    day = F.lit(snapshot).cast("date")
    pub = F.col("publication_date")
    before = lambda c: F.col(c) < pub
    rules = [
        ("snapshot_mismatch", F.col("snapshot_date") != day),
        ("notice_before_publication", before("first_notice_date")),
        ("signal_before_publication", before("first_signal_date")),
        ("event_after_snapshot", F.greatest("first_notice_date", "first_signal_date") > day),
        ("missing_cutoff", F.col("task_a_feature_cutoff_date").isNull() | F.col("author_history_cutoff_date").isNull() | F.col("journal_history_cutoff_date").isNull()),
        ("feature_cutoff_not_publication", F.col("task_a_feature_cutoff_date") != pub),
        ("author_history_after_publication", F.col("author_history_cutoff_date") > pub),
        ("journal_history_after_publication", F.col("journal_history_cutoff_date") > pub),
    ]
    out = _violations(records, rules)
    banned = banned_features(fields)
    if banned:
        out = out.unionByName(records.sparkSession.createDataFrame([("banned_feature", f) for f in banned], "rule string, doi string"))
    return out


def banned_features(fields: tuple[str, ...] = TASK_A_FIELDS) -> list[str]:
    return sorted(set(fields) & set(BANNED_FIELDS))


def validate_snapshot(articles: DataFrame, notices: DataFrame, snapshot: str) -> DataFrame:
    """(rule, doi) of a canonical snapshot's broken promises."""
    day = F.lit(snapshot).cast("date")
    repeated = articles.groupBy("doi").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_doi").alias("rule"), "doi")
    own = _violations(
        articles,
        [
            ("publication_after_snapshot", F.col("publication_date") > day),
            ("imputed_year_in_primary", (F.col("task_a_date_bucket") == "primary") & (F.col("publication_date_precision") == "year_imputed")),
        ],
    )
    dates = articles.groupBy("doi").agg(F.min("publication_date").alias("publication_date"))
    events = _violations(
        notices.join(dates, "doi", "left"),
        [
            ("unknown_notice_type", ~F.col("notice_type").isin(*ALLOWED_NOTICE_TYPES)),
            ("notice_before_publication", F.col("notice_date") < F.col("publication_date")),
            ("notice_after_snapshot", F.col("notice_date") > day),
        ],
    )
    return reduce(DataFrame.unionByName, [repeated, own, events])


def summary_mismatches(expected: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """(field, expected, actual) of one-row tables' counts that differ."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").cast("long").alias("expected"), F.col(f"a.{f}").cast("long").alias("actual")) for f in fields])
    return expected.alias("e").crossJoin(actual.alias("a")).select(F.explode(pairs).alias("p")).select("p.*").where("not expected <=> actual")


def adjudication_rows(records: DataFrame, strata: list[str], order: list[str], sample: int = 500) -> DataFrame:
    """Round robin over strata: the first row of each, then the second of each, up to the sample's size."""
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    # no stratum gives more rows than the sample has; the condition goes into the window
    return records.withColumn("turn_no", rn.cast("long")).where(F.col("turn_no") <= sample).orderBy("turn_no", *strata).limit(sample)


def strata_counts(rows: DataFrame, strata: list[str]) -> DataFrame:
    return rows.groupBy(F.concat_ws("|", *strata).alias("stratum")).agg(F.count("*").alias("n"))
