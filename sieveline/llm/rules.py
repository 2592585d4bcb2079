"""Quality rules: text statistics and a learned decision list, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, in_training_fold, materialize, training_labels

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (*BASE, "n_upper", "n_punct", "n_digits", "n_lines", "n_distinct")
#: Ratios that the learned conditions test, all from the whole text.
RATIOS = {
    "mean_word_chars": lambda c: F.col("word_chars") / c("n_words"),
    "symbol_share": lambda c: F.col("n_symbols") / c("word_chars"),
    "dup_line_share": lambda c: F.col("n_dup_lines") / c("n_words"),
    "repeat_share": lambda c: F.col("n_repeat_words") / c("n_words"),
    "upper_share": lambda c: F.col("n_upper") / c("word_chars"),
    "punct_share": lambda c: F.col("n_punct") / c("word_chars"),
    "digit_share": lambda c: F.col("n_digits") / c("word_chars"),
    "words_per_line": lambda c: F.col("n_words") / c("n_lines"),
    "distinct_share": lambda c: F.col("n_distinct") / c("n_words"),
    "log_words": lambda c: F.log1p(F.col("n_words")),
}
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array, the first occurrence included.

    Windows are compared by 64-bit hashes of their words' hashes. If any repeats, hashes are sorted with their
    positions, neighbours with equal hashes mark their positions, and each marked position adds the words up to the
    next marked one, 5 at most.
    """

    def positions(hashed: Column) -> Column:
        last = F.size(hashed) - 1
        same = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: ((j > 0) & (F.get(hashed, j - 1)["h"] == F.get(hashed, j)["h"])) | ((j < last) & (F.get(hashed, j + 1)["h"] == F.get(hashed, j)["h"])),
        )
        return F.array_sort(F.transform(same, lambda j: F.get(hashed, j)["i"]))

    def covered(at: Column) -> Column:
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(
            F.aggregate(
                F.zip_with(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW))),
                F.lit(WINDOW),
                lambda total, x: total + x,
            )
        )

    def of(w: Column) -> Column:
        windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        ordered = lambda x: F.array_sort(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # where all windows differ, which a hash set tells fast, there is nothing to sort
        repeated = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_let(ordered(x), lambda s: _let(positions(s), covered)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(windows(h), repeated)))

    return of(words).cast("long")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, statistics), and with keep the whole input row as the struct `row`; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # inline() of one struct keeps the arrays from being computed again for each use
    packed = docs.select(
        *([F.struct(*docs.columns).alias("row")] if keep else []),
        F.col(id_col).alias("doc_id"),
        F.inline(F.array(F.struct(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_PATTERN)).alias("ln")))),
    )
    w, ln = F.col("w"), F.col("ln")
    joined = F.array_join(w, "")
    count = lambda pattern: (F.length(joined) - F.length(F.regexp_replace(joined, pattern, ""))).cast("long")
    stats = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_upper": count(r"\p{Lu}"),
        "n_punct": count(r"\p{Punct}"),
        "n_digits": count(r"[0-9]"),
        "n_lines": F.size(ln).cast("long"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
    }
    return packed.select(*(["row"] if keep else []), "doc_id", *[v.alias(k) for k, v in stats.items()])


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def ratio(name: str) -> Column:
    """A ratio, or null where it has no denominator: then no condition on it holds."""
    return F.round(RATIOS[name](lambda c: F.nullif(F.col(c), F.lit(0))), 6)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = ratio(self.feature)
        return F.coalesce(value >= self.threshold if self.above else value < self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def decision_list(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does: one ordered conditional expression."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(rule_column(rule), F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def learn_rules(
    labelled: DataFrame,
    quantiles: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: float = 0.004,
) -> list[Rule]:
    """Rules that tell rejects (bad = 1) from labelled(key, bad, statistics), by sequential covering.

    Candidate thresholds are approximate quantiles of each label's rows. A rule grows by the condition of the largest
    FOIL gain on two thirds of the rows, is pruned from its end by (p - n) / (p + n) on the other third, and is kept if
    its precision there, with one error added, reaches min_precision and it covers min_covered of the rejects. Rows
    that it covers then leave. Each step counts rows by label, feature and threshold interval, so the driver only sees
    counts. No rows, or labels of one kind only, give no rules.
    """
    names = list(RATIOS)
    grow = F.crc32(F.col("key").cast("string").cast("binary")) % 9 < 6
    data = materialize(labelled.where("bad is not null").select("bad", grow.alias("grow"), *[ratio(n).alias(n) for n in names]), "rule-ratios")
    probs = [(k + 0.5) / quantiles for k in range(quantiles)]
    found = data.groupBy("bad").agg(F.count("*").alias("rows"), *[F.percentile_approx(n, probs, 2000).alias(n) for n in names]).collect()
    if len(found) < 2:
        return []
    total = next(r.rows for r in found if r.bad == 1)
    cuts = {n: sorted({float(v) for r in found for v in r[n] or ()}) for n in names}
    # the interval of each value: how many thresholds are at or below it; -1 for null
    def place(name: str) -> Column:
        value = F.col(name)
        at = F.size(F.filter(F.array(*[F.lit(t) for t in cuts[name]]), lambda t: t <= value)) if cuts[name] else F.lit(-1)
        return F.when(value.isNull(), F.lit(-1)).otherwise(at).cast("int").alias(name)

    data = materialize(data.select("bad", "grow", *map(place, names)), "rule-intervals")

    def test(c: Condition) -> Column:
        k = cuts[c.feature].index(c.threshold) + 1
        return F.col(c.feature) >= k if c.above else F.col(c.feature).between(0, k - 1)

    def counts_of(rows: DataFrame) -> dict[Condition, list[int]]:
        """(other rows, rejects) that meet each candidate, from one count by label, feature and interval."""
        cells = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("k")) for n in names])).alias("x"))
        got = cells.groupBy("bad", "x.f", "x.k").count().collect()
        out = {}
        for n in names:
            own = [(r.k, r.bad, r["count"]) for r in got if r.f == n and r.k >= 0]
            for k, t in enumerate(cuts[n], 1):
                for above in (True, False):
                    hit = [0, 0]
                    for at, bad, c in own:
                        if (at >= k) == above:
                            hit[bad] += c
                    out[Condition(n, above, t)] = hit
        return out

    rules: list[Rule] = []
    left = data
    while len(rules) < max_rules:
        grown: list[Condition] = []
        rows = left.where("grow")
        all_ = {r.bad: r["count"] for r in rows.groupBy("bad").count().collect()}
        n0, p0 = all_.get(0, 0), all_.get(1, 0)
        while len(grown) < max_conditions and p0 and n0:
            before = math.log2(p0 / (p0 + n0))
            best = (0.0, None, 0, 0)
            for c, (n, p) in counts_of(rows).items():
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best[0] + 1e-9:
                    best = (gain, c, n, p)
            if best[1] is None:
                break
            grown.append(best[1])
            n0, p0 = best[2:]
            rows = rows.where(test(best[1]))
        if not grown:
            break
        prefixes = [reduce(lambda a, b: a & b, [test(c) for c in grown[: k + 1]]) for k in range(len(grown))]
        held = {r.bad: r for r in left.where("not grow").groupBy("bad").agg(*[F.count_if(x).alias(f"c{i}") for i, x in enumerate(prefixes)]).collect()}
        counts = [tuple(held[b][f"c{i}"] if b in held else 0 for b in (1, 0)) for i in range(len(grown))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
        k = max(range(len(grown)), key=lambda i: (worth[i], -i))
        p, n = counts[k]
        if not p or p / (p + n + 1) < min_precision or p < min_covered * total / 3:
            break
        rules.append(tuple(grown[: k + 1]))
        left = left.where(~prefixes[k])
    return rules


def learn_from(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from statistics(doc_id, ...) of documents that pass the base checks and the labels of the training fold."""
    y = training_labels(labels, "quality").withColumnRenamed("doc_id", "key")
    train = stats.where(~base_failed()).select(F.col("doc_id").alias("key"), *STATISTICS)
    return learn_rules(train.join(y, "key").withColumn("bad", 1 - F.col("y")))


def with_verdict(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", decision_list(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(doc_id, statistics, base_failed, rule, kept) for each row of docs, and the learned rules.

    Statistics are written once to the shared folder. Labels are learned only from rows of the training fold; a row
    is kept if it neither fails the base checks nor meets a learned rule. Null and empty texts have no words and so
    fail the base checks. Null ids are judged like any but teach nothing. Repeated rows are judged alike; an empty
    table gives no rows; other columns, whatever their names, have no effect.
    """
    stats = materialize(with_statistics(docs, id_col, text_col), "rule-statistics")
    rules = learn_from(stats, labels)
    return with_verdict(stats, rules), rules


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; judged as by judge().

    Only the training fold's statistics are written; the verdict then streams over docs, so no text is stored or
    shuffled.
    """
    train = docs.where(in_training_fold(F.col(id_col)))
    rules = learn_from(materialize(with_statistics(train, id_col, text_col), "rule-statistics"), labels)
    return with_verdict(with_statistics(docs, id_col, text_col, keep=True), rules).where("kept").select("row.*")
