"""Features and small transparent baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .ranks import cut

CATEGORIES = ("venue", "publisher", "subfield", "oa_status")


def category_features(df: DataFrame) -> Column:
    return F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in CATEGORIES])


def category_dictionary(train: DataFrame, order: str = "ord") -> DataFrame:
    """(feature, idx) in the order in which features are first seen; a feature's first row and column decide."""
    seen = train.select(F.col(order).alias("o"), F.posexplode(category_features(train)).alias("pos", "feature"))
    first = seen.groupBy("feature").agg(F.min(F.struct("o", "pos")).alias("first"))
    return first.select("feature", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("idx"))


NUMERIC_NAMES = ("publication_year", "openalex_life_science_score", "references_count", "author_history_signal_count", "journal_history_signal_count", "is_pubmed_indexed")


def numeric_features() -> Column:
    return F.array(
        (F.col("publication_year") - 2000) / 24.0,
        F.col("openalex_life_science_score"),
        F.col("references_count") / 100.0,
        F.col("author_history_signal_count") / 10.0,
        F.col("journal_history_signal_count") / 10.0,
        F.col("is_pubmed_indexed").cast("double"),
    )


def one_hot(df: DataFrame, dictionary: DataFrame, key: str = "doi") -> DataFrame:
    """(key, idx) of the dictionary's features that a row has; unseen ones give nothing."""
    return df.select(key, F.explode(category_features(df)).alias("feature")).join(dictionary, "feature").select(key, "idx")


def vocabulary(docs: DataFrame, text: Column, size: int = 128) -> DataFrame:
    """(token, df, n_docs) of the tokens in most texts; ties in alphabetical order."""
    tokens = docs.select(F.explode(F.array_distinct(S.tokenize(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))
    return tokens.orderBy(F.desc("df"), "token").limit(size).crossJoin(F.broadcast(n))


def tf_idf(docs: DataFrame, key: str, text: Column, vocab: DataFrame) -> DataFrame:
    """(key, token, tf_idf) of vocabulary tokens; frequencies are shares of all tokens, known or not."""
    words = docs.select(F.col(key), S.tokenize(text).alias("w"))
    known = words.select(key, F.size("w").alias("total"), F.explode("w").alias("token")).join(F.broadcast(vocab), "token")  # before anything is shuffled
    counted = known.groupBy(key, "total", "token", "df", "n_docs").agg(F.count("*").alias("c"))
    idf = F.log(1 + F.col("n_docs") / (1 + F.col("df"))) + 1
    return counted.select(key, "token", (F.col("c") / F.col("total") * idf).alias("tf_idf"))


class LogisticRegression:
    """Full-batch gradient descent with a fixed number of steps; the bias is not shrunk."""

    def __init__(self, rate: float = 0.25, epochs: int = 400, l2: float = 0.001):
        self.rate, self.epochs, self.l2 = rate, epochs, l2
        self.weights, self.bias = np.zeros(0), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> LogisticRegression:
        x, y = np.asarray(x, float), np.asarray(y, float)
        if x.ndim != 2 or len(x) != len(y):
            raise ValueError("features must be a table with one row for each label")
        self.weights, self.bias = np.zeros(x.shape[1]), 0.0
        for _ in range(self.epochs):
            off = self.predict(x) - y
            self.weights = self.weights - self.rate * (x.T @ off / len(y) + self.l2 * self.weights)
            self.bias -= self.rate * off.mean()
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if x.ndim != 2 or x.shape[1] != len(self.weights):
            raise ValueError("features have another width than the model")
        z = x @ self.weights + self.bias
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


#: Cells (feature values of training rows) of a model that one task fits; larger models are fitted by one aggregation a step.
TASK_CELLS = 5_000_000
#: Cells of one partition of a distributed step, about.
STEP_CELLS = 200_000
#: Bytes of weights that are sent to all tasks; more are joined.
SENT_BYTES = 64 << 20


def _cells(df: DataFrame, features: str) -> Column:
    """Features as sparse (i, v) cells: they are such already, or numbers by their place."""
    if "struct" in dict(df.dtypes)[features]:
        return F.transform(features, lambda c: F.struct(c["i"].cast("int").alias("i"), c["v"].cast("double").alias("v")))
    return F.transform(features, lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")))


def _score(cells: str) -> Column:
    """The prediction for cells under the columns w and b; places beyond the weights count nothing."""
    return S.sigmoid(F.aggregate(cells, F.col("b"), lambda z, c: z + c["v"] * F.coalesce(F.get("w", c["i"]), F.lit(0.0))))


class Descent:
    """Full-batch descents of several models at once: each step is one job, gradients summed by model and feature in the tasks first.

    The driver holds the weights, a number for each feature of each model, and no rows.
    """

    def __init__(self, train: DataFrame, by: list[str], label: str = "label", features: str = "features", rate: float = 0.25, epochs: int = 400, l2: float = 0.001):
        self.by, self.kinds, self.spark = by, dict(train.dtypes), train.sparkSession
        self.rate, self.epochs, self.l2 = rate, epochs, l2
        rows = cut(train.select(*by, F.col(label).cast("double").alias("_y"), _cells(train, features).alias("_cells")))
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.size("_cells")).alias("cells"), F.max(F.array_max(F.transform("_cells", lambda c: c["i"]))).alias("top")).collect()  # a row for each model
        # few rows stay together, as a step over one partition has no exchange
        self.rows = rows.coalesce(max(1, -(-sum(r.n + r.cells for r in sizes) // STEP_CELLS))).persist()
        self.n = {tuple(r[c] for c in by): r.n for r in sizes}
        self.w = {tuple(r[c] for c in by): np.zeros(0 if r.top is None else r.top + 1) for r in sizes}
        self.b = dict.fromkeys(self.n, 0.0)

    def weights(self) -> DataFrame:
        """(by, w, b) of each model."""
        schema = "".join(f"{c} {self.kinds[c]}, " for c in self.by) + "w array<double>, b double"
        keys = {c: pa.array([k[i] for k in self.w]) for i, c in enumerate(self.by)}
        found = {"w": pa.array(self.w.values(), pa.list_(pa.float64())), "b": pa.array([float(self.b[k]) for k in self.w], pa.float64())}
        return self.spark.createDataFrame(pa.table(keys | found), schema) if self.w else self.spark.createDataFrame([], schema)

    def beside(self, rows: DataFrame) -> DataFrame:
        """rows with the weights of their model."""
        weights = self.weights()
        if sum(w.nbytes for w in self.w.values()) <= SENT_BYTES:
            weights = F.broadcast(weights)
        return rows.join(weights, self.by) if self.by else rows.crossJoin(F.broadcast(weights))  # one model

    def step(self) -> None:
        off = self.beside(self.rows).select(*self.by, "_cells", (_score("_cells") - F.col("_y")).alias("off"))
        bias = F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("v")))
        parts = off.select(*self.by, "off", F.explode(F.concat("_cells", bias)).alias("c")).groupBy(*self.by, "c.i").agg(F.sum(F.col("off") * F.col("c.v")).alias("g"))
        slope = {k: np.zeros(len(w)) for k, w in self.w.items()}
        for r in parts.collect():  # as many numbers as there are weights
            k = tuple(r[c] for c in self.by)
            if r.i < 0:
                self.b[k] -= self.rate * r.g / self.n[k]
            else:
                slope[k][r.i] = r.g
        for k, g in slope.items():
            self.w[k] = self.w[k] - self.rate * (g / self.n[k] + self.l2 * self.w[k])

    def fit(self) -> Descent:
        for _ in range(self.epochs):
            self.step()
        self.rows.unpersist()
        return self


def fit_logistic(df: DataFrame, features: str = "features", label: str = "label", rate: float = 0.25, epochs: int = 400, l2: float = 0.001) -> tuple[list[float], float]:
    """Weights and bias of one model over all rows of df, by distributed steps."""
    found = Descent(df, [], label, features, rate, epochs, l2).fit()
    return found.w[()].tolist(), found.b[()]


class _Sparse:
    """Rows of (place, value) pairs, or of numbers, as arrays of cells."""

    def __init__(self, features: list):
        pairs = [(r, c["i"], c["v"]) if isinstance(c, dict) else (r, k, c) for r, cells in enumerate(features) for k, c in enumerate(cells)]
        self.n = len(features)
        self.row, self.at = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.value = np.array([p[2] for p in pairs], float)
        self.width = int(self.at.max()) + 1 if len(pairs) else 0

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        known = self.at < len(w)
        z = np.bincount(self.row[known], self.value[known] * w[self.at[known]], self.n) + b
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1 / (1 + e), e / (1 + e))

    def fit(self, y: np.ndarray, rate: float, epochs: int, l2: float) -> tuple[np.ndarray, float]:
        w, b = np.zeros(self.width), 0.0
        for _ in range(epochs):
            off = self.scores(w, b) - y
            w = w - rate * (np.bincount(self.at, self.value * off[self.row], self.width) / self.n + l2 * w)
            b -= rate * off.mean()
        return w, b


def _by_size(df: DataFrame, by: list[str], task_cells: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the models that a task can hold, and those of the others, if there are any."""
    cells = df.groupBy(*by).agg(F.sum(F.size("features").cast("long")).alias("_size"))
    large = [tuple(r[c] for c in by) for r in cells.where(F.col("_size") > task_cells).collect()]  # a row for each model
    if not large:
        return df, None
    kinds = dict(df.dtypes)
    keys = F.broadcast(df.sparkSession.createDataFrame(large, ", ".join(f"{c} {kinds[c]}" for c in by)))
    return df.join(keys, by, "left_anti"), df.join(keys, by, "left_semi")


def fit_groups(df: DataFrame, by: list[str], rate: float = 0.25, epochs: int = 400, l2: float = 0.001, keep: list[str] | None = None, task_cells: int = TASK_CELLS) -> DataFrame:
    """(by, ord, label, score, keep): for each group (a model of a split) fit on rows of part 'train' and score those of 'test'.

    Features are numbers, or sparse (i, v) pairs; a place that no training row has counts nothing. Groups of no more
    than task_cells feature values are fitted by a task each; all others at once by distributed steps, with the same
    weights but for rounding. Groups without rows to train or test on give none.
    """
    kinds = dict(df.dtypes)
    more = keep or []
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", ord long, label int, score double" + "".join(f", {c} {kinds[c]}" for c in more)
    small, large = _by_size(df, by, task_cells)

    def run(key, pdf):
        import pandas as pd

        names = [*by, "ord", "label", "score", *more]
        train, test = (pdf[pdf["part"] == p].sort_values("ord") for p in ("train", "test"))
        if not len(train) or not len(test):
            return pd.DataFrame([], columns=names)
        w, b = _Sparse(train["features"].to_list()).fit(train["label"].to_numpy(float), rate, epochs, l2)
        out = test[["ord", "label", *more]].assign(score=_Sparse(test["features"].to_list()).scores(w, b))
        for c, v in zip(by, key):
            out[c] = v
        return out[names]

    fitted = small.groupBy(*by).applyInPandas(run, schema)
    if large is None:
        return fitted
    found = Descent(large.where("part = 'train'"), by, rate=rate, epochs=epochs, l2=l2).fit()
    test = large.where("part = 'test'").withColumn("_cells", _cells(large, "features"))
    scored = found.beside(test).select(*by, F.col("ord").cast("long").alias("ord"), F.col("label").cast("int").alias("label"), _score("_cells").alias("score"), *more)
    return fitted.unionByName(scored)


def fit_weights(df: DataFrame, by: list[str], rate: float = 0.25, epochs: int = 400, l2: float = 0.001, task_cells: int = TASK_CELLS) -> DataFrame:
    """(by, idx, weight) of each group's model."""
    kinds = dict(df.dtypes)
    small, large = _by_size(df.where("part = 'train'"), by, task_cells)

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        w, _ = _Sparse(pdf["features"].to_list()).fit(pdf["label"].to_numpy(float), rate, epochs, l2)
        return pd.DataFrame({**dict(zip(by, key)), "idx": np.arange(len(w)), "weight": w})[[*by, "idx", "weight"]]

    fitted = small.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", idx int, weight double")
    if large is None:
        return fitted
    found = Descent(large, by, rate=rate, epochs=epochs, l2=l2).fit()
    return fitted.unionByName(found.weights().select(*by, F.posexplode("w").alias("idx", "weight")))


# The tags of the provenance tagger and the words that stand for each in an evidence entry.
TAG_WORDS = {
    "retraction": ("retraction",),
    "expression_of_concern": ("expression_of_concern", "expression of concern"),
    "major_correction": ("major_correction", "major correction"),
    "community_flag": ("community",),
    "image_issue": ("image", "figure", "duplication"),
    "paper_mill_signal": ("paper mill", "template family"),
    "tortured_phrase": ("tortured phrase",),
    "metadata_anomaly": ("metadata", "authorship", "revision timing"),
}


def evidence_text(entries: str = "provenance") -> Column:
    """What the tagger reads: source, label and summary of each entry, one entry a line."""
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["source_name"], e["observed_label"], e["summary"])), "\n")


def predicted_tags(text: Column) -> Column:
    """Tags of which a word occurs in the evidence text, sorted."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.array_contains(F.array(*[F.contains(t, F.lit(w)) for w in words]), True), F.lit(tag)) for tag, words in TAG_WORDS.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def predicted_status(tags: Column) -> Column:
    return S.notice_status(tags)
