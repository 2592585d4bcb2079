"""Canonicalisation: winners, lineage, enrichment, notice matching and time-censored history counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def winners(df: DataFrame, key: str | list[str], rank: list[Column], ties: list[Column]) -> DataFrame:
    """The best row of each key: greatest ranks first, then the least tie-breakers."""
    w = Window.partitionBy(key).orderBy(*[r.desc() for r in rank], *[t.asc() for t in ties])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def article_rank() -> list[Column]:
    precision = F.when(F.col("publication_date_precision") == "day", 2).when(F.col("publication_date_precision") == "month_imputed", 1).otherwise(0)
    return [
        (F.trim(F.coalesce("abstract", F.lit(""))) != "").cast("int"),
        precision,
        F.size("authors"),
        F.size("institutions"),
        (F.col("venue") != "Unknown Venue").cast("int"),
        (F.col("publisher") != "Unknown Publisher").cast("int"),
        F.col("openalex_life_science_score"),
    ]


def lineage_key(file_id: str = "source_file_id", line: str = "source_line_number") -> Column:
    return F.concat(F.col(file_id), F.lit(":"), F.lpad(F.col(line).cast("string"), 8, "0"))


def merge_articles(articles: DataFrame) -> DataFrame:
    """One article per identifier, with the sorted lineage of all its rows."""
    best = winners(articles, "doi", article_rank(), [lineage_key()])
    out = best.join(lineage(articles), "doi")
    return out.withColumn("source_lineage", F.when(F.col("_n") > 1, F.col("_lineage")).otherwise(F.col("source_lineage"))).drop("_lineage", "_n")


def lineage(articles: DataFrame) -> DataFrame:
    """(doi, _lineage, _n): the sorted distinct lineage of all rows of an identifier, and their number.

    Repeats go by grouping before the lists are made: array_distinct() compares every two structs of a list.
    """
    steps = articles.select("doi", F.posexplode_outer("source_lineage").alias("pos", "step"))
    steps = steps.groupBy("doi", "step").agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"))
    return steps.groupBy("doi").agg(F.sort_array(F.collect_list("step")).alias("_lineage"), F.sum("rows").alias("_n"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(key)).alias("duplicates"))


def overrides_subfield(current: Column, hint: Column) -> Column:
    return (F.coalesce(current, F.lit("")) == "") & (F.coalesce(hint, F.lit("")) != "") | (current == "biology") & hint.isin("biomedicine", "bioinformatics")


def enrich_with_pubmed(articles: DataFrame, pubmed: DataFrame) -> DataFrame:
    """Left join of the best index row of each identifier; the first row wins ties."""
    best = winners(pubmed, "doi", [F.size("mesh_terms"), F.size("keywords"), F.size("pubmed_publication_types"), F.col("pmid")], [F.col("source_file_id"), F.col("source_line_number")])
    b = best.select("doi", *[F.col(c).alias(f"_{c}") for c in best.columns if c != "doi"])
    out = articles.join(b, "doi", "left")
    hit = F.col("_source_file_id").isNotNull()
    for c in ("is_pubmed_indexed", "pmid", "mesh_terms", "keywords", "pubmed_publication_types", "pubmed_journal_title"):
        out = out.withColumn(c, F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)))
    step = F.struct(F.lit("pubmed_index").alias("collector_name"), F.col("_source_file_id").alias("source_file_id"), F.col("_source_line_number").alias("source_line_number"))
    out = out.withColumn("source_lineage", F.when(hit, F.array_distinct(F.concat("source_lineage", F.array(step)))).otherwise(F.col("source_lineage")))
    out = out.withColumn("subfield", F.when(hit & overrides_subfield(F.col("subfield"), F.col("_subfield_hint")), F.col("_subfield_hint")).otherwise(F.col("subfield")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


NOTICE_KEYS = ["doi", "notice_type", "notice_date", "source_name", "source_url"]


def dedupe_notices(notices: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each five-column key."""
    return winners(notices, NOTICE_KEYS, [], [F.col(c) for c in order])


def match_notices(articles: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, orphan) notices by identifier."""
    keys = articles.select("doi")
    return notices.join(keys, "doi", "left_semi"), notices.join(keys, "doi", "left_anti")


def flagged_activations(articles: DataFrame, notices: DataFrame) -> DataFrame:
    """Each article that has a notice, with the day from which that counts: its publication or first notice, the later."""
    first = notices.groupBy("doi").agg(F.min("notice_date").alias("first"))
    return articles.join(first, "doi").withColumn("active", F.greatest("publication_date", "first")).drop("first")


def venue_history(articles: DataFrame, notices: DataFrame) -> DataFrame:
    """(doi, journal_history_signal_count): distinct flagged articles of the same venue or publisher, active before publication.

    A count over "venue or publisher" is the venue's plus the publisher's less both's, and each is a running sum over
    a key's days. Days are first summed by key and day, so a key's running sum is over days, not articles, and large
    keys ("Unknown Venue") cost no more than their days.
    """
    flagged = flagged_activations(articles, notices).select("doi", "venue", "publisher", "active")
    day = lambda c: F.unix_date(F.col(c))
    out = articles.select("doi", "venue", "publisher", day("publication_date").alias("day"))
    total = F.lit(0).cast("long")
    for name, keys, sign in (("v", ["venue"], 1), ("p", ["publisher"], 1), ("b", ["venue", "publisher"], -1)):
        events = flagged.groupBy(*keys, day("active").alias("day")).agg(F.count("*").alias("n"))
        asked = out.select(*keys, "day").distinct().withColumn("n", F.lit(0).cast("long"))
        days = events.unionByName(asked).groupBy(*keys, "day").agg(F.sum("n").alias("n"))
        before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        sums = days.select(*keys, "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))
        out = out.join(sums, [*keys, "day"], "left")
        total = total + sign * F.coalesce(F.col(name), F.lit(0))
    return out.select("doi", total.cast("long").alias("journal_history_signal_count"))


#: An author on no more flagged articles than this is rare: such articles are listed for each article that shares the author.
RARE_FLAGGED = 64
#: An article's frequent authors are met by pairs only where a list of their flagged articles has more than so many rows a pair.
LISTED_PER_PAIR = 16


def author_history(articles: DataFrame, notices: DataFrame, rare: int = RARE_FLAGGED) -> DataFrame:
    """(doi, author_history_signal_count): distinct flagged articles that share an author, active before publication.

    The count is of a union over an article's authors, and it is never taken from pairs of a long list. Flagged
    articles of rare authors are listed for each article and counted once. For frequent authors a running sum over
    days tells how many flagged articles were active before a day, so a name on every article costs its days: with one
    such author that is the count, with two the pair's running sum is taken off, and with more, flagged articles
    are met by pairs of them, where one that shares m authors was counted m - 1 times too often. An article with many
    frequent authors has its flagged articles listed as well, where that is less than its pairs. What is both
    listed and shares a frequent author is taken off.
    """
    flagged = flagged_activations(articles, notices).select(F.unix_date("active").alias("active"), F.explode(F.array_distinct("authors")).alias("key"), F.col("doi").alias("other"))
    sizes = flagged.groupBy("key").agg((F.count("*") > rare).alias("frequent"))
    flagged = flagged.join(sizes, "key")
    mine = articles.select("doi", F.unix_date("publication_date").alias("day"), F.explode(F.array_distinct("authors")).alias("key")).join(sizes, "key")
    often, others = mine.where("frequent").drop("frequent"), flagged.where("frequent").drop("frequent")

    known = _counts_before(often, others).where("n > 0")
    per = known.groupBy("doi", "day").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    per = per.withColumn("listed", (F.col("k") > 2) & (F.col("n") <= F.col("k") * (F.col("k") - 1) / 2 * LISTED_PER_PAIR))
    authors = known.select("doi", "day", "key").join(per.select("doi", "k", "listed"), "doi")
    some = authors.where("listed").select("doi", "day", "key")
    met = mine.where("not frequent").join(flagged.where("not frequent").select("key", "active", "other"), "key").select("doi", "day", "active", "other")
    met = met.unionByName(some.join(others, "key").select("doi", "day", "active", "other")).where("active < day").select("doi", "other").distinct()
    single = met.groupBy("doi").agg(F.count("*").alias("n"))

    counted = authors.where("not listed").select("doi", "day", "key", "k")
    pair = lambda df: _author_pairs(df.where("k > 1"), ["doi", "day", "k"])
    asked = pair(counted)
    pairs = _author_pairs(others, ["other", "active"]).join(asked.select("key").distinct(), "key", "left_semi")
    two = _counts_before(asked.where("k = 2").select("doi", "day", "key"), pairs.select("active", "key")).select("doi", F.col("n").alias("twice"))
    shared = asked.where("k > 2").join(pairs, "key").where("active < day").groupBy("doi", "other").agg(F.count("*").alias("c"))
    more = shared.groupBy("doi").agg(F.sum((F.sqrt(1 + 8 * F.col("c")) - 1) / 2).cast("long").alias("twice"))
    both = met.join(counted.select("doi", "key"), "doi").join(others.select("other", "key"), ["other", "key"]).select("doi", "other").distinct().groupBy("doi").agg(F.count("*").alias("twice"))

    zero = F.lit(0).cast("long")
    parts = single.select("doi", "n").unionByName(per.where("not listed").select("doi", "n"))
    for off in (two, more, both):
        parts = parts.unionByName(off.select("doi", (zero - F.col("twice")).alias("n")))
    counts = parts.groupBy("doi").agg(F.sum("n").alias("n"))
    return articles.select("doi").join(counts, "doi", "left").select("doi", F.coalesce("n", zero).cast("long").alias("author_history_signal_count"))


def _author_pairs(df: DataFrame, by: list[str]) -> DataFrame:
    """Each pair of keys a < b of the rows that agree in `by`, as rows of a join; no row holds a list."""
    a, b = df.select(*by, F.col("key").alias("a")), df.select(*by, F.col("key").alias("b"))
    return a.join(b, by).where("a < b").select(*by, F.struct("a", "b").alias("key"))


def _counts_before(asked: DataFrame, events: DataFrame) -> DataFrame:
    """asked(doi, day, key) with n: events(active, key) of the key before the day, from running sums over each key's days."""
    days = events.groupBy("key", F.col("active").alias("day")).agg(F.count("*").alias("n"))
    days = days.unionByName(asked.select("key", "day").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("key", "day").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return asked.join(days.select("key", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n")), ["key", "day"])


def with_history(articles: DataFrame, notices: DataFrame) -> DataFrame:
    """Articles with both counts and their cutoffs, which are the publication dates."""
    old = ["author_history_signal_count", "journal_history_signal_count", "author_history_cutoff_date", "journal_history_cutoff_date"]
    base = articles.drop(*old)
    out = base.join(author_history(articles, notices), "doi").join(venue_history(articles, notices), "doi")
    return out.withColumn("author_history_cutoff_date", F.col("publication_date")).withColumn("journal_history_cutoff_date", F.col("publication_date"))
