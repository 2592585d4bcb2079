"""Scalar functions on columns; each is a pure Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: a Column that is named twice is two copies, and copies of copies multiply."""
    return F.get(F.transform(F.array(c), f), 0)


def nonblank(c: Column) -> Column:
    """The text, or null where it is blank."""
    return first_nonblank(c)


def first_nonblank(*cols: Column) -> Column:
    """The first text that is not blank; each column is named once."""
    return F.get(F.filter(F.array(*[c.cast("string") for c in cols]), lambda x: F.trim(x) != ""), 0)


def strip(c: Column) -> Column:
    """Text without white space at its ends, line ends and no-break spaces included."""
    return F.btrim(c, F.lit(" \t\n\r\v\f\u00a0"))


def normalize_doi(c: Column) -> Column:
    """Lower-cased identifier without resolver address or scheme; '' for null."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(strip(F.regexp_replace(bare, r"(?i)^doi:\s*", "")))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("record")).otherwise(s)


def tokenize(c: Column) -> Column:
    """Lower-cased ASCII alphanumeric words of three characters or more, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))


def coerce_date(c: Column) -> Column:
    """struct(date, precision) of a full date, a year and month, or a year; null where none parses."""
    made = lambda d, p: F.get(F.filter(F.array(F.struct(d.alias("date"), F.lit(p).alias("precision"))), lambda x: x["date"].isNotNull()), 0)

    def parsed(s: Column) -> Column:
        day = lambda tail: F.try_to_date(F.concat(s, F.lit(tail)), "y-M-d")
        return (
            F.when(s.rlike(r"^\d{4}$"), made(day("-01-01"), "year_imputed"))
            .when(s.rlike(r"^\d{4}-\d{2}$"), made(day("-01"), "month_imputed"))
            .when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), made(day(""), "day"))
        )

    return bound(F.trim(c.cast("string")), parsed)


def coerce_bool(c: Column, default: bool) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    number = s.try_cast("double")
    return (
        F.when(s.isin(*TRUE_WORDS), F.lit(True))
        .when(s.isin(*FALSE_WORDS), F.lit(False))
        .when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number != 0)
        .otherwise(F.lit(default))
    )


def coerce_list(c: Column) -> Column:
    """Trimmed non-blank parts of a text split on '|', or on ';' where it has no '|'."""
    s = F.trim(F.coalesce(c, F.lit("")))
    parts = F.when(F.contains(s, F.lit("|")), F.split(s, r"\|")).otherwise(F.split(s, ";"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def restore_abstract(c: Column) -> Column:
    """The text of a map from words to their positions; of words at one position the last in the map's order stays."""

    def joined(m: Column) -> Column:
        # sort_array compares as compiled, array_sort by a lambda for each pair; what is repeated and zipped needs no lambda a position
        lists = F.map_values(m)
        order = F.flatten(F.transform(lists, lambda ps, i: F.array_repeat(-i, F.size(ps))))
        words = F.flatten(F.transform(F.map_entries(m), lambda e: F.array_repeat(e["key"], F.size(e["value"]))))
        placed = F.sort_array(F.arrays_zip(F.flatten(lists).alias("p"), order.alias("i"), words.alias("w")))
        first = bound(placed, lambda o: F.filter(o, lambda x, i: x["p"].isNotNull() & ~F.get(o, i - 1)["p"].eqNullSafe(x["p"])))
        return F.array_join(first["w"], " ")

    return F.coalesce(bound(c, joined), F.lit(""))


def invert_words(words: Column) -> Column:
    """A map from the words of an array to their positions, from 0 on; null words are left out, and null gives null."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def entries(o: Column) -> Column:
        heads = F.filter(F.transform(o, lambda x, i: i), lambda i: ~F.get(o, i - 1)["w"].eqNullSafe(F.get(o, i)["w"]))
        return bound(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(o, i)["w"], F.slice(o, i + 1, F.coalesce(F.get(h, k + 1), F.size(o)) - i)["p"])))

    return F.map_from_entries(bound(placed, entries))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def internal_id(doi: Column, prefix: str = "rec-") -> Column:
    return F.concat(F.lit(prefix), slugify(doi))


def author_cluster(authors: Column, institutions: Column) -> Column:
    head = F.concat(F.get(authors, 0), F.lit("-"), F.coalesce(F.get(institutions, 0), F.lit("unknown")))
    return F.when(F.size(authors) > 0, slugify(head)).otherwise(F.lit("unknown-cluster"))


def notice_status(tags: Column) -> Column:
    return (
        F.when(F.array_contains(tags, "retraction"), F.lit("retracted"))
        .when(F.arrays_overlap(tags, F.array(F.lit("expression_of_concern"), F.lit("major_correction"))), F.lit("editorial_notice"))
        .otherwise(F.lit("none_known_at_snapshot"))
    )


def within_months(published: Column, event: Column, months: int) -> Column:
    return F.coalesce(event.between(published, F.add_months(published, months)), F.lit(False))


def safe_href(c: Column) -> Column:
    """An http or https address with a host as it is, anything else '#'."""
    good = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(c, F.lit("HOST")).isNotNull()
    return F.when(F.coalesce(good, F.lit(False)), c).otherwise(F.lit("#"))


def title_status(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def freeze_end(label: Column) -> Column:
    """The last day of the month that a 'YYYY-MM-freeze' label names."""
    return F.last_day(F.try_to_date(F.concat(F.regexp_extract(label, r"^(\d{4}-\d{2})-freeze$", 1), F.lit("-01")), "yyyy-MM-dd"))


def flat(c: Column, kind: str) -> Column:
    """A cell of the flat export: arrays joined by ';', booleans as True or False, null as ''."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(c, ";"), F.lit(""))
    if kind == "boolean":
        return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))
