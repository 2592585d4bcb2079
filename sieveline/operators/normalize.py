"""Raw bibliographic, notice and index rows to typed rows, quarantine or skip: one pass of expressions.

Nested JSON is first read with its nested parts as text, whose first character tells their shape, and then parsed by
that shape; a field of the wrong shape is thus told from one that is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ALLOWED_NOTICE_TYPES
from .records import early_skip_reason

# Work types, and the terms of the life-science score and of subfields.
WORK_TYPES = {"article": "article", "journal_article": "article", "journal-article": "article", "review": "review", "review_article": "review", "review-article": "review"}
SCORED_TERMS = "biology medicine biochemistry genetics bioinformatics ecology botany zoology microbiology neuroscience immunology pharmacology epidemiology".split()
PRIMARY_TERMS = "medicine medical clinical biochemistry genetics bioinformatics ecology botany zoology microbiology neuroscience immunology pharmacology epidemiology".split()
SUBFIELD_NAMES = (("bioinformatics", "bioinformatic|computational|genomic"), ("biomedicine", "medicine|clinical|oncology|biomedical|pathology"), ("biology", "biology|ecology|botany|zoology|microbiology"))
SUBFIELD_TEXT = (("bioinformatics", "bioinformatic|genome|transcript|metagenom|variant|pipeline"), ("biomedicine", "clinical|cohort|hospital|biomarker|patient|glioma|sepsis|fibrosis"))
SUBFIELD_MESH = (("bioinformatics", "genomics|sequence analysis|bioinformatics|computational biology|transcriptome|proteome"), ("biomedicine", "clinical|patients|humans|disease|biomarkers|neoplasms|therapy"))
NOTICE_DOIS = "doi DOI target_doi article_doi original_doi original_paper_doi paper_doi record_doi object_doi".split()
NOTICE_LABELS = "notice_type tag notice_label update_type retraction_nature".split()
NOTICE_DATES = "notice_date date updated update_date".split()
NOTICE_DATE_PARTS = "issued published published-print published-online deposited created indexed posted".split()
NOTICE_UPDATES = ("update-to", "update_to", "updates", "crossmark_updates")
EXCERPT = 500

_NAME = "struct<display_name: string>"
_TOPIC = f"display_name: string, score: string, subfield: {_NAME}, field: {_NAME}"
_SOURCE = "struct<display_name: string, host_organization_name: string>"
WORK = (
    f"doi string, ids struct<doi: string, pmid_doi: string>, type string, type_crossref string, publication_date string, from_publication_date string, "
    f"publication_year string, authorships string, title string, display_name string, primary_location struct<landing_page_url: string, source_display_name: string, source: {_SOURCE}>, "
    f"locations array<struct<source: {_SOURCE}>>, host_venue {_NAME}, venue string, publisher string, abstract string, abstract_inverted_index map<string, array<int>>, "
    f"referenced_works_count string, references_count string, cited_by_count string, openalex_life_science_score string, concepts array<struct<display_name: string, score: string>>, "
    f"primary_topic struct<{_TOPIC}>, topics array<struct<{_TOPIC}>>, subfield string, oa_status string, open_access struct<oa_status: string, is_oa: boolean>, is_oa boolean"
)
AUTHORSHIPS = (
    f"array<struct<author: {_NAME}, author_name: string, raw_author_name: string, institutions: array<struct<display_name: string, name: string>>, raw_affiliation_strings: array<string>>>"
)


def _is_object(line: Column) -> Column:
    return F.coalesce(F.trim(line).startswith("{") & F.json_object_keys(line).isNotNull(), F.lit(False))


def _matches(names: Column, terms: list[str]) -> Column:
    pattern = "|".join(terms)
    return F.exists(names, lambda n: F.coalesce(F.lower(n), F.lit("")).rlike(pattern))


def life_science_score(w: Column) -> Column:
    """The explicit score, or the greatest of the matching concepts' and topics' scores, 0.9 where only a specific topic speaks."""
    zero = F.array(F.lit(0.0))
    number = lambda x: x.try_cast("double")
    concepts = F.transform(F.filter(w["concepts"], lambda c: _matches(F.array(c["display_name"]), SCORED_TERMS)), lambda c: F.coalesce(number(c["score"]), F.lit(0.0)))
    names = lambda t: F.array(t["display_name"], t["subfield"]["display_name"], t["field"]["display_name"])
    topics = F.transform(
        F.filter(w["topics"], lambda t: _matches(names(t), SCORED_TERMS)),
        lambda t: F.when(t["score"].isNull(), F.when(_matches(names(t), PRIMARY_TERMS), F.lit(0.9)).otherwise(F.lit(0.0))).otherwise(number(t["score"])),
    )
    primary = w["primary_topic"]
    specific = F.when(_matches(F.array(primary["subfield"]["display_name"], primary["field"]["display_name"]), PRIMARY_TERMS), F.lit(0.9)).otherwise(F.lit(0.0))
    best = F.greatest(F.array_max(F.concat(zero, F.coalesce(concepts, zero))), F.array_max(F.concat(zero, F.coalesce(topics, zero))), specific)
    return F.round(F.when(w["openalex_life_science_score"].isNotNull(), number(w["openalex_life_science_score"])).otherwise(best), 4)


def _first_rule(text: Column, rules, default: Column | None = None) -> Column:
    out = F
    for value, pattern in rules:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(default) if default is not None else out.otherwise(F.lit(None).cast("string"))


def normalize_works(lines: DataFrame, early_scope: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """(kind, row, error_code, error_message, raw_excerpt, reason) for lines(line, file_id, line_number, snapshot_id).

    Checks go in a fixed order: bad_json, missing_doi, unsupported_work_type, bad_date, bad_authorship_shape,
    bad_numeric, then the early scope. With early scope, rows without identifier or of another type are skipped, not
    quarantined. A line that is JSON but no object is bad_json.
    """
    df = lines.withColumn("w", F.from_json("line", WORK, {"mode": "PERMISSIVE"}))
    w = F.col("w")
    df = df.withColumns(
        {
            "ok": _is_object(F.col("line")),
            "doi": S.normalize_doi(S.first_nonblank(w["doi"], w["ids"]["doi"], w["ids"]["pmid_doi"])),
            "raw_type": F.replace(F.lower(F.trim(S.first_nonblank(w["type"], w["type_crossref"], F.lit("article")))), F.lit(" "), F.lit("_")),
            "day": S.coerce_date(S.first_nonblank(w["publication_date"], w["from_publication_date"], w["publication_year"])),
            "shape": F.substring(F.trim(w["authorships"]), 1, 1),
            "a": F.from_json(w["authorships"], AUTHORSHIPS),
            "title": S.first_nonblank(w["title"], w["display_name"], w["primary_location"]["landing_page_url"], F.lit("Untitled work")),
            "abstract": F.coalesce(S.first_nonblank(w["abstract"], S.restore_abstract(w["abstract_inverted_index"])), F.lit("")),
            "raw_refs": S.first_nonblank(w["referenced_works_count"], w["references_count"], w["cited_by_count"], F.lit("0")),
            "score": life_science_score(w),
        }
    )
    df = df.withColumns(
        {
            "work_type": F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in WORK_TYPES.items() for x in kv]), lambda k, v: k == F.col("raw_type"))), 0), F.col("raw_type")),
            "authors": F.filter(F.transform(F.coalesce("a", F.array().cast(AUTHORSHIPS)), lambda x: S.first_nonblank(x["author"]["display_name"], x["author_name"], x["raw_author_name"])), lambda x: x.isNotNull()),
            "institutions": F.array_sort(
                F.array_distinct(
                    F.filter(
                        F.flatten(
                            F.transform(
                                F.coalesce("a", F.array().cast(AUTHORSHIPS)),
                                lambda x: F.concat(
                                    F.coalesce(F.transform(x["institutions"], lambda i: S.first_nonblank(i["display_name"], i["name"])), F.array().cast("array<string>")),
                                    F.coalesce(x["raw_affiliation_strings"], F.array().cast("array<string>")),
                                ),
                            )
                        ),
                        lambda x: x.isNotNull() & (x != ""),
                    )
                )
            ),
            "refs": F.when(F.col("raw_refs").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("raw_refs").try_cast("long")),
            "publication_date": F.col("day.date"),
            "openalex_life_science_score": F.col("score"),
        }
    )
    listed = F.coalesce(F.col("shape") == "[", F.lit(False))
    empty = F.coalesce(w["authorships"].isNull() | F.regexp_replace(w["authorships"], r"\s", "").isin("[]", "null"), F.lit(True))
    bad_shape = ~empty & (~listed | ((F.size("authors") == 0) & (F.size("institutions") == 0)))
    bad_number = F.col("refs").isNull() | F.col("score").isNull()
    error = (
        F.when(~F.col("ok"), F.lit("bad_json"))
        .when(F.col("doi") == "", F.lit("missing_doi"))
        .when(~F.col("work_type").isin("article", "review"), F.lit("unsupported_work_type"))
        .when(F.col("day").isNull(), F.lit("bad_date"))
        .when(bad_shape, F.lit("bad_authorship_shape"))
        .when(bad_number, F.lit("bad_numeric"))
    )
    df = df.withColumn("error_code", error)
    reason = F.lit("")
    if early_scope:
        if allowed is not None:
            df = df.join(allowed.select("doi", F.lit(True).alias("is_allowed")).distinct(), "doi", "left")
        skip = early_skip_reason(F.col("doi") != "", allowed=F.col("is_allowed") if allowed is not None else None)
        early = F.when(F.col("error_code").isin("missing_doi", "unsupported_work_type"), F.col("error_code"))
        reason = F.coalesce(early, F.when(F.col("error_code").isNull(), skip), F.lit(""))
    df = df.withColumn("reason", reason)
    df = df.withColumn("kind", F.when(F.col("reason") != "", "scope_skip").when(F.col("error_code").isNotNull(), "quarantine").otherwise("normalized"))
    source_names = F.transform(F.coalesce(w["locations"], F.array().cast(f"array<struct<source: {_SOURCE}>>")), lambda x: S.nonblank(x["source"]["display_name"]))
    publishers = F.transform(F.coalesce(w["locations"], F.array().cast(f"array<struct<source: {_SOURCE}>>")), lambda x: S.first_nonblank(x["source"]["host_organization_name"], x["source"]["display_name"]))
    main = w["primary_location"]["source"]
    explicit = F.lower(S.first_nonblank(w["subfield"], w["primary_topic"]["subfield"]["display_name"]))
    labels = lambda c: F.array_join(F.transform(w[c], lambda x: F.coalesce(x["display_name"], F.lit(""))), " ")
    text = F.lower(F.concat_ws(" ", "title", "abstract", labels("concepts"), labels("topics")))
    none = F.array().cast("array<string>")
    row = F.struct(
        "doi",
        "title",
        "abstract",
        S.first_nonblank(w["host_venue"]["display_name"], main["display_name"], w["primary_location"]["source_display_name"], w["venue"], F.get(F.array_compact(source_names), 0), F.lit("Unknown Venue")).alias("venue"),
        S.first_nonblank(w["publisher"], main["host_organization_name"], main["display_name"], F.get(F.array_compact(publishers), 0), F.lit("Unknown Publisher")).alias("publisher"),
        "publication_date",
        F.col("day.precision").alias("publication_date_precision"),
        "work_type",
        F.coalesce(_first_rule(explicit, SUBFIELD_NAMES), _first_rule(text, SUBFIELD_TEXT, F.lit("biology"))).alias("subfield"),
        F.lit(False).alias("is_pubmed_indexed"),
        "openalex_life_science_score",
        "authors",
        "institutions",
        F.col("refs").alias("references_count"),
        F.lower(F.coalesce(S.nonblank(w["oa_status"]), S.nonblank(w["open_access"]["oa_status"]), F.when(F.coalesce(w["is_oa"], F.lit(False)) | F.coalesce(w["open_access"]["is_oa"], F.lit(False)), "open").when(~w["is_oa"] | ~w["open_access"]["is_oa"], "closed").otherwise("unknown"))).alias("oa_status"),
        F.lit("").alias("pmid"),
        none.alias("mesh_terms"),
        none.alias("keywords"),
        none.alias("pubmed_publication_types"),
        F.lit("").alias("pubmed_journal_title"),
        F.col("file_id").alias("source_file_id"),
        F.col("line_number").alias("source_line_number"),
        F.array(F.struct(F.lit("openalex_bulk").alias("collector_name"), F.col("file_id").alias("source_file_id"), F.col("line_number").alias("source_line_number"))).alias("source_lineage"),
        F.col("snapshot_id").alias("ingest_snapshot_id"),
        F.when(F.col("day.precision") == "year_imputed", "noisy_date").otherwise("primary").alias("task_a_date_bucket"),
    )
    return _outcome(df, row)


def _outcome(df: DataFrame, row: Column) -> DataFrame:
    messages = {
        "bad_json": "line is not a JSON object",
        "missing_doi": "row has no identifier",
        "unsupported_work_type": "work type is not supported",
        "bad_date": "no usable date",
        "bad_authorship_shape": "authorships have an unexpected shape",
        "bad_numeric": "a count or score is not a number",
        "unknown_notice_type": "no supported notice type",
        "bad_xml": "XML does not parse",
    }
    message = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in messages.items() for x in kv]), lambda k, v: k == F.col("error_code"))), 0)
    bad = F.col("kind") == "quarantine"
    outcome = F.struct(
        F.col("file_id").alias("file_id"),
        F.col("line_number").alias("line_number"),
        F.col("kind").alias("kind"),
        F.when(F.col("kind") == "normalized", row).alias("row"),
        F.when(bad, F.col("error_code")).alias("error_code"),
        F.when(bad, message).alias("error_message"),
        F.when(bad, F.substring("line", 1, EXCERPT)).alias("raw_excerpt"),
        F.col("reason").alias("reason"),
    )
    # a row made by explode: a caller's filter on its kind stays above it, where one on columns is pushed down to the line and parses it again for each use
    return df.select(F.explode(F.array(outcome)).alias("o")).select("o.*")


def notice_type(label: Column) -> Column:
    s = F.replace(F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.when(s.isin("correction", "corrigendum", "erratum"), "major_correction").when(s.isin("partial_retraction", "withdrawal", "removal"), "retraction").otherwise(s)


def relation_type(key: Column, fallback: Column) -> Column:
    s = F.replace(F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return (
        F.when(s.contains("retraction"), F.lit("retraction"))
        .when(s.contains("concern"), F.lit("expression_of_concern"))
        .when(s.contains("update") & fallback.isin(*ALLOWED_NOTICE_TYPES), fallback)
        .when(s.rlike("correction|corrected|corrigendum|erratum|update"), F.lit("major_correction"))
    )


_MAP = "map<string, string>"


def _field(m: Column, *names: str) -> Column:
    return S.first_nonblank(*[F.try_element_at(m, F.lit(n)) for n in names])


def date_parts(text: Column) -> Column:
    """A padded date text from an object with date parts, of three, two or one; other values as they are."""

    def padded(numbers: Column) -> Column:
        year, rest = F.lpad(F.get(numbers, 0), 4, "0"), F.transform(F.slice(numbers, 2, 2), lambda x: F.lpad(x, 2, "0"))
        return F.when(F.size(numbers) > 0, F.array_join(F.concat(F.array(year), rest), "-"))

    numbers = lambda parts: F.filter(F.when(F.get(parts, 0).startswith("["), F.from_json(F.get(parts, 0), "array<string>")).otherwise(parts), lambda x: x.isNotNull())
    named = lambda t: F.from_json(t, "struct<`date-parts`: array<string>, date_parts: array<string>>")
    parts = lambda t: S.bound(named(t), lambda p: F.coalesce(p["date-parts"], p["date_parts"]))
    return S.bound(text, lambda t: F.when(F.trim(t).startswith("{"), S.bound(S.bound(parts(t), numbers), padded)).otherwise(t))


def notice_date(*maps: Column) -> Column:
    """The date of the first map whose first non-blank date field parses."""
    return F.coalesce(*[S.coerce_date(S.first_nonblank(*[F.try_element_at(m, F.lit(n)) for n in NOTICE_DATES], *[date_parts(F.try_element_at(m, F.lit(n))) for n in NOTICE_DATE_PARTS])) for m in maps])


def notice_url(m: Column, fallback: Column) -> Column:
    nested = F.get_json_object(F.try_element_at(m, F.lit("resource")), "$.primary.URL")
    address = S.bound(fallback, lambda f: F.when(f != "", F.concat(F.lit("https://doi.org/"), f)))
    return F.coalesce(_field(m, "source_url", "url", "URL"), S.nonblank(nested), address, F.lit(""))


def _items(text: Column) -> Column:
    """Objects of a text that is one object or a list, as maps."""
    listed = S.bound(text, lambda t: F.when(F.trim(t).startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t)))
    return F.transform(F.filter(listed, lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, _MAP))


def normalize_notices(lines: DataFrame) -> DataFrame:
    """One outcome row per notice, quarantined line or unparsed line of lines(line, file_id, line_number, snapshot_id).

    A line's notices are its explicit one, those of its relation entries, and those of its update entries, without
    repeats. A missing date of any part makes the whole line bad_date.
    """
    m = F.col("m")
    df = lines.withColumn("ok", _is_object(F.col("line"))).withColumn("m", F.coalesce(F.from_json("line", _MAP), F.create_map().cast(_MAP)))
    doi_any = S.normalize_doi(_field(m, *NOTICE_DOIS))
    label = _field(m, *NOTICE_LABELS)
    own = notice_type(label)
    source = F.coalesce(
        _field(m, "source_name", "source"),
        F.when(F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(k) for k in ("relation", "update-to", "update_to", "DOI", "URL")])), F.lit("Crossref/Crossmark Export")).otherwise(F.lit("Official Notice Export")),
    )
    df = df.withColumns(
        {
            "explicit_doi": doi_any,
            "explicit_type": own,
            "has_explicit": (doi_any != "") & label.isNotNull() & own.isin(*ALLOWED_NOTICE_TYPES),
            "d": notice_date(m),
            "source_name": source,
            "rights": F.coalesce(_field(m, "rights_status", "rights"), F.lit("metadata_only")),
            "relation": F.try_element_at(m, F.lit("relation")),
            "own_doi": S.normalize_doi(_field(m, "doi", "DOI")),
            "fallback_type": notice_type(_field(m, "type", "Type", "subtype")),
            "page_url": notice_url(m, S.normalize_doi(_field(m, "DOI", "doi"))),
        }
    )
    is_relation = F.coalesce(F.trim("relation").startswith("{"), F.lit(False))
    relation = F.from_json("relation", _MAP)
    made = "array<struct<doi: string, notice_type: string, d: struct<date: date, precision: string>, url: string>>"
    empty = F.array().cast(made)
    row = lambda doi, kind, d, url: F.struct(doi.alias("doi"), kind.alias("notice_type"), d.alias("d"), url.alias("url"))
    from_relation = F.flatten(
        F.transform(
            F.map_entries(relation),
            lambda e: F.transform(_items(e["value"]), lambda x: row(S.normalize_doi(_field(x, "id", "DOI", "doi", "identifier")), relation_type(e["key"], F.col("fallback_type")), F.col("d"), F.col("page_url"))),
        )
    )
    updates = F.flatten(F.array(*[F.when(F.trim(F.try_element_at(m, F.lit(k))).startswith("["), _items(F.try_element_at(m, F.lit(k)))).otherwise(F.array().cast(f"array<{_MAP}>")) for k in NOTICE_UPDATES]))

    def update(x: Column) -> Column:
        url = S.bound(S.normalize_doi(_field(x, "DOI", "doi")), lambda target: F.coalesce(S.nonblank(notice_url(x, target)), notice_url(m, target)))
        return row(F.col("own_doi"), notice_type(_field(x, "label", "type", "update_type", "notice_type")), F.coalesce(notice_date(x), F.col("d")), url)

    from_update = F.when(F.col("own_doi") != "", F.filter(F.transform(updates, update), lambda x: x["notice_type"].isin(*ALLOWED_NOTICE_TYPES)))
    found = F.concat(
        F.when(F.col("has_explicit"), F.array(row(F.col("explicit_doi"), F.col("explicit_type"), F.col("d"), notice_url(m, F.lit(""))))).otherwise(empty),
        F.when(is_relation, F.filter(from_relation, lambda x: (x["doi"] != "") & x["notice_type"].isNotNull())).otherwise(empty),
        F.coalesce(from_update, empty),
    )
    df = df.withColumn("found", F.array_distinct(found))
    undated = (F.col("has_explicit") | is_relation) & F.col("d").isNull() | F.exists("found", lambda x: x["d"].isNull())
    shaped = F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(k) for k in ("notice_type", "tag", "notice_label", "update-to", "update_to", "updates", "relation")]))
    typed = F.lower(F.coalesce(_field(m, "type", "Type"), F.lit(""))).isin("retraction", "correction", "expression_of_concern")
    df = df.withColumn(
        "error_code",
        F.when(~F.col("ok"), F.lit("bad_json")).when(undated, F.lit("bad_date")).when(F.size("found") > 0, F.lit(None).cast("string")).when(shaped | typed, F.lit("unknown_notice_type")).otherwise(F.lit("missing_doi")),
    )
    df = df.withColumn("kind", F.when(F.col("error_code").isNull(), "normalized").otherwise("quarantine")).withColumn("reason", F.lit(""))
    df = df.withColumn("n", F.explode_outer(F.when(F.col("kind") == "normalized", F.col("found"))))
    out = F.struct(
        F.col("n.doi").alias("doi"),
        F.col("n.notice_type").alias("notice_type"),
        F.col("n.d.date").alias("notice_date"),
        F.col("n.d.precision").alias("notice_date_precision"),
        "source_name",
        F.col("n.url").alias("source_url"),
        F.col("rights").alias("rights_status"),
        F.col("file_id").alias("source_file_id"),
        F.col("line_number").alias("source_line_number"),
        F.col("snapshot_id").alias("ingest_snapshot_id"),
    )
    return _outcome(df, out)


def normalize_index_rows(lines: DataFrame) -> DataFrame:
    """Index rows from JSON lines, as normalize_works."""
    m = F.col("m")
    df = lines.withColumn("ok", _is_object(F.col("line"))).withColumn("m", F.coalesce(F.from_json("line", _MAP), F.create_map().cast(_MAP)))
    nested = F.get_json_object(F.try_element_at(m, F.lit("article_ids")), "$.doi")

    def items(*names: str) -> Column:
        text = _field(m, *names)
        return F.filter(F.when(F.trim(text).startswith("["), F.transform(F.from_json(text, "array<string>"), lambda x: F.trim(x))).otherwise(S.coerce_list(text)), lambda x: x != "")

    df = df.withColumns({"doi": S.normalize_doi(S.first_nonblank(F.try_element_at(m, F.lit("doi")), nested)), "mesh_terms": items("mesh_terms", "mesh_headings"), "keywords": items("keywords"), "types": items("publication_types", "pub_types")})
    df = df.withColumn("error_code", F.when(~F.col("ok"), F.lit("bad_json")).when(F.col("doi") == "", F.lit("missing_doi")))
    df = df.withColumn("kind", F.when(F.col("error_code").isNull(), "normalized").otherwise("quarantine")).withColumn("reason", F.lit(""))
    return _outcome(
        df,
        F.struct(
            "doi",
            F.coalesce(_field(m, "pmid", "pubmed_id"), F.lit("")).alias("pmid"),
            S.coerce_bool(F.try_element_at(m, F.lit("is_pubmed_indexed")), True).alias("is_pubmed_indexed"),
            "mesh_terms",
            "keywords",
            F.col("types").alias("pubmed_publication_types"),
            F.coalesce(_field(m, "journal_title", "journal"), F.lit("")).alias("pubmed_journal_title"),
            index_subfield(F.col("mesh_terms"), F.col("keywords"), F.col("types")).alias("subfield_hint"),
            F.col("file_id").alias("source_file_id"),
            F.col("line_number").alias("source_line_number"),
            F.col("snapshot_id").alias("ingest_snapshot_id"),
        ),
    )


def index_subfield(*lists: Column) -> Column:
    return _first_rule(F.lower(F.array_join(F.concat(*lists), " ")), SUBFIELD_MESH, F.lit("biology"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(file_id, kind, code, n): what became of each file's lines, from one pass."""
    return outcomes.groupBy("file_id", "kind", F.coalesce("error_code", F.nullif(F.col("reason"), F.lit("")), F.lit("")).alias("code")).agg(F.count("*").alias("n"))


def scope_allowlist(*sources: DataFrame) -> DataFrame:
    """Distinct non-blank identifiers of all sources."""
    out = sources[0].select("doi")
    for s in sources[1:]:
        out = out.unionByName(s.select("doi"))
    return out.where("doi != ''").distinct()


def allowed_rows(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose identifier is on the list."""
    return rows.join(allowed.select("doi"), "doi", "left_semi")


def retraction_rows(csv: DataFrame, freeze_end: str) -> DataFrame:
    """Notice rows of a retraction database export as of the freeze's end, without repeats."""
    have = {c.lower(): c for c in csv.columns}
    col = lambda *names: S.first_nonblank(*[F.col(have[n]) for n in names if n in have]) if any(n in have for n in names) else F.lit(None).cast("string")
    raw = F.lower(F.trim(F.coalesce(col("originalpaperdoi"), F.lit(""))))
    doi = F.when(raw.isin("", "unavailable", "na", "n/a"), F.lit("")).otherwise(S.normalize_doi(raw))
    stamp = F.coalesce(col("retractiondate"), F.lit(""))
    day = F.coalesce(F.try_to_date(F.substring_index(stamp, " ", 1), "M/d/yyyy"), S.coerce_date(F.substring_index(stamp, " ", 1))["date"])
    url = F.get(F.filter(F.transform(F.split(F.coalesce(col("urls"), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    return (
        csv.select(doi.alias("doi"), notice_type(col("retractionnature")).alias("notice_type"), day.alias("notice_date"), F.coalesce(url, F.concat(F.lit("https://doi.org/"), doi)).alias("source_url"), F.lit("Retraction Watch").alias("source_name"))
        .where((F.col("doi") != "") & F.col("notice_type").isin(*ALLOWED_NOTICE_TYPES) & (F.col("notice_date") <= F.lit(freeze_end).cast("date")))
        .distinct()
    )
