"""Notices are parsed a bounded number of times a line, whatever a caller filters."""

from pyspark.sql import functions as F

from sieveline.operators import normalize


def test_a_filter_on_the_outcome_parses_no_line_again(spark):
    lines = [
        '{"relation": {"is-retraction-of": [{"id": "10.1/A"}]}, "created": {"date-parts": [[2024, 1, 5]]}, "DOI": "10.9/X"}',
        '{"DOI": "10.1/b", "update-to": [{"label": "Retraction", "updated": {"date-parts": [2021, 2]}, "date": " "}], "date": "2020"}',
        '{"DOI": "10.1/c", "update-to": [{"label": "Erratum", "DOI": "10.1/D"}], "issued": {"date_parts": [[2019]]}}',
        '{"doi": "10.1/e", "tag": "retraction", "date": "soon"}',
        '{"doi": "10.1/f", ',
    ]
    df = spark.createDataFrame([(t, "f", i, "s") for i, t in enumerate(lines)], "line string, file_id string, line_number long, snapshot_id string")
    out = normalize.normalize_notices(df)
    good = out.where("kind = 'normalized'").select("line_number", "row.doi", "row.notice_type", F.col("row.notice_date").cast("string"), "row.notice_date_precision", "row.source_url")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json") < 100
    assert sorted(map(tuple, good.collect())) == [
        (0, "10.1/a", "retraction", "2024-01-05", "day", "https://doi.org/10.9/x"),
        (1, "10.1/b", "retraction", "2020-01-01", "year_imputed", ""),
        (2, "10.1/c", "major_correction", "2019-01-01", "year_imputed", "https://doi.org/10.1/d"),
    ]
    assert {r.line_number: r.error_code for r in out.where("kind != 'normalized'").collect()} == {3: "bad_date", 4: "bad_json"}
