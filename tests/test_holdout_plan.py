"""group_holdout builds its records once."""

from sieveline.plans import catalog

from oracle import SF


def test_the_steps_of_a_holdout_read_written_records(spark):
    plan = catalog.QUERIES["group_holdout"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan
    assert plan.count("LogicalRDD") > 1
