"""The plan of a report's stages: each part of a report is found once."""

import pytest

from grainmill.operators import coverage
from grainmill.plans import queries_stores


@pytest.mark.parametrize("make", [coverage.by_stage, coverage.document])
def test_no_filter_repeats_what_a_report_is_asked(spark, make):
    """Spark put all of a report's expressions into a filter before the explode, each as often as others ask it: the plan had megabytes."""
    reports = spark.createDataFrame([(1, '{"projects": [{"findings": [{"rule_id": "a"}]}]}'), (2, None), (3, "[")], "report_id long, body string")
    df = make(reports)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 2 and plan.count("__is_") < 100 and len(plan) < 60_000
    assert df.count() == (18 if make is coverage.by_stage else 3)


def test_reports_are_dealt_to_all_tasks(spark):
    """One small file of orders is one task's input, its reports are many times as large."""
    assert queries_stores.reports(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
