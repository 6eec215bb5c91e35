"""Plan properties of every registered query (broadcast disabled, i.e. the
shape a large cluster gets): the scale rules stay true as code changes."""

from __future__ import annotations

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct",
             "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def plans(spark):
    from shoplens.plans import registry

    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                               "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        yield {k: fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
               for k, fn in registry.queries().items()}
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_no_python_udf_cartesian_or_nested_loop(plans):
    for k, plan in plans.items():
        for bad in FORBIDDEN:
            assert bad not in plan, (k, bad)


@pytest.mark.parametrize("key,column", [("revenue", "posted_day"), ("daily_trends", "posted_day"),
                                        ("trend_total_fallback", "created_day"),
                                        ("dashboard_trend", "completed_day"),
                                        ("posted_last_30_days", "posted_day")])
def test_period_filter_reaches_the_scan(plans, key, column):
    assert re.search(rf"PushedFilters: \[[^\]]*GreaterThanOrEqual\({column}", plans[key]), key


def test_reports_read_only_needed_order_columns(plans):
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plans["revenue"])
    assert scan and len(scan.group(1).split(",")) <= 9


def _tree(plan: str) -> list[tuple[int, str]]:
    """(depth, node) per line of a plan."""
    out = []
    for line in plan.splitlines():
        m = re.match(r"([\s:|]*)(?:\+- |:- )?(?:\*\(\d+\) )?(\w.*)", line)
        if m:
            out.append((len(line) - len(line.lstrip(" :+-|")), m.group(2)))
    return out


def test_no_window_over_one_partition(plans):
    """What comes together in one task is a partial aggregate or a sorted report, never a window."""
    for k, plan in plans.items():
        nodes = _tree(plan)
        for (d, n), (_, below) in zip(nodes, nodes[1:]):
            if n.startswith("Window") and "SinglePartition" in plan[plan.index(n):plan.index(n) + 600]:
                assert "SinglePartition" not in below, (k, below)


@pytest.mark.parametrize("key", ["revenue", "technician_metrics", "technician_trend", "job_category_metrics",
                                 "missed_revenue_summary", "top_declined_jobs", "shop_rate", "advisor_metrics"])
def test_fact_scans_prune_months_and_days(plans, key):
    """Every scan of a large table in a report on the default basis prunes partitions and pushes the day predicate."""
    scans = re.findall(r"FileScan parquet [^\n]*", plans[key])
    facts = [x for x in scans if re.search(r"/(repair_orders|jobs|labor_lines|parts)[\],]", x)]
    assert facts
    for x in facts:
        assert re.search(r"PartitionFilters: \[[^\]]*posted_(month|year)", x), (key, x[:400])
        assert "posted_day" in x[x.index("PushedFilters"):], (key, x[:400])


def test_month_partitions_where_months_are_large(spark, tmp_dir):
    """The unit follows the orders of a month; reports prune and agree on both."""
    import datetime as dt

    from shoplens.functions.params import Period
    from shoplens.operators import revenue
    from shoplens.sources.silver import Shop, load_shop

    shop = load_shop(spark, SF)
    shop.write(f"{tmp_dir}/m", month_rows=1)
    months = Shop.read(spark, f"{tmp_dir}/m")
    assert "posted_month" in months.jobs.columns and "posted_year" in shop.jobs.columns
    p = Period(dt.date(1996, 3, 10), dt.date(1997, 2, 3))
    report = revenue.revenue(months, p)
    assert re.search(r"PartitionFilters: \[[^\]]*posted_month#\d+ >= 199603",
                     report._jdf.queryExecution().executedPlan().toString())
    assert report.collect() == revenue.revenue(shop, p).collect()


def test_counts_come_from_file_footers(spark):
    from shoplens.plans import registry

    plan = registry.queries()["record_counts"](spark, SF)._jdf.queryExecution().toString()
    pushed = re.findall(r"PushedAggregation: \[([^\]]*)\]", plan)
    assert pushed and all(p == "COUNT(*)" for p in pushed), plan[:2000]
