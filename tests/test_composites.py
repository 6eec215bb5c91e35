"""K1/K2: composite members equal the standalone reports."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from shoplens.functions.params import date_range
from shoplens.operators import categories, indicators, missed, people, revenue
from shoplens.plans.composites import dashboard_report, dashboard_snapshot
from shoplens.sources.silver import load_shop

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
AS_OF = dt.date(2001, 8, 1)


def _rows(df):
    cols = sorted(df.columns)
    key = lambda t: tuple((v is None, str(v)) for v in t)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


@pytest.mark.parametrize("days", [30, 365])
def test_dashboard_members_match_standalone(spark, days):
    shop = load_shop(spark, SF)
    p = date_range(days=days, as_of=AS_OF)
    rep = dashboard_report(shop, days=days, basis="revenue", as_of=AS_OF)
    try:
        expected = {
            "revenue": revenue.revenue(shop, p),
            "trend": revenue.dashboard_trend(shop, p),
            "technicians": people.technician_metrics(shop, p),
            "advisors": people.advisor_metrics(shop, p),
            "job_categories": categories.job_category_metrics(shop, p),
            "missed_summary": missed.missed_revenue_summary(shop, p),
            "missed_by_category": missed.missed_revenue_by_category(shop, p),
            "top_declined_jobs": missed.top_declined_jobs(shop, p),
            "comparison": revenue.period_comparison(shop, p),
            "shop_rate": indicators.shop_rate(shop, p),
            "alerts": indicators.alerts(shop, p),
            "technician_scorecard": indicators.technician_scorecard(shop, p),
            "management_snapshot": indicators.management_snapshot(shop, p),
        }
        assert set(rep) == set(expected)
        for k, df in expected.items():
            assert _rows(rep[k]) == _rows(df), k
        trend_cols = rep["trend"].columns
        assert ("day" in trend_cols) == (days <= 90)
    finally:
        rep.unpersist()


def test_dashboard_rejects_bad_parameters(spark):
    shop = load_shop(spark, SF)
    with pytest.raises(ValueError):
        dashboard_report(shop, days=14)
    with pytest.raises(ValueError):
        dashboard_report(shop, days=30, basis="posted")


def test_snapshot_has_members(spark):
    shop = load_shop(spark, SF)
    p = date_range("2001-01-01", "2001-06-30", as_of=AS_OF)
    snap = dashboard_snapshot(shop, start="2001-01-01", end="2001-06-30", as_of=AS_OF)
    for k, df in {"revenue": revenue.revenue(shop, p), "monthly_trends": revenue.monthly_trends(shop, p),
                  "advisors": people.advisor_metrics(shop, p), "missed_summary": missed.missed_revenue_summary(shop, p),
                  "missed_by_category": missed.missed_revenue_by_category(shop, p)}.items():
        assert _rows(snap[k]) == _rows(df), k
    assert {"revenue", "monthly_trends", "technicians", "advisors", "job_categories",
            "missed_summary", "missed_by_category", "top_declined_jobs"} <= set(snap)
    assert snap["revenue"].first().start_date == "2001-01-01"


@pytest.mark.parametrize("days, basis", [(30, "revenue"), (365, "production")])
def test_orders_are_scanned_once(spark, days, basis):
    """All figures about orders come from one scan of them; only the names of
    the at most fifty declined jobs look their orders up."""
    shop = load_shop(spark, SF)
    scans = lambda df: len(__import__("re").findall(
        r"FileScan parquet [^\n]*/repair_orders[\],]", df._jdf.queryExecution().executedPlan().toString()))
    p = date_range(days=days, as_of=AS_OF)
    assert scans(revenue.order_cube(shop, p, basis)) == 1
    rep = dashboard_report(shop, days=days, basis=basis, as_of=AS_OF)
    try:
        assert {k: n for k, df in rep.items() if (n := scans(df))} == {"top_declined_jobs": 1}
    finally:
        rep.unpersist()


def test_report_of_a_period_without_orders(make_shop):
    shop = make_shop(employees=[dict(id=1, first_name="A", role_name="Service Advisor")])
    p = date_range("2020-01-01", "2020-01-31")
    snap = dashboard_snapshot(shop, start="2020-01-01", end="2020-01-31")
    assert _rows(snap["revenue"]) == _rows(revenue.revenue(shop, p))
    assert snap["monthly_trends"].count() == 0 and snap["advisors"].first().ro_count == 0
    assert _rows(snap["missed_summary"]) == _rows(missed.missed_revenue_summary(shop, p))
