"""Hand-written frames for the behaviour to keep and the defects not to
copy (SURVEY §7.4, FIXTURES §4)."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import order
from shoplens.functions.params import Period, date_range, ingest_window, trend_window
from shoplens.operators import (audit, categories, indicators, inspect, missed, people,
                                revenue)

D = dt.date
ISO = "{}T00:00:00Z".format


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def test_period_drops_malformed_and_keeps_all_iso_shapes(make_shop):
    shop = make_shop(orders=[
        order(1, posted="2025-08-09T00:00:00Z", total=100),
        order(2, posted="2025-08-09T00:00:00", total=200),
        order(3, posted="2025-08-09", total=400),
        order(4, posted="08/09/2025", total=800),      # US form: dropped, never raises
        order(5, posted=None, total=1600),
    ])
    r = one(revenue.revenue(shop, Period(D(2025, 8, 9), D(2025, 8, 9))))
    assert r["ro_count"] == 3 and r["total_sales"] == 7.0


def test_sunday_and_monday_are_different_weeks(make_shop):
    # 2025-08-10 is a Sunday, 2025-08-11 the next Monday
    shop = make_shop(
        orders=[order(1, posted=ISO("2025-08-10")), order(2, posted=ISO("2025-08-11"))],
        jobs=[dict(id=10, repair_order_id=1), dict(id=20, repair_order_id=2)],
        labor=[dict(id=1, job_id=10, hours=1.0, rate=10000, technician_id=7),
               dict(id=2, job_id=20, hours=1.0, rate=10000, technician_id=7)])
    rows = people.technician_trend(shop, trend_window(12, "2025-08-20")).collect()
    assert sorted(r.week_start for r in rows) == ["2025-08-04", "2025-08-11"]
    one_tech = people.technician_trend(shop, trend_window(12, "2025-08-20"), technician_id=7)
    assert one_tech.count() == 2
    assert people.technician_trend(shop, trend_window(12, "2025-08-20"), technician_id=8).count() == 0


def test_trend_window_is_weeks_times_seven_inclusive(make_shop):
    end = D(2025, 8, 20)
    days = (0, 84, 85)
    shop = make_shop(
        orders=[order(i, posted=ISO((end - dt.timedelta(days=d)).isoformat()))
                for i, d in enumerate(days)],
        jobs=[dict(id=10 + i, repair_order_id=i) for i in range(3)],
        labor=[dict(id=i, job_id=10 + i, hours=1.0, rate=100, technician_id=1) for i in range(3)])
    rows = people.technician_trend(shop, trend_window(12, end)).collect()
    assert sum(r.jobs for r in rows) == 2                     # 84 in, 85 out
    with pytest.raises(ValueError):
        trend_window(53, end)


def test_total_fallback_only_on_trend_rows(make_shop):
    shop = make_shop(orders=[
        order(1, posted=ISO("2025-01-05"), labor=1000, parts=500, total=0),      # rebuilt 1500
        order(2, posted=ISO("2025-02-05"), labor=100, discount=500, total=0),    # floor at 0
        order(3, posted=ISO("2025-03-05"), labor=100, total=700),
    ])
    p = Period(D(2025, 1, 1), D(2025, 3, 31))
    m = {r.month: r.total_sales for r in revenue.monthly_trends(shop, p).collect()}
    assert m == {"2025-01": 15.0, "2025-02": 0.0, "2025-03": 7.0}
    assert one(revenue.revenue(shop, p))["total_sales"] == 7.0              # no fallback in D1


def test_authorized_and_archived_predicates(make_shop):
    jobs = []
    k = 0
    for a in (None, 0, 1):
        for ar in (None, 0, 1):
            k += 1
            jobs.append(dict(id=k, repair_order_id=1, authorized=a, archived=ar, subtotal=100 * k,
                             job_category_name="Brakes"))
    shop = make_shop(orders=[order(1, posted=ISO("2025-01-05"))], jobs=jobs)
    p = Period(D(2025, 1, 1), D(2025, 1, 31))
    s = one(missed.missed_revenue_summary(shop, p))
    # declined: authorized 0 with archived NULL/0 -> ids 4, 5; sold: ids 7, 8
    assert (s["declined_count"], s["declined_value"]) == (2, 9.0)
    assert (s["authorized_count"], s["authorized_value"]) == (2, 15.0)
    c = one(categories.job_category_metrics(shop, p))
    assert c["job_count"] == 2 and c["net_revenue"] == 15.0


def test_verdict_uses_overall_difference_and_cent_threshold(make_shop):
    shop = make_shop(orders=[
        order(1, posted=ISO("2025-01-01"), labor=1000, total=1002),   # +2 cents
        order(2, posted=ISO("2025-01-02"), labor=1000, total=998),    # -2 cents
        order(3, posted=ISO("2025-01-03"), labor=1000, total=1001),   # 1 cent: not kept
        order(4, posted=ISO("2025-01-04"), labor=1000, total=1000),   # reconciled, last
    ])
    o = one(audit.audit_overall(shop))
    assert o["difference"] == 0.01 and o["reconciles"] is False
    assert o["discrepancy_count"] == 2
    d = sorted(r.difference_cents for r in audit.audit_discrepancies(shop).collect())
    assert d == [-2, 2]


def test_empty_period_guards(make_shop):
    shop = make_shop(orders=[order(1, posted=ISO("2025-01-01"), total=0)])
    empty = Period(D(2030, 1, 1), D(2030, 1, 31))
    r = one(revenue.revenue(shop, empty))
    assert r["ro_count"] == 0 and r["average_ro"] == 0.0 and r["labor_percent"] == 0.0
    c = one(revenue.period_comparison(shop, empty))
    assert c["total_sales_percent"] is None and c["total_sales_class"] == "none"
    z = one(revenue.revenue(shop, Period(D(2025, 1, 1), D(2025, 1, 1))))
    assert z["ro_count"] == 1 and z["discount_percent"] == 0.0
    assert one(inspect.discount_analysis(shop))["discount_rate"] is None


def test_top_declined_ties_break_by_job_id(make_shop):
    jobs = [dict(id=i, repair_order_id=1, authorized=0, archived=0, subtotal=500, name=f"j{i}")
            for i in (5, 3, 9, 1)]
    shop = make_shop(orders=[order(1, posted=ISO("2025-01-05"))], jobs=jobs,
                     employees=[dict(id=1, first_name="A", last_name=None)])
    rows = missed.top_declined_jobs(shop, Period(D(2025, 1, 1), D(2025, 1, 31)), job_limit=2)
    got = rows.collect()
    assert [r.job_id for r in got] == [1, 3]
    assert got[0].technician_name == "Unassigned" and got[0].advisor_name == "Unknown"


def test_parts_and_labor_do_not_fan_out(make_shop):
    shop = make_shop(
        orders=[order(1, posted=ISO("2025-01-05"))],
        jobs=[dict(id=1, repair_order_id=1, authorized=1, archived=None, labor_total=1000,
                   parts_total=3000, subtotal=4000, job_category_name=" Brakes ")],
        labor=[dict(id=1, job_id=1, hours=1.5, rate=100), dict(id=2, job_id=1, hours=0.5, rate=100)],
        parts=[dict(id=i, job_id=1, quantity=2.0, cost=300) for i in range(3)])
    c = one(categories.job_category_metrics(shop, Period(D(2025, 1, 1), D(2025, 1, 31))))
    assert c["category"] == "Brakes"
    assert (c["labor_revenue"], c["parts_revenue"], c["net_revenue"]) == (10.0, 30.0, 40.0)
    assert (c["parts_cost"], c["parts_row_count"], c["labor_hours"]) == (18.0, 3, 2.0)
    assert c["parts_margin_dollars"] == 12.0 and c["parts_margin_percent"] == 40.0
    assert c["percent_of_shop_revenue"] == 100.0


def test_margin_unknown_without_part_rows(make_shop):
    shop = make_shop(
        orders=[order(1, posted=ISO("2025-01-05"))],
        jobs=[dict(id=1, repair_order_id=1, authorized=1, parts_total=3000, subtotal=3000,
                   job_category_name=None)])
    c = one(categories.job_category_metrics(shop, Period(D(2025, 1, 1), D(2025, 1, 31))))
    assert c["category"] == "Uncategorized"
    assert c["has_parts_cost_data"] is False and c["parts_margin_dollars"] is None
    cls = one(indicators.job_category_classes(shop, Period(D(2025, 1, 1), D(2025, 1, 31))))
    assert cls["margin_class"] == "muted"


@pytest.mark.parametrize("weeks_with_hours,expected", [
    (1, None), (2, "up"), (3, "up"),
])
def test_trend_direction_halves(make_shop, weeks_with_hours, expected):
    # Mondays; rates 100, 200, 300 $/h; one extra week with zero hours
    mondays = ["2025-07-07", "2025-07-14", "2025-07-21"][:weeks_with_hours]
    orders = [order(i, posted=ISO(d)) for i, d in enumerate(mondays)] + [
        order(99, posted=ISO("2025-07-28"))]
    jobs = [dict(id=10 + i, repair_order_id=i) for i in range(len(mondays))] + [
        dict(id=99, repair_order_id=99)]
    labor = [dict(id=i, job_id=10 + i, hours=1.0, rate=10000 * (i + 1), technician_id=1)
             for i in range(len(mondays))] + [dict(id=99, job_id=99, hours=0.0, rate=1,
                                                    technician_id=1)]
    shop = make_shop(orders=orders, jobs=jobs, labor=labor)
    t = people.technician_trend(shop, trend_window(12, "2025-08-01"))
    r = one(people.technician_trend_direction(t))
    assert r["rate_weeks"] == weeks_with_hours
    assert r["trend_direction"] == expected
    if weeks_with_hours == 3:          # prior = week 1, recent = weeks 2-3
        assert r["prior_average_rate"] == 100.0 and r["recent_average_rate"] == 250.0


def test_ingest_window_leap_day():
    w = ingest_window("2024-02-29")
    assert (w.start, w.end) == (D(2023, 2, 28), D(2024, 2, 29))


def test_date_range_rules():
    assert date_range(end="2025-08-09") == Period(D(2025, 8, 9), D(2025, 8, 9))
    assert date_range(days=7, as_of="2025-08-09").start == D(2025, 8, 3)
    assert date_range(start="2025-01-01", days=7, as_of="2025-08-09").start == D(2025, 1, 1)
    with pytest.raises(ValueError):
        revenue.revenue(None, Period(D(2025, 1, 1), D(2025, 1, 1)), basis="bogus")


def test_alert_branches(make_shop):
    # shop rate 130 $/h -> good; discount 12 % of labor + parts -> warn
    shop = make_shop(
        employees=[dict(id=1, first_name="T", last_name="One", role_name="Technician")],
        orders=[order(1, posted=ISO("2025-01-05"), labor=13000, parts=12000, discount=3000)],
        jobs=[dict(id=1, repair_order_id=1, technician_id=1)],
        labor=[dict(id=1, job_id=1, hours=1.0, rate=13000, technician_id=1)])
    p = Period(D(2025, 1, 1), D(2025, 1, 31))
    a = {r.alert: (r.value, r["class"]) for r in indicators.alerts(shop, p).collect()}
    assert a["labor_rate"] == (130.0, "good")
    assert a["discounting"] == (12.0, "warn")
    assert a["technician_review"] == (0.0, "good")
    sc = one(indicators.technician_scorecard(shop, p))
    assert sc["status_class"] == "good" and sc["shop_labor_share_percent"] == 100.0


def test_advisors_without_orders_are_kept(make_shop):
    shop = make_shop(
        employees=[dict(id=1, first_name="A", last_name="B", role_name="SERVICE ADVISOR"),
                   dict(id=2, first_name="C", last_name=None, role_name="service advisor"),
                   dict(id=3, first_name="D", last_name="E", role_name=None)],
        orders=[order(1, posted=ISO("2025-01-05"), total=500, writer=1),
                order(2, posted=ISO("2024-01-05"), total=500, writer=2)])
    rows = {r.advisor_id: r for r in
            people.advisor_metrics(shop, Period(D(2025, 1, 1), D(2025, 1, 31))).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].ro_count == 1 and rows[2].ro_count == 0 and rows[2].average_ro == 0.0
    assert rows[2].advisor_name == "C"


def test_orphans_count_null_parents(make_shop):
    shop = make_shop(
        orders=[order(1)],
        jobs=[dict(id=1, repair_order_id=1), dict(id=2, repair_order_id=2),
              dict(id=3, repair_order_id=None)],
        labor=[dict(id=1, job_id=1), dict(id=2, job_id=9)],
        parts=[dict(id=1, job_id=None)])
    assert one(inspect.orphan_counts(shop)) == dict(
        orphan_jobs=2, orphan_labor_lines=1, orphan_parts=1)
