"""Invariants across reports on the shared test tables."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shoplens.functions.params import Period, date_range
from shoplens.operators import categories, missed, revenue
from shoplens.plans.composites import dashboard_report
from shoplens.sources.silver import load_shop

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
HISTORY = Period(dt.date(1995, 1, 1), dt.date(2001, 8, 1))
RAW = ("labor_sales", "parts_sales", "sublet_sales", "fees", "taxes", "discounts", "ro_count")


@pytest.mark.parametrize("basis", ["revenue", "production", "activity"])
def test_daily_and_monthly_raw_sums_agree(spark, basis):
    shop = load_shop(spark, SF)
    d = revenue.daily_trends(shop, HISTORY, basis).agg(*[F.sum(c).alias(c) for c in RAW]).first()
    m = revenue.monthly_trends(shop, HISTORY, basis).agg(*[F.sum(c).alias(c) for c in RAW]).first()
    r = revenue.revenue(shop, HISTORY, basis).first()
    for c in RAW:
        assert d[c] == pytest.approx(m[c]) and m[c] == pytest.approx(r[c]), c


def test_sold_plus_declined_is_recommended(spark):
    shop = load_shop(spark, SF)
    s = missed.missed_revenue_summary(shop, HISTORY).first()
    assert s.authorized_value + s.declined_value == pytest.approx(s.recommended_value)
    by = missed.missed_revenue_by_category(shop, HISTORY).agg(
        F.sum("authorized_value").alias("a"), F.sum("declined_value").alias("d"),
        F.sum("authorized_count").alias("ac"), F.sum("declined_count").alias("dc")).first()
    assert by.a == pytest.approx(s.authorized_value) and by.d == pytest.approx(s.declined_value)
    # categories whose sold and declined values are both 0 are dropped from
    # the breakdown (HAVING), but their jobs still count in the summary
    zero = (missed._open_jobs(shop, HISTORY, "revenue")
            .filter(F.coalesce(F.col("subtotal"), F.lit(0)) == 0)
            .groupBy(categories.X.category_label().alias("category"))
            .agg(F.sum(F.when(F.col("authorized") == 1, 1).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("authorized") == 0, 1).otherwise(0)).alias("d"),
                 F.sum(F.coalesce(F.col("subtotal"), F.lit(0))).alias("v")))
    dropped = zero.join(missed.missed_revenue_by_category(shop, HISTORY).select("category"),
                        "category", "left_anti").agg(F.sum("a").alias("a"),
                                                     F.sum("d").alias("d")).first()
    assert (by.ac + (dropped.a or 0), by.dc + (dropped.d or 0)) == (
        s.authorized_count, s.declined_count)


def test_category_shares_sum_to_100(spark):
    shop = load_shop(spark, SF)
    tot = categories.job_category_metrics(shop, HISTORY).agg(
        F.sum("percent_of_shop_revenue").alias("p")).first().p
    assert tot == pytest.approx(100.0)


def test_report_sink_writes_every_member(spark, tmp_dir):
    shop = load_shop(spark, SF)
    rep = dashboard_report(shop, days=30, as_of=dt.date(2001, 8, 1))
    try:
        rep.write(os.path.join(tmp_dir, "report"))
    finally:
        rep.unpersist()
    back = spark.read.json(os.path.join(tmp_dir, "report", "revenue"))
    assert back.count() == 1
    assert sorted(os.listdir(os.path.join(tmp_dir, "report"))) == sorted(rep)


def test_period_comparison_previous_equals_revenue_of_previous_period(spark):
    shop = load_shop(spark, SF)
    p = date_range(days=365, as_of=dt.date(2001, 8, 1))
    c = revenue.period_comparison(shop, p).first()
    prev = revenue.revenue(shop, p.previous()).first()
    cur = revenue.revenue(shop, p).first()
    assert (c.previous_ro_count, c.previous_total_sales) == (prev.ro_count, prev.total_sales)
    assert (c.current_ro_count, c.current_total_sales) == (cur.ro_count, cur.total_sales)


def test_silver_layout_round_trip(spark, tmp_dir):
    from shoplens.sources.silver import TABLE_NAMES, Shop

    shop = load_shop(spark, SF)
    root = os.path.join(tmp_dir, "silver")
    shop.write(root)
    back = Shop.read(spark, root)
    for n in TABLE_NAMES:
        a, b = getattr(shop, n), getattr(back, n)
        assert sorted(a.columns) == sorted(b.columns), n
        assert a.exceptAll(b.select(*a.columns)).count() == 0, n
        assert b.count() == a.count(), n


def test_hot_month_is_several_files(spark, tmp_dir, make_shop):
    """One month (and one job) holds nearly all labor lines: it is written by several tasks."""
    import glob

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        shop = make_shop(orders=[dict(id=1, posted_date="2020-01-05"), dict(id=2, posted_date="2020-02-05")],
                         jobs=[dict(id=1, repair_order_id=1), dict(id=2, repair_order_id=2)])
        shop.labor_lines = spark.range(20_000).selectExpr(
            "id", "1 as job_id", "md5(cast(id as string)) as name", "1 as rate", "1.0 as hours", "1 as complete",
            "1 as technician_id", "1 as repair_order_id", "date'2020-01-01' as completed_day",
            "date'2020-01-05' as posted_day", "date'2020-01-01' as created_day")
        shop.write(os.path.join(tmp_dir, "hot"), month_rows=1)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = glob.glob(os.path.join(tmp_dir, "hot/labor_lines/posted_month=202001/*.parquet"))
    assert len(files) > 3
