"""Daily sums and bitmaps against the full scans, after random batches and over random periods."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import order
from shoplens.functions.params import Period
from shoplens.operators import categories, daily, people, revenue
from shoplens.sources.silver import load_shop

SF = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def _random_period(rng, first=dt.date(2020, 1, 1), days=200):
    start = first + dt.timedelta(rng.randrange(days))
    return Period(start, start + dt.timedelta(rng.randrange(90)))


def test_sums_stay_right_over_random_batches(make_shop, tmp_dir):
    rng = random.Random(11)
    day = lambda: rng.choice([None, "bad", *[(dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(200))).isoformat()
                                             for _ in range(8)]])
    make = lambda i: order(i, posted=day(), completed=day(), created=day(), labor=rng.randrange(500),
                           parts=rng.randrange(300), total=rng.choice([None, 0]))
    now = {i: make(i) for i in range(60)}
    root = f"{tmp_dir}/daily"
    spark = None
    for turn in range(4):
        orders = make_shop(orders=list(now.values())).repair_orders
        spark = orders.sparkSession
        if turn == 0:
            days = daily.touched_days(orders)
        else:
            ids = rng.sample(sorted(now), 5) + [1000 + turn]
            before = make_shop(orders=[now[i] for i in ids if i in now]).repair_orders
            now.update({i: make(i) for i in ids})  # late changes: days move, amounts change
            after = make_shop(orders=[now[i] for i in ids]).repair_orders
            orders = make_shop(orders=list(now.values())).repair_orders
            days = daily.touched_days(before, after)
        daily.refresh(root, orders, days)
        sums = daily.read_sums(spark, root)
        assert _rows(sums) == _rows(daily.daily_sums(orders))
    shop = make_shop(orders=list(now.values()))
    for basis in daily.BASES:
        p = _random_period(rng)
        assert _rows(daily.revenue_report(sums, p, basis)) == _rows(revenue.revenue(shop, p, basis))
        assert _rows(daily.trend_report(sums, p, basis, True)) == _rows(revenue.daily_trends(shop, p, basis))
        assert _rows(daily.trend_report(sums, p, basis)) == _rows(revenue.monthly_trends(shop, p, basis))
        assert _rows(daily.comparison_report(sums, p, basis)) == _rows(revenue.period_comparison(shop, p, basis))


def test_refresh_rewrites_only_the_months_it_touches(make_shop, tmp_dir):
    root = f"{tmp_dir}/daily"
    rows = [order(i, posted=f"2020-{i:02d}-05", labor=i) for i in range(1, 7)]
    orders = make_shop(orders=rows).repair_orders
    daily.refresh(root, orders, daily.touched_days(orders))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
                     for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    before = files()
    old = make_shop(orders=[rows[2]]).repair_orders
    rows[2] = order(3, posted="2020-05-09", labor=30)  # leaves March empty
    new = make_shop(orders=rows).repair_orders
    daily.refresh(root, new, daily.touched_days(old, make_shop(orders=[rows[2]]).repair_orders))
    after = files()
    assert {m for m in range(1, 7) if any(f"month=20200{m}" in p and after.get(p) == t for p, t in before.items())} == {1, 2, 4, 6}
    assert _rows(daily.read_sums(orders.sparkSession, root)) == _rows(daily.daily_sums(new))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_distinct_counts_of_random_periods(spark):
    shop = load_shop(spark, SF)
    per_category, per_technician = daily.category_order_bitmaps(shop), daily.technician_job_bitmaps(shop)
    rng = random.Random(2)
    for basis in daily.BASES:
        p = _random_period(rng, dt.date(1996, 1, 1), 1500)
        got = {r.key: r.n for r in daily.distinct_in(per_category, p, basis).collect()}
        assert got == {r.category: r.ro_count for r in categories.job_category_metrics(shop, p, basis).collect()}
        known = {r.technician_id: r.jobs for r in people.technician_metrics(shop, p, basis).collect()}
        got = {r.key: r.n for r in daily.distinct_in(per_technician, p, basis).collect() if r.key in known}
        assert got == known


def test_bitmaps_of_far_and_negative_ids(make_shop):
    """One id on several days and lines counts once; ids far apart and below zero do not clash."""
    orders = [order(i, posted=f"2020-01-{1 + k:02d}") for k, i in enumerate([1, 32768, 32769, 10 ** 12, -5])]
    jobs = [dict(id=10 * k + j, repair_order_id=o["id"], authorized=1, archived=0, job_category_name=c)
            for k, o in enumerate(orders) for j, c in enumerate(["a", "a", "b"])]
    shop = make_shop(orders=orders, jobs=jobs)
    p = Period(dt.date(2020, 1, 1), dt.date(2020, 1, 31))
    assert {r.key: r.n for r in daily.distinct_in(daily.category_order_bitmaps(shop), p).collect()} == {"a": 5, "b": 5}
    twice = daily.category_order_bitmaps(shop).unionByName(
        daily.category_order_bitmaps(shop).withColumn("day", F.lit(dt.date(2020, 1, 20))))
    assert {r.key: r.n for r in daily.distinct_in(twice, p).collect()} == {"a": 5, "b": 5}


def test_bitmaps_of_scattered_ids_stay_small(make_shop):
    """Ids far apart take 8 bytes each, not a stretch of thousands of unused bits, in rows and in the aggregates."""
    orders = [order(i * 10 ** 6, posted=f"2020-01-{1 + i % 28:02d}") for i in range(40)]
    jobs = [dict(id=i, repair_order_id=i * 10 ** 6, authorized=1, archived=0, job_category_name="a") for i in range(40)]
    maps = daily.category_order_bitmaps(make_shop(orders=orders, jobs=jobs))
    assert maps.count() == 40 and dict(maps.dtypes)["bitmap"] == "bigint"
    plan = daily.distinct_in(maps, Period(dt.date(2020, 1, 1), dt.date(2020, 1, 31)))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
