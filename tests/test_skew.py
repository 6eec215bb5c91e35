"""Hot keys: one order holds a third of all jobs and one technician a third
of all labor lines.  Reports must stay exact (checked against a brute-force
pandas computation of the same definitions)."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F
import pytest

from conftest import order
from shoplens.functions.params import Period
from shoplens.operators import categories, people

P = Period(dt.date(2025, 1, 1), dt.date(2025, 12, 31))


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    orders = [order(i, posted=f"2025-{1 + i % 12:02d}-{1 + i % 28:02d}T00:00:00Z")
              for i in range(60)]
    jobs, labor, parts = [], [], []
    for j in range(900):
        ro = 0 if j < 300 else rnd.randrange(1, 60)          # order 0: a third of all jobs
        jobs.append(dict(id=j, repair_order_id=ro, authorized=rnd.choice([0, 1, 1]),
                         archived=rnd.choice([None, 0, 0, 1]), subtotal=rnd.randrange(0, 50000),
                         labor_total=rnd.randrange(0, 20000), parts_total=rnd.randrange(0, 30000),
                         job_category_name=rnd.choice(["Brakes", " Brakes", None, "", "Tires"])))
    for k in range(2700):
        tech = 1 if k % 3 == 0 else rnd.randrange(2, 12)      # technician 1: a third of lines
        labor.append(dict(id=k, job_id=rnd.randrange(0, 900), technician_id=tech,
                          hours=rnd.randrange(1, 40) / 16.0, rate=rnd.randrange(8000, 15000)))
    for k in range(1500):
        parts.append(dict(id=k, job_id=rnd.randrange(0, 900), quantity=float(rnd.randrange(1, 5)),
                          cost=rnd.randrange(100, 5000)))
    employees = [dict(id=t, first_name=f"T{t}", last_name="X", role_name="Technician")
                 for t in range(1, 12)]
    return dict(employees=employees, orders=orders, jobs=jobs, labor=labor, parts=parts)


def test_technician_metrics_under_skew(make_shop, skewed):
    shop = make_shop(**skewed)
    got = {r.technician_id: r for r in people.technician_metrics(shop, P).collect()}
    ll, jb = pd.DataFrame(skewed["labor"]), pd.DataFrame(skewed["jobs"])
    m = ll.merge(jb[["id", "repair_order_id"]], left_on="job_id", right_on="id")
    for t, g in m.groupby("technician_id"):
        r = got[t]
        assert r.jobs == g.job_id.nunique()
        assert r.labor_hours == pytest.approx(g.hours.sum())
        assert r.labor_sales == pytest.approx((g.hours * g.rate).sum() / 100.0)
    assert len(got) == m.technician_id.nunique()


def test_category_metrics_under_skew(make_shop, skewed):
    shop = make_shop(**skewed)
    got = {r.category: r for r in categories.job_category_metrics(shop, P).collect()}
    jb = pd.DataFrame(skewed["jobs"])
    sold = jb[(jb.authorized == 1) & ((jb.archived.isna()) | (jb.archived == 0))].copy()
    sold["category"] = sold.job_category_name.fillna("").str.strip().replace("", "Uncategorized")
    pc = pd.DataFrame(skewed["parts"]).assign(c=lambda d: d.cost * d.quantity).groupby("job_id")
    cost, rows = pc.c.sum(), pc.size()
    for cat, g in sold.groupby("category"):
        r = got[cat]
        assert r.job_count == len(g) and r.ro_count == g.repair_order_id.nunique()
        assert r.net_revenue == pytest.approx(g.subtotal.sum() / 100.0)
        assert r.parts_cost == pytest.approx(cost.reindex(g.id).fillna(0).sum() / 100.0)
        assert r.parts_row_count == int(rows.reindex(g.id).fillna(0).sum())
    assert sum(r.percent_of_shop_revenue for r in got.values()) == pytest.approx(100.0)


def test_adapter_line_ids_for_a_hot_job(spark):
    """One (order, line number) holds most lineitem rows and spans several
    range partitions: ids must still be distinct, gapless and in line order."""
    from shoplens.sources import adapter

    rnd = random.Random(3)
    rows = []
    for k in range(400):
        hot = k < 300
        rows.append((1 if hot else 2 + k % 40, 1 if hot else 1 + k % 7, 1000 - k, 5 + k % 9,
                     float(1 + k % 50), 100.0 + k, 0.05, 0.01, "N", "O",
                     dt.datetime(2000, 1, 1)))
    rnd.shuffle(rows)
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, "
                               "l_suppkey long, l_quantity double, l_extendedprice double, "
                               "l_discount double, l_tax double, l_returnflag string, "
                               "l_linestatus string, l_shipdate timestamp_ntz").repartition(4)
    part = spark.range(0, 2000).select(F.col("id").alias("p_partkey"),
                                       F.lit("STANDARD").alias("p_type"),
                                       F.lit("x").alias("p_name"))
    lines = adapter._lines(li, part).toPandas()
    assert len(lines) == 400 and sorted(lines.line_id) == list(range(400))
    assert len({r.id for r in adapter.labor_lines(adapter._lines(li, part)).collect()}) == 400
    for (o, ln), g in lines.groupby(["l_orderkey", "l_linenumber"]):
        g = g.sort_values("l_partkey")   # unique here, so it fixes the line order
        assert list(g.line_id) == list(range(g.line_id.min(), g.line_id.min() + len(g)))
        assert (g.pk == g.l_partkey.min()).all() and (g.sk == g.l_suppkey.min()).all()


def test_adapter_raises_on_line_numbers_outside_the_job_key(spark):
    from shoplens.sources import adapter

    rows = [(1, 9, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime(2000, 1, 1))]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                               "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                               "l_linestatus string, l_shipdate timestamp_ntz")
    part = spark.range(0, 5).select(F.col("id").alias("p_partkey"), F.lit("STANDARD").alias("p_type"),
                                    F.lit("x").alias("p_name"))
    with pytest.raises(Exception, match="job key"):
        adapter._lines(li, part).collect()


def _line_rows(spark, rows):
    return spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate timestamp_ntz").repartition(3)


def test_hot_orders_are_numbered_by_range_as_others_by_order(spark):
    """Hot orders take another way to the same rows, also where lines have no order or parts come twice."""
    from shoplens.sources import adapter

    rnd = random.Random(5)
    rows = [(None if k % 50 == 0 else 3 if k % 2 else rnd.randrange(9), 1 + k % 3, rnd.randrange(12), rnd.randrange(5),
             float(rnd.randrange(1, 9)), 10.0 + k, 0.0, 0.0, "N", "O", dt.datetime(2000, 1, 1)) for k in range(300)]
    part = spark.range(0, 11).select(F.col("id").alias("p_partkey"), F.lit("STANDARD").alias("p_type"), F.lit("x").alias("p_name"))
    part = part.unionByName(part.filter("p_partkey = 2"))
    found = [adapter._lines(_line_rows(spark, rows), part, hot_lines=n) for n in (1000, 100)]
    cols = [c for c in found[0].columns if c != "job_first"]
    a, b = (sorted(map(repr, f.select(*cols, "job_first").collect())) for f in found)
    assert a == b
    nulls = sum(r[0] is None for r in rows)
    assert min(r.line_id for r in found[0].collect()) >= nulls  # lines without an order come first
    lines = found[0].toPandas()
    jobs = {r.id: r for r in adapter.jobs(found[0]).collect()}
    for j, g in lines.groupby("job_id"):
        assert jobs[j].labor_hours == pytest.approx(g.l_quantity.sum() / 16.0) and (g.sk == jobs[j].technician_id).all() | (j % 6 == 0)
