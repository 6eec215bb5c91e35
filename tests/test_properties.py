"""Property tests: period arithmetic and keyed merges against plain Python."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoplens.functions.params import DASHBOARD_DAYS, date_range, ingest_window, trend_window
from shoplens.operators import upsert

days_st = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2100, 12, 31))


@given(end=days_st, days=st.sampled_from(DASHBOARD_DAYS))
def test_period_and_previous_are_adjacent_and_equal_length(end, days):
    p = date_range(days=days, as_of=end)
    assert p.end == end and p.days == days
    q = p.previous()
    assert q.days == p.days and q.end + dt.timedelta(days=1) == p.start


@given(end=days_st, weeks=st.integers(min_value=1, max_value=52))
def test_trend_window_length(end, weeks):
    w = trend_window(weeks, end)
    assert w.days == weeks * 7 + 1 and w.end == end


@given(day=days_st)
def test_ingest_window_is_one_year(day):
    w = ingest_window(day)
    assert w.end == day and w.start.year == day.year - 1
    assert w.start.month == day.month
    assert w.start.day == (28 if (day.month, day.day) == (2, 29) else day.day)


rows_st = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 10 ** 6), st.integers(0, 99)),
                   min_size=1, max_size=40, unique_by=lambda t: t[1])


@settings(max_examples=8, deadline=None)
@given(rows=rows_st)
def test_latest_and_first_per_key_match_python(spark, rows):
    df = spark.createDataFrame(rows, "id long, seq long, v long")
    latest = {r.id: r.v for r in
              upsert.latest_per_key(upsert.with_seq(df, F.col("seq")).drop("seq")).collect()}
    first = {r.id: r.v for r in
             upsert.first_per_key(upsert.with_seq(df, F.col("seq")).drop("seq")).collect()}
    want_latest, want_first = {}, {}
    for i, s, v in sorted(rows, key=lambda t: t[1]):
        want_latest[i] = v
        want_first.setdefault(i, v)
    assert latest == want_latest and first == want_first


def _order_rows(rnd_rows):
    out = []
    for i, (day, shape, labor, parts, disc, total) in enumerate(rnd_rows):
        text = None
        if shape == 1:
            text = day.isoformat() + "T00:00:00Z"
        elif shape == 2:
            text = day.isoformat()
        elif shape == 3:
            text = day.strftime("%m/%d/%Y")          # malformed: dropped by the period
        out.append((i, text, labor, parts, disc, total))
    return out


order_st = st.lists(st.tuples(st.dates(dt.date(2024, 11, 1), dt.date(2025, 3, 31)),
                              st.integers(0, 3), st.integers(0, 5000), st.integers(0, 5000),
                              st.integers(0, 3000), st.integers(0, 9000)),
                    min_size=1, max_size=30)


@settings(max_examples=6, deadline=None)
@given(rows=order_st)
def test_revenue_and_monthly_trend_match_pandas(spark, rows):
    import pandas as pd

    from shoplens.functions.params import Period
    from shoplens.operators import revenue
    from shoplens.sources import schemas as S
    from shoplens.sources.landed import with_order_days
    from shoplens.sources.silver import Shop

    data = _order_rows(rows)
    names = [f.name for f in S.REPAIR_ORDERS.fields]
    full = []
    for i, text, labor, parts, disc, total in data:
        r = dict.fromkeys(names)
        r.update(id=i, posted_date=text, labor_sales=labor, parts_sales=parts,
                 discount_total=disc, total_sales=total, sublet_sales=0, fee_total=0, taxes=0)
        full.append(tuple(r[n] for n in names))
    ro = with_order_days(spark.createDataFrame(full, S.REPAIR_ORDERS))
    empty = lambda sch: spark.createDataFrame([], sch)
    shop = Shop(empty(S.EMPLOYEES), ro, empty(S.JOBS), empty(S.LABOR_LINES), empty(S.PARTS))
    period = Period(dt.date(2024, 12, 1), dt.date(2025, 2, 28))

    pdf = pd.DataFrame(data, columns=["id", "text", "labor", "parts", "disc", "total"])
    text = pdf.text.astype("string")
    day = pd.to_datetime(text.str.slice(0, 10), format="%Y-%m-%d", errors="coerce")
    keep = (day.notna() & (day >= "2024-12-01") & (day <= "2025-02-28")).fillna(False).astype(bool)
    sel = pdf[keep].assign(month=day[keep].dt.strftime("%Y-%m"))

    r = revenue.revenue(shop, period).first()
    assert r.ro_count == len(sel)
    assert r.total_sales == pytest.approx(sel.total.sum() / 100.0)
    assert r.labor_sales == pytest.approx(sel.labor.sum() / 100.0)

    got = {m.month: (m.ro_count, m.total_sales) for m in revenue.monthly_trends(shop, period).collect()}
    want = {}
    for month, g in sel.groupby("month"):
        t = g.total.sum()
        rebuilt = g.labor.sum() + g.parts.sum() - g.disc.sum()
        want[month] = (len(g), (t if t > 0 else max(rebuilt, 0)) / 100.0)
    assert got.keys() == want.keys()
    for m in want:
        assert got[m][0] == want[m][0] and got[m][1] == pytest.approx(want[m][1])
