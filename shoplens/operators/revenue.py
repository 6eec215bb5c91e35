"""Shop revenue: period totals, daily / monthly trends, total fallback,
period-over-period comparison, dashboard trend choice.

All of these read only ``repair_orders``; the period predicate is on a DATE
column so it reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import (DAILY_TREND_MAX_DAYS, Period, basis_column,
                                       validate_basis)
from shoplens.sources.silver import Shop

# order money column -> report name
ORDER_MONEY = (
    ("labor_sales", "labor_sales"),
    ("parts_sales", "parts_sales"),
    ("sublet_sales", "sublet_sales"),
    ("discount_total", "discounts"),
    ("fee_total", "fees"),
    ("taxes", "taxes"),
    ("total_sales", "total_sales"),
)


def orders_in(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Orders whose basis day lies in the period (NULL / malformed drop)."""
    return shop.of_period("repair_orders", period, basis)


def _cents_sums(prefix: str = "") -> list[Column]:
    return [X.sum_cents(src).alias(prefix + name + "_c") for src, name in ORDER_MONEY]


def _revenue_row(df: DataFrame, period: Period, basis: Column) -> DataFrame:
    """Shared projection: one cents aggregate row -> dollar report row."""
    out = df.select(
        F.lit(period.start_s).alias("start_date"), F.lit(period.end_s).alias("end_date"),
        basis.alias("basis"), F.col("ro_count"),
        *[X.dollars(name + "_c").alias(name) for _, name in ORDER_MONEY])
    out = out.select(
        "*",
        X.safe_div("total_sales", "ro_count").alias("average_ro"),
        X.pct("labor_sales", "total_sales").alias("labor_percent"),
        X.pct("parts_sales", "total_sales").alias("parts_percent"),
        X.pct("discounts", F.col("labor_sales") + F.col("parts_sales")).alias("discount_percent"))
    # Revenue-mix bars are capped at 100 %
    return out.select(
        "*",
        F.least(F.col("labor_percent"), F.lit(100.0)).alias("labor_bar_percent"),
        F.least(F.col("parts_percent"), F.lit(100.0)).alias("parts_bar_percent"))


def revenue(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Count, seven sums and the mix ratios for one period (one row).
    No total fallback here (that is applied to trend rows only)."""
    validate_basis(basis)
    agg = orders_in(shop, period, basis).agg(F.count(F.lit(1)).alias("ro_count"), *_cents_sums())
    return _revenue_row(agg, period, F.lit(basis))


def revenue_by_basis(shop: Shop, period: Period) -> DataFrame:
    """D1 for all three bases in one scan: each order is tagged with every
    basis whose day falls in the period, then aggregated per basis."""
    tags = F.array_compact(F.array(*[
        F.when(X.in_period(basis_column(b), period), F.lit(b))
        for b in ("revenue", "production", "activity")]))
    base = shop.repair_orders.select("*", F.explode(tags).alias("basis"))
    agg = base.groupBy("basis").agg(F.count(F.lit(1)).alias("ro_count"), *_cents_sums())
    return _revenue_row(agg, period, F.col("basis"))


def _trend(shop: Shop, period: Period, basis: str, key_name: str, key: Column) -> DataFrame:
    """One row per bucket, 7 sums, total fallback per aggregated row
    (D4), average per order.  Buckets without orders are absent."""
    g = (orders_in(shop, period, basis)
         .groupBy(key.alias(key_name))
         .agg(F.count(F.lit(1)).alias("ro_count"), *_cents_sums()))
    return _trend_rows(g, key_name)


def _trend_rows(g: DataFrame, key_name: str) -> DataFrame:
    rebuilt = X.rebuilt_total_cents("labor_sales_c", "parts_sales_c", "sublet_sales_c",
                                    "fees_c", "taxes_c", "discounts_c")
    total_c = X.normalized_total_cents("total_sales_c", rebuilt)
    out = g.select(
        key_name, "ro_count",
        *[X.dollars(name + "_c").alias(name) for _, name in ORDER_MONEY if name != "total_sales"],
        X.dollars(total_c).alias("total_sales"))
    return out.withColumn("average_ro", X.safe_div("total_sales", "ro_count")).orderBy(key_name)


def daily_trends(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    return _trend(shop, period, basis, "day", X.day_text(basis_column(basis)))


def monthly_trends(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    return _trend(shop, period, basis, "month", X.month_text(basis_column(basis)))


def trend_total_fallback(shop: Shop, period: Period, basis: str = "activity") -> DataFrame:
    """D4 made visible: per month, the reported total, the total rebuilt
    from components and the one the trend uses."""
    g = (orders_in(shop, period, basis)
         .groupBy(X.month_text(basis_column(basis)).alias("month"))
         .agg(F.count(F.lit(1)).alias("ro_count"), *_cents_sums()))
    rebuilt = X.rebuilt_total_cents("labor_sales_c", "parts_sales_c", "sublet_sales_c",
                                    "fees_c", "taxes_c", "discounts_c")
    used = X.normalized_total_cents("total_sales_c", rebuilt)
    return g.select(
        "month", "ro_count",
        X.dollars("total_sales_c").alias("reported_total_sales"),
        X.dollars(rebuilt).alias("rebuilt_total_sales"),
        X.dollars(used).alias("total_sales"),
        (F.col("total_sales_c") <= 0).alias("used_fallback")).orderBy("month")


def dashboard_trend(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Daily buckets for periods up to 90 days, monthly beyond."""
    if period.days <= DAILY_TREND_MAX_DAYS:
        return daily_trends(shop, period, basis)
    return monthly_trends(shop, period, basis)


COMPARED = ("total_sales", "ro_count", "average_ro", "labor_sales", "parts_sales", "discounts")


def period_comparison(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """E3 + I10: the period against the same-length period before it, in a
    single scan (each order is tagged current / previous)."""
    validate_basis(basis)
    prev = period.previous()
    day = F.col(basis_column(basis))
    both = Period(prev.start, period.end)
    is_cur = X.in_period(day, period)
    base = shop.repair_orders.filter(X.in_period(day, both))
    aggs = []
    for tag, cond in (("cur", is_cur), ("prev", ~is_cur)):
        aggs.append(F.count(F.when(cond, F.lit(1))).alias(f"{tag}_ro_count"))
        for src, name in ORDER_MONEY:
            aggs.append(F.coalesce(F.sum(F.when(cond, F.col(src))), F.lit(0)).cast("long")
                        .alias(f"{tag}_{name}_c"))
    return _comparison_row(base.agg(*aggs), period, basis)


def _comparison_row(g: DataFrame, period: Period, basis: str) -> DataFrame:
    prev = period.previous()
    cols = [F.lit(period.start_s).alias("start_date"), F.lit(period.end_s).alias("end_date"),
            F.lit(prev.start_s).alias("previous_start_date"),
            F.lit(prev.end_s).alias("previous_end_date"), F.lit(basis).alias("basis")]
    for tag, label in (("cur", "current"), ("prev", "previous")):
        cols.append(F.col(f"{tag}_ro_count").alias(f"{label}_ro_count"))
        for name in ("total_sales", "labor_sales", "parts_sales", "discounts"):
            cols.append(X.dollars(f"{tag}_{name}_c").alias(f"{label}_{name}"))
    g2 = g.select(*cols)
    g2 = g2.select("*", *[X.safe_div(f"{lb}_total_sales", f"{lb}_ro_count").alias(f"{lb}_average_ro")
                          for lb in ("current", "previous")])
    changes = [X.change_pct(f"current_{m}", f"previous_{m}").alias(f"{m}_percent") for m in COMPARED]
    g3 = g2.select("*", *changes)
    return g3.select("*", *[X.change_class(f"{m}_percent").alias(f"{m}_class") for m in COMPARED])


# ------------------------------------------------------------------ one pass
#: What a row of :func:`order_cube` is about (the grouping id of its columns).
TOTAL, BUCKET, ADVISOR = 0b011, 0b001, 0b010


def order_cube(shop: Shop, period: Period, basis: str = "revenue", by_day: bool = False) -> DataFrame:
    """All that a dashboard needs of the orders, from one scan of them: count
    and money of the period and of the one before it (`current`), in total, by
    day or month, and by advisor.  A row per total, bucket and advisor: the
    grouping sets are aggregated map-side before the shuffle."""
    validate_basis(basis)
    day = basis_column(basis)
    text = X.day_text(day) if by_day else X.month_text(day)
    current = X.in_period(day, period)
    both = shop.of_period("repair_orders", Period(period.previous().start, period.end), basis)
    rows = both.select(current.alias("current"), F.when(current, text).alias("bucket"),
                       F.when(current, F.col("service_writer_id")).alias("advisor_id"), *[c for c, _ in ORDER_MONEY])
    sets = [[F.col("current")], [F.col("current"), F.col("bucket")], [F.col("current"), F.col("advisor_id")]]
    return rows.groupingSets(sets, "current", "bucket", "advisor_id").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("ro_count"), *_cents_sums())


def _cube_total(cube: DataFrame) -> DataFrame:
    rows = cube.filter((F.col("level") == TOTAL) & F.col("current"))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                      for c in ["ro_count", *[f"{name}_c" for _, name in ORDER_MONEY]]])


def revenue_of(cube: DataFrame, period: Period, basis: str) -> DataFrame:
    """D1 from an order cube."""
    return _revenue_row(_cube_total(cube), period, F.lit(basis))


def trend_of(cube: DataFrame, by_day: bool) -> DataFrame:
    """D2 / D3 from an order cube."""
    name = "day" if by_day else "month"
    rows = cube.filter((F.col("level") == BUCKET) & F.col("current"))
    return _trend_rows(rows.withColumnRenamed("bucket", name), name)


def comparison_of(cube: DataFrame, period: Period, basis: str) -> DataFrame:
    """E3 from an order cube."""
    total = cube.filter(F.col("level") == TOTAL)
    columns = ["ro_count", *[f"{name}_c" for _, name in ORDER_MONEY]]
    g = total.agg(*[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long").alias(f"{tag}_{c}")
                    for tag, cond in (("cur", F.col("current")), ("prev", ~F.col("current"))) for c in columns])
    return _comparison_row(g, period, basis)


def per_advisor(cube: DataFrame) -> DataFrame:
    """Orders of each advisor id, from an order cube (cents)."""
    rows = cube.filter((F.col("level") == ADVISOR) & F.col("current"))
    return rows.select("advisor_id", "ro_count", *[F.col(f"{name}_c").alias(src) for src, name in ORDER_MONEY])


def order_figures(cube: DataFrame) -> DataFrame:
    """One row: what the shop figures take from the orders (cents)."""
    return _cube_total(cube).select("ro_count", F.col("labor_sales_c").alias("labor_c"),
                                    F.col("parts_sales_c").alias("parts_c"), "discounts_c")
