"""Derived indicators: shop rate, alerts, technician flags and scorecard,
margin / conversion classes, management snapshot.

Shop-level figures are one row built from stacked one-row aggregates
(``shop_figures``); per-technician rows receive it as a single scalar
subquery.  No cross join and no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import Period
from shoplens.operators import categories, missed, people, revenue
from shoplens.sources.silver import Shop

# Review thresholds of the dashboard.
SHOP_RATE_REVIEW = 125.0          # $/h, below -> warn
DISCOUNT_REVIEW_PERCENT = 10.0    # above -> warn
TECH_MIN_JOBS = 10
TECH_LOW_RATE = 100.0             # $/h
TECH_LONG_JOB_HOURS = 1.75
TECH_NAMED_IN_ALERT = 3
STATUS_GOOD_RATIO = 1.0
STATUS_WARN_RATIO = 0.85
MARGIN_GOOD, MARGIN_WARN = 40.0, 25.0
CONVERSION_GOOD, CONVERSION_WARN = 75.0, 50.0


def _flag_columns(df: DataFrame) -> DataFrame:
    low = F.col("effective_labor_rate") < TECH_LOW_RATE
    long_jobs = F.col("average_hours_per_job") > TECH_LONG_JOB_HOURS
    flagged = (F.col("jobs") >= TECH_MIN_JOBS) & (low | long_jobs)
    return df.select("*", low.alias("low_rate"), long_jobs.alias("long_jobs"),
                     flagged.alias("flagged"))


def shop_figures(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """One row of shop-level figures for the period: order count and money
    (cents), billed hours and flagged technicians (from the technician
    report), and the dashboard-trend total (cents)."""
    orders = revenue.orders_in(shop, period, basis).agg(
        F.count(F.lit(1)).alias("ro_count"),
        X.sum_cents("labor_sales").alias("labor_c"), X.sum_cents("parts_sales").alias("parts_c"),
        X.sum_cents("discount_total").alias("discounts_c"))
    return figures_from(orders,
                        people.technician_metrics(shop, period, basis, ordered=False),
                        revenue.dashboard_trend(shop, period, basis))


def figures_from(orders: DataFrame, technicians: DataFrame, trend: DataFrame) -> DataFrame:
    """Shop figures from already computed pieces.  The three one-row
    aggregates are stacked with ``unionByName`` and folded by a global
    aggregate: one job, each branch partially aggregated, no join and no
    nested subquery.  ``orders``: one row of count and money (cents)."""
    tech = _flag_columns(technicians).agg(
        F.coalesce(F.sum("labor_hours"), F.lit(0.0)).alias("hours"),
        F.count(F.when(F.col("flagged"), F.lit(1))).alias("flagged"))
    trend = trend.agg(
        F.coalesce(F.sum(F.round(F.col("total_sales") * 100).cast("long")), F.lit(0))
        .alias("trend_c"))
    u = orders.unionByName(tech, allowMissingColumns=True).unionByName(
        trend, allowMissingColumns=True)
    cols = ("ro_count", "labor_c", "parts_c", "discounts_c", "hours", "flagged", "trend_c")
    g = u.agg(*[F.max(c).alias(c) for c in cols])
    labor, parts = X.dollars("labor_c"), X.dollars("parts_c")
    return g.select(
        "ro_count", F.col("hours").alias("total_billed_hours"),
        labor.alias("shop_labor_sales"), parts.alias("shop_parts_sales"),
        X.dollars("discounts_c").alias("shop_discounts"),
        F.col("flagged").alias("flagged_technicians"),
        X.dollars("trend_c").alias("trend_total_sales"),
    ).select("*", X.safe_div("shop_labor_sales", "total_billed_hours").alias("effective_labor_rate"),
             X.pct("shop_discounts", F.col("shop_labor_sales") + F.col("shop_parts_sales"))
             .alias("discount_percent"))


def shop_rate(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Billed hours summed over the technician report, order labor
    sales, their ratio, and the total of the dashboard trend."""
    return shop_rate_from(shop_figures(shop, period, basis))


def shop_rate_from(figures: DataFrame) -> DataFrame:
    return figures.select(
        "total_billed_hours", "shop_labor_sales", "effective_labor_rate", "trend_total_sales")


def technician_review_flags(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Technicians with >= 10 jobs and (rate < 100 or > 1.75 h/job),
    both reasons kept; the first three in report order (hours desc, name)
    are the ones the alert names."""
    return review_flags_from(people.technician_metrics(shop, period, basis, ordered=False))


def review_flags_from(technicians: DataFrame) -> DataFrame:
    """The three named ones are a top-k of their own, joined back by id."""
    tech = _flag_columns(technicians).filter("flagged")
    named = (tech.orderBy(F.col("labor_hours").desc(), F.col("technician_name").asc(), F.col("technician_id").asc())
             .limit(TECH_NAMED_IN_ALERT).select("technician_id", F.lit(True).alias("named")))
    return tech.join(named, "technician_id", "left").select(
        "technician_id", "technician_name", "jobs", "labor_hours", "effective_labor_rate",
        "average_hours_per_job", "low_rate", "long_jobs",
        F.coalesce("named", F.lit(False)).alias("named_in_alert"))


def alerts(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """I1 + I2 + I3 summary: three alert rows with their measured value and
    class (warn / good)."""
    return alerts_from(shop_figures(shop, period, basis))


def alerts_from(figures: DataFrame) -> DataFrame:
    wide = figures.select(
        F.col("effective_labor_rate").alias("r"), F.col("discount_percent").alias("d"),
        F.col("flagged_technicians").cast("double").alias("f"))
    long = wide.select(F.expr(
        "stack(3, 'labor_rate', r, 'discounting', d, 'technician_review', f) AS (alert, value)"))
    cls = (F.when((F.col("alert") == "labor_rate") & (F.col("value") < SHOP_RATE_REVIEW), "warn")
           .when((F.col("alert") == "discounting") & (F.col("value") > DISCOUNT_REVIEW_PERCENT),
                 "warn")
           .when((F.col("alert") == "technician_review") & (F.col("value") > 0), "warn")
           .otherwise("good"))
    return long.select("alert", "value", cls.alias("class"))


def technician_status(rate, shop_rate_col):
    """I4: insufficient when either rate is 0; ratio >= 1 good, >= 0.85 warn,
    else bad.  Returns (class, label)."""
    r = X.col(rate)
    # NULL when either rate is 0 / NULL (the shop rate is referenced once)
    ratio = F.try_divide(F.when(r != 0, r), X.col(shop_rate_col))
    cls = (F.when(ratio.isNull(), "warn").when(ratio >= STATUS_GOOD_RATIO, "good")
           .when(ratio >= STATUS_WARN_RATIO, "warn").otherwise("bad"))
    label = (F.when(ratio.isNull(), "insufficient_data")
             .when(ratio >= STATUS_GOOD_RATIO, "at_or_above_shop")
             .when(ratio >= STATUS_WARN_RATIO, "review").otherwise("below_shop"))
    return cls, label


def technician_scorecard(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """I5 + I4 + E4: per technician, production figures, share of the shop's
    order labor sales and status against the shop rate.

    Shop rate = the shop's order labor sales over the billed hours of all
    technicians; both are scalar subqueries (partial aggregates of one row)."""
    labor_c = revenue.orders_in(shop, period, basis).agg(X.sum_cents("labor_sales")).scalar()
    tech = people.technician_metrics(shop, period, basis, ordered=False)
    hours = tech.agg(F.coalesce(F.sum("labor_hours"), F.lit(0.0))).scalar()
    tech = tech.withColumn("_shop_labor", X.dollars(labor_c)).withColumn("_hours", hours)
    tech = tech.withColumn("_shop", F.struct(
        X.safe_div("_shop_labor", "_hours").alias("rate"), F.col("_shop_labor").alias("labor")))
    return _scorecard_rows(tech)


def scorecard_from(technicians: DataFrame, figures: DataFrame) -> DataFrame:
    fig = figures.select(F.struct(
        F.col("effective_labor_rate").alias("rate"),
        F.col("shop_labor_sales").alias("labor")).alias("s")).scalar()
    return _scorecard_rows(technicians.withColumn("_shop", fig))


def _scorecard_rows(tech: DataFrame) -> DataFrame:
    cls, label = technician_status("effective_labor_rate", F.col("_shop.rate"))
    return tech.select(
        "technician_id", "technician_name", "jobs", "labor_hours", "labor_sales",
        X.safe_div("labor_sales", "jobs").alias("labor_per_job"),
        X.safe_div("labor_hours", "jobs").alias("hours_per_job"),
        "effective_labor_rate",
        X.pct("labor_sales", F.col("_shop.labor")).alias("shop_labor_share_percent"),
        cls.alias("status_class"), label.alias("status_label"))


def job_category_classes(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Parts-margin class per category (muted when unknown)."""
    c = categories.job_category_metrics(shop, period, basis)
    known = F.col("has_parts_cost_data") & (F.col("parts_revenue") > 0)
    m = F.coalesce(F.col("parts_margin_percent"), F.lit(0.0))
    cls = (F.when(~known, "muted").when(m >= MARGIN_GOOD, "good").when(m >= MARGIN_WARN, "warn")
           .otherwise("bad"))
    return c.select("category", "parts_revenue", "parts_margin_percent", cls.alias("margin_class"))


def missed_category_classes(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Conversion class per category."""
    c = missed.missed_revenue_by_category(shop, period, basis)
    r = F.coalesce(F.col("conversion_rate_percent"), F.lit(0.0))
    cls = F.when(r >= CONVERSION_GOOD, "good").when(r >= CONVERSION_WARN, "warn").otherwise("bad")
    return c.select("category", "conversion_rate_percent", cls.alias("conversion_class"))


def management_snapshot(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """I8 (I9 folded in: the order count is never 0 with a positive
    average): per-order labor, hours and parts, and labor mix of labor+parts."""
    return snapshot_from(shop_figures(shop, period, basis))


def snapshot_from(fig: DataFrame) -> DataFrame:
    return fig.select(
        "ro_count",
        X.safe_div("shop_labor_sales", "ro_count").alias("labor_per_ro"),
        X.safe_div("total_billed_hours", "ro_count").alias("hours_per_ro"),
        X.safe_div("shop_parts_sales", "ro_count").alias("parts_per_ro"),
        X.pct("shop_labor_sales", F.col("shop_labor_sales") + F.col("shop_parts_sales"))
        .alias("labor_mix_percent"))
