"""Profit by job category with cost-based parts margin.

The period comes first: parts and labor lines are restricted to it by their own
day columns, at the scan, then aggregated per job *before* they meet the job row (a job with
three parts and two labor lines must not be counted six times).  Both
pre-aggregates are partial aggregations keyed by job id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import Period, validate_basis
from shoplens.sources.silver import Shop

JOB_MONEY = (
    ("labor_total", "labor_revenue"),
    ("parts_total", "parts_revenue"),
    ("discount_total", "discounts"),
    ("fee_total", "fees"),
    ("subtotal", "net_revenue"),
)


def parts_cost_per_job(shop: Shop, parts: DataFrame | None = None) -> DataFrame:
    """sum(cost x quantity) in cents (exact) and the part-row count per
    job, of the given part rows or of all."""
    cost = F.coalesce(F.col("cost"), F.lit(0)).cast("decimal(14,0)") * F.coalesce(
        F.col("quantity"), F.lit(0.0)).cast("decimal(14,4)")
    return (shop.parts if parts is None else parts).groupBy("job_id").agg(
        F.sum(cost).cast("double").alias("parts_cost"),
        F.count(F.lit(1)).alias("parts_row_count"))


def labor_hours_per_job(shop: Shop, lines: DataFrame | None = None) -> DataFrame:
    """Billed hours per job, of the given labor lines or of all."""
    return (shop.labor_lines if lines is None else lines).groupBy("job_id").agg(
        F.sum(F.coalesce(F.col("hours"), F.lit(0.0))).alias("labor_hours"))


def sold_jobs_in(shop: Shop, period: Period, basis: str) -> DataFrame:
    """Authorized, not archived jobs on orders in the period."""
    return shop.of_period("jobs", period, basis).filter(X.sold())


def job_category_metrics(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """D8 + D13 + E1.

    Distinct orders per category come from a two-level aggregation
    (category, order) -> category, which spreads a hot category over its
    orders; job ids are the jobs table's primary key, so distinct jobs is
    the row count after the fan-out-free joins.
    """
    validate_basis(basis)
    jobs = sold_jobs_in(shop, period, basis).select(
        F.col("id").alias("job_id"), "repair_order_id",
        X.category_label().alias("category"), *[c for c, _ in JOB_MONEY])
    base = (jobs.join(parts_cost_per_job(shop, shop.of_period("parts", period, basis)), "job_id", "left")
            .join(labor_hours_per_job(shop, shop.of_period("labor_lines", period, basis)), "job_id", "left"))
    sums = [F.sum(c).alias(c) for c, _ in JOB_MONEY] + [
        F.sum("parts_cost").alias("parts_cost"), F.sum("parts_row_count").alias("parts_row_count"),
        F.sum("labor_hours").alias("labor_hours")]
    per_order = base.groupBy("category", "repair_order_id").agg(
        F.count(F.lit(1)).alias("job_count"), *sums)
    g = per_order.groupBy("category").agg(
        F.sum("job_count").alias("job_count"), F.count(F.lit(1)).alias("ro_count"),
        *[F.sum(c).alias(c) for c, _ in JOB_MONEY],
        F.sum("parts_cost").alias("parts_cost"), F.sum("parts_row_count").alias("parts_row_count"),
        F.sum("labor_hours").alias("labor_hours"))
    out = g.select(
        "category", F.col("job_count").cast("long").alias("job_count"), "ro_count",
        *[X.dollars(c).alias(n) for c, n in JOB_MONEY],
        (F.coalesce(F.col("parts_cost"), F.lit(0.0)) / F.lit(100.0)).alias("parts_cost"),
        F.coalesce(F.col("parts_row_count"), F.lit(0)).cast("long").alias("parts_row_count"),
        F.coalesce(F.col("labor_hours"), F.lit(0.0)).alias("labor_hours"))
    has_cost = F.col("parts_row_count") > 0
    margin = F.when(has_cost, F.col("parts_revenue") - F.col("parts_cost"))
    # Share of the shop's net revenue, a scalar over the sold jobs alone
    shop_net_c = sold_jobs_in(shop, period, basis).agg(F.sum("subtotal")).scalar()
    return out.select(
        "category", "job_count", "ro_count", "labor_revenue", "parts_revenue", "discounts",
        "fees", "net_revenue", "parts_cost", "parts_row_count", "labor_hours",
        has_cost.alias("has_parts_cost_data"),
        margin.alias("parts_margin_dollars"),
        F.when(has_cost & (F.col("parts_revenue") != 0),
               margin / F.col("parts_revenue") * F.lit(100.0)).alias("parts_margin_percent"),
        (F.col("labor_revenue") + F.col("parts_revenue")).alias("total_revenue"),
        X.pct("net_revenue", shop_net_c.cast("double") / F.lit(100.0))
        .alias("percent_of_shop_revenue"),
        X.safe_div("net_revenue", "job_count").alias("average_job_value"),
        X.safe_div("labor_revenue", "labor_hours").alias("effective_labor_rate"),
    ).orderBy(F.col("net_revenue").desc())
