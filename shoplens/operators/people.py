"""Technician and advisor reports.

Order of work: the period restricts the labor lines by their own day columns, at
the scan, before anything is aggregated.  What is left is aggregated per (job, technician),
which makes "distinct jobs per technician" a plain count, and then per
technician (or technician and week); either level has a map-side part, so a
technician holding a third of all lines is a row per task before the shuffle.
Employees are joined last, to one row per technician; Spark's size check
decides whether that join broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import Period, basis_column, check_technician_id, validate_basis
from shoplens.operators.revenue import orders_in
from shoplens.sources.silver import Shop

# Trend direction threshold (relative change of average rate).
TREND_THRESHOLD = 0.05


def line_sales(hours: str = "hours", rate: str = "rate"):
    """Hours x rate in cents, exact: its sums do not depend on partitioning."""
    return F.col(hours).cast("decimal(14,4)") * F.col(rate).cast("decimal(14,0)")


def _work(lines: DataFrame, *by: str) -> DataFrame:
    """Per (job, technician, ...): billed hours and hours x rate (cents)."""
    return lines.groupBy("job_id", "technician_id", *by).agg(
        F.sum("hours").alias("hours"), F.sum(line_sales()).alias("sales_c"))


def _per(work: DataFrame, *by: str) -> DataFrame:
    return work.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.coalesce(F.sum("hours"), F.lit(0.0)).alias("labor_hours"),
        (F.coalesce(F.sum("sales_c").cast("double"), F.lit(0.0)) / F.lit(100.0)).alias("labor_sales"))


def _technician_rates(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        X.safe_div("labor_hours", "jobs").alias("average_hours_per_job"),
        X.safe_div("labor_sales", "jobs").alias("average_labor_per_job"),
        X.safe_div("labor_sales", "labor_hours").alias("effective_labor_rate"))


def technician_metrics(shop: Shop, period: Period, basis: str = "revenue",
                       ordered: bool = True) -> DataFrame:
    """Per known technician, distinct jobs, hours, hours x rate, and the
    per-job averages.  Labor without a known employee is dropped (inner
    join), no authorized/archived filter."""
    validate_basis(basis)
    lines = shop.of_period("labor_lines", period, basis).filter("technician_id is not null")
    emp = shop.employees.select(F.col("id").alias("technician_id"), "first_name", "last_name")
    g = _per(_work(lines), "technician_id").join(emp, "technician_id")
    out = _technician_rates(g.select("technician_id", X.display_name().alias("technician_name"),
                                     "jobs", "labor_hours", "labor_sales"))
    # report order: most billed hours first, then name
    return out.orderBy(F.col("labor_hours").desc(), "technician_name") if ordered else out


def technician_trend(shop: Shop, window: Period, basis: str = "revenue",
                     technician_id: int | None = None, ordered: bool = True) -> DataFrame:
    """Weekly (Monday-start) jobs, hours and sales per technician over
    the trailing window; one technician when ``technician_id`` is given,
    else every technician at once.  No employee join (unknown ids kept)."""
    day = basis_column(basis)
    lines = shop.of_period("labor_lines", window, basis).filter("technician_id is not null")
    if technician_id is not None:
        lines = lines.filter(F.col("technician_id") == F.lit(check_technician_id(technician_id)))
    lines = lines.withColumn("week", X.week_start(day))
    g = _per(_work(lines, "week"), "technician_id", "week")
    out = g.select(
        "technician_id", X.day_text("week").alias("week_start"), "jobs", "labor_hours",
        "labor_sales",
        X.safe_div("labor_hours", "jobs").alias("average_hours_per_job"),
        X.safe_div("labor_sales", "labor_hours").alias("effective_labor_rate"))
    return out.orderBy("technician_id", "week_start") if ordered else out


def technician_trend_direction(trend: DataFrame) -> DataFrame:
    """E2 for every technician at once.  Weeks with billed hours, in order;
    with n >= 2 the first n div 2 are 'prior', the rest 'recent'; relative
    change of the average weekly rate > 5 % up, < -5 % down, else flat;
    NULL when fewer than two weeks or a zero prior average."""
    rated = trend.filter(F.col("labor_hours").isNotNull() & (F.col("labor_hours") != 0))
    w = Window.partitionBy("technician_id")
    ranked = rated.select(
        "technician_id", "effective_labor_rate",
        F.row_number().over(w.orderBy("week_start")).alias("rn"),
        F.count(F.lit(1)).over(w).alias("n"))
    half = F.call_function("div", F.col("n"), F.lit(2))
    g = ranked.groupBy("technician_id").agg(
        F.max("n").alias("rate_weeks"),
        F.avg(F.when(F.col("rn") <= half, F.col("effective_labor_rate"))).alias("prior"),
        F.avg(F.when(F.col("rn") > half, F.col("effective_labor_rate"))).alias("recent"))
    enough = F.col("rate_weeks") >= 2
    prior = F.when(enough, F.col("prior"))
    recent = F.when(enough, F.col("recent"))
    change = F.when(enough & (F.col("prior") != 0),
                    (F.col("recent") - F.col("prior")) / F.col("prior"))
    direction = (F.when(change.isNull(), F.lit(None).cast("string"))
                 .when(change > TREND_THRESHOLD, F.lit("up"))
                 .when(change < -TREND_THRESHOLD, F.lit("down"))
                 .otherwise(F.lit("flat")))
    return g.select(
        "technician_id", "rate_weeks",
        F.round(prior, 4).alias("prior_average_rate"),
        F.round(recent, 4).alias("recent_average_rate"),
        direction.alias("trend_direction"))


def advisor_metrics(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Every service advisor (case-insensitive role) with their orders
    in the period; advisors without orders are kept with zeros.  Orders are
    aggregated per writer first, then joined to the advisor list."""
    validate_basis(basis)
    per_writer = orders_in(shop, period, basis).groupBy(
        F.col("service_writer_id").alias("advisor_id")).agg(
        F.count("id").alias("ro_count"),
        *[F.sum(c).alias(c) for c in ("total_sales", "labor_sales", "parts_sales",
                                       "discount_total")])
    return advisors_from(shop, per_writer)


def advisors_from(shop: Shop, per_writer: DataFrame) -> DataFrame:
    """D7 from the orders' count and money per advisor id (cents)."""
    adv = shop.employees.filter(X.role_is("role_name", "service advisor")).select(
        F.col("id").alias("advisor_id"), X.display_name().alias("advisor_name"))
    j = adv.join(per_writer, "advisor_id", "left")
    out = j.select(
        "advisor_id", "advisor_name",
        F.coalesce(F.col("ro_count"), F.lit(0)).alias("ro_count"),
        X.dollars("total_sales").alias("total_sales"),
        X.dollars("labor_sales").alias("labor_sales"),
        X.dollars("parts_sales").alias("parts_sales"),
        X.dollars("discount_total").alias("discounts"))
    return (out.withColumn("average_ro", X.safe_div("total_sales", "ro_count"))
            .orderBy(F.col("total_sales").desc()))


def _technicians(shop: Shop) -> DataFrame:
    """Employees whose role is 'technician' (case-insensitive; NULL excluded)."""
    return shop.employees.filter(F.lower(F.col("role_name")) == "technician").select(
        "id", "first_name", "last_name")


def technician_job_counts(shop: Shop) -> DataFrame:
    """Jobs per technician over all jobs, zero kept."""
    per_tech = shop.jobs.groupBy(F.col("technician_id").alias("id")).agg(
        F.count("id").alias("jobs"))
    return (_technicians(shop).join(per_tech, "id", "left")
            .select("id", "first_name", "last_name",
                    F.coalesce(F.col("jobs"), F.lit(0)).alias("jobs"))
            .orderBy(F.col("jobs").desc()))


def technician_labor_hours(shop: Shop) -> DataFrame:
    """Billed hours per technician over all labor lines, NULL -> 0."""
    per_tech = shop.labor_lines.groupBy(F.col("technician_id").alias("id")).agg(
        F.sum("hours").alias("hours"))
    return (_technicians(shop).join(per_tech, "id", "left")
            .select("id", "first_name", "last_name",
                    F.coalesce(F.col("hours"), F.lit(0.0)).alias("hours"))
            .orderBy(F.col("hours").desc()))
