"""Sold versus declined work, by category, and the ranked follow-up list.

"Declined" is ``authorized = 0`` on a not-archived job; NULL authorization
counts on neither side (ingest never writes NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import Period, basis_raw_column, validate_basis
from shoplens.operators.revenue import orders_in
from shoplens.sources.silver import Shop

# Fixed value: default length of the follow-up list.
DEFAULT_JOB_LIMIT = 50


def _open_jobs(shop: Shop, period: Period, basis: str) -> DataFrame:
    return shop.of_period("jobs", period, basis).filter(X.not_archived())


def _split_sums(df: DataFrame, *keys) -> DataFrame:
    a, d = F.col("authorized") == 1, F.col("authorized") == 0
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(a, F.col("subtotal"))), F.lit(0)).alias("auth_c"),
        F.count(F.when(a, F.lit(1))).alias("authorized_count"),
        F.coalesce(F.sum(F.when(d, F.col("subtotal"))), F.lit(0)).alias("decl_c"),
        F.count(F.when(d, F.lit(1))).alias("declined_count"))


def split_by_category(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Sold and declined value (cents) and count per category: what D11 and D12 both sum up."""
    validate_basis(basis)
    jobs = _open_jobs(shop, period, basis).select(
        X.category_label().alias("category"), "authorized", "subtotal")
    return _split_sums(jobs, "category")


def missed_revenue_summary(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """One row, sold and declined value / count, conversion, average."""
    validate_basis(basis)
    return _summary_row(_split_sums(_open_jobs(shop, period, basis)))


def summary_of(split: DataFrame) -> DataFrame:
    """D11 from the sums per category."""
    return _summary_row(split.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                                    for c in ("auth_c", "authorized_count", "decl_c", "declined_count")]))


def _summary_row(g: DataFrame) -> DataFrame:
    out = g.select(X.dollars("decl_c").alias("declined_value"), "declined_count",
                   X.dollars("auth_c").alias("authorized_value"), "authorized_count")
    out = out.withColumn("recommended_value",
                         F.col("authorized_value") + F.col("declined_value"))
    return out.select(
        "declined_value", "declined_count", "authorized_value", "authorized_count",
        "recommended_value",
        X.pct("authorized_value", "recommended_value").alias("conversion_rate_percent"),
        X.safe_div("declined_value", "declined_count").alias("average_declined_value"))


def missed_revenue_by_category(shop: Shop, period: Period, basis: str = "revenue") -> DataFrame:
    """Per category; categories with neither value above 0 are dropped."""
    return by_category_of(split_by_category(shop, period, basis))


def by_category_of(g: DataFrame) -> DataFrame:
    """D12 from the sums per category."""
    out = g.select("category", X.dollars("auth_c").alias("authorized_value"), "authorized_count",
                   X.dollars("decl_c").alias("declined_value"), "declined_count")
    out = out.filter((F.col("declined_value") > 0) | (F.col("authorized_value") > 0))
    out = out.withColumn("recommended_value",
                         F.col("authorized_value") + F.col("declined_value"))
    return (out.withColumn("conversion_rate_percent",
                           X.pct("authorized_value", "recommended_value"))
            .orderBy(F.col("declined_value").desc()))


def top_declined_jobs(shop: Shop, period: Period, basis: str = "revenue",
                      job_limit: int = DEFAULT_JOB_LIMIT) -> DataFrame:
    """the ``job_limit`` declined jobs with the highest quoted subtotal
    (ties by job id).  The top-k runs first, over the jobs alone (each task
    keeps k rows); orders and names are joined onto those k rows only."""
    validate_basis(basis)
    raw = basis_raw_column(basis)
    top = (shop.of_period("jobs", period, basis).filter(X.declined())
           .select(F.col("id").alias("job_id"), F.col("name").alias("job_name"),
                   X.category_label().alias("category"), "subtotal", "repair_order_id", "technician_id")
           .orderBy(F.col("subtotal").desc_nulls_last(), F.col("job_id").asc())
           .limit(int(job_limit)))
    # a job in the period has the days of its order, so the order is there
    orders = orders_in(shop, period, basis).select(
        F.col("id").alias("repair_order_id"), F.col("repair_order_number").alias("ro_number"),
        F.col(raw).alias("report_date"), F.col("service_writer_id"))
    top = top.join(orders, "repair_order_id")
    emp = shop.employees.select("id", X.display_name().alias("name"))
    tech = emp.select(F.col("id").alias("technician_id"), F.col("name").alias("technician_name"))
    adv = emp.select(F.col("id").alias("service_writer_id"), F.col("name").alias("advisor_name"))
    named = top.join(tech, "technician_id", "left").join(adv, "service_writer_id", "left")
    return named.select(
        "job_id", "job_name", "category",
        (F.col("subtotal").cast("double") / F.lit(100.0)).alias("quoted_value"),
        "ro_number", "report_date",
        X.default_if_blank("technician_name", "Unassigned").alias("technician_name"),
        X.default_if_blank("advisor_name", "Unknown").alias("advisor_name"),
    ).orderBy(F.col("quoted_value").desc_nulls_last(), F.col("job_id"))
