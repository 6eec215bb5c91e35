"""Financial reconciliation of posted orders.

Everything is computed in integer cents: "calculated" is labor + parts +
sublet + fees + taxes - discounts, the difference is reported total minus
calculated, and a discrepancy is a difference of more than one cent.  The
overall verdict judges the overall difference (not the last order seen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.sources.silver import Shop

# List lengths of the audit report.
TOP_DISCREPANCIES = 25
TOP_AMOUNTS = 20

COMPONENTS = ("labor_sales", "parts_sales", "sublet_sales", "fee_total", "taxes", "discount_total")


def posted_orders(shop: Shop) -> DataFrame:
    """Orders with a posted date (raw text present, parsable or not)."""
    return shop.repair_orders.filter(F.col("posted_date").isNotNull())


def _calc(prefix: str = "") -> Column:
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(0))
    return (c("labor_sales") + c("parts_sales") + c("sublet_sales") + c("fee_total")
            + c("taxes") - c("discount_total"))


def _diff_cents() -> Column:
    return F.coalesce(F.col("total_sales"), F.lit(0)) - _calc()


def audit_overall(shop: Shop) -> DataFrame:
    """D14 + D20 + count of D17: posted sums, calculated total, difference,
    verdict and how many orders disagree by more than a cent."""
    p = posted_orders(shop)
    g = p.agg(F.count(F.lit(1)).alias("ros"),
              *[X.sum_cents(c).alias(c) for c in COMPONENTS],
              X.sum_cents("total_sales").alias("total_sales"),
              F.count(F.when(F.abs(_diff_cents()) > 1, F.lit(1))).alias("discrepancy_count"))
    calc = _calc()
    diff = F.col("total_sales") - calc
    return g.select(
        "ros",
        X.dollars("labor_sales").alias("labor"), X.dollars("parts_sales").alias("parts"),
        X.dollars("sublet_sales").alias("sublet"), X.dollars("discount_total").alias("discounts"),
        X.dollars("fee_total").alias("fees"), X.dollars("taxes").alias("taxes"),
        X.dollars("total_sales").alias("total"),
        X.dollars(calc).alias("calculated_total"),
        X.dollars(diff).alias("difference"),
        (F.abs(diff) < 1).alias("reconciles"),
        "discrepancy_count")


def audit_ladder(shop: Shop) -> DataFrame:
    """The five cumulative reconciliation totals, long form."""
    g = posted_orders(shop).agg(*[X.sum_cents(c).alias(c) for c in COMPONENTS])
    s1 = F.col("labor_sales") + F.col("parts_sales")
    s2 = s1 + F.col("sublet_sales")
    s3 = s2 + F.col("fee_total")
    s4 = s3 + F.col("taxes")
    s5 = s4 - F.col("discount_total")
    steps = g.select(s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), s4.alias("s4"),
                     s5.alias("s5"))
    stacked = steps.select(F.expr(
        "stack(5, 1, 'labor + parts', s1, 2, 'plus sublet', s2, 3, 'plus fees', s3, "
        "4, 'plus taxes', s4, 5, 'minus discounts', s5) AS (step, label, amount_c)"))
    return stacked.select("step", "label", X.dollars("amount_c").alias("amount"))


def audit_monthly(shop: Shop) -> DataFrame:
    """Per posted month (raw text), calculated vs reported."""
    g = posted_orders(shop).groupBy(F.substring("posted_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("ros"),
        *[X.sum_cents(c).alias(c) for c in COMPONENTS],
        X.sum_cents("total_sales").alias("total_sales"))
    calc = _calc()
    return g.select("month", "ros", X.dollars(calc).alias("calculated"),
                    X.dollars("total_sales").alias("actual"),
                    X.dollars(F.col("total_sales") - calc).alias("difference")).orderBy("month")


def audit_discrepancies(shop: Shop) -> DataFrame:
    """Posted orders whose reported total differs from the calculated
    one by more than one cent."""
    p = posted_orders(shop).select("repair_order_number", "posted_date", "total_sales",
                                   *COMPONENTS, _diff_cents().alias("diff_c"))
    bad = p.filter(F.abs(F.col("diff_c")) > 1)
    return bad.select(
        F.col("repair_order_number").alias("ro_number"), "posted_date",
        X.dollars(_calc()).alias("calculated"), X.dollars("total_sales").alias("actual"),
        X.dollars("diff_c").alias("difference"), F.col("diff_c").alias("difference_cents"))


def audit_top_discrepancies(shop: Shop, limit: int = TOP_DISCREPANCIES) -> DataFrame:
    """largest absolute differences first, ties by order number."""
    return (audit_discrepancies(shop)
            .orderBy(F.abs(F.col("difference_cents")).desc(), F.col("ro_number").asc())
            .limit(int(limit)))


def audit_common_amounts(shop: Shop, limit: int = TOP_AMOUNTS) -> DataFrame:
    """D18 + F8: histogram of the discrepancy amounts (cents), most common
    first, ties by amount."""
    h = audit_discrepancies(shop).groupBy("difference_cents").agg(
        F.count(F.lit(1)).alias("ros"))
    top = h.orderBy(F.col("ros").desc(), F.col("difference_cents").asc()).limit(int(limit))
    return top.select(X.dollars("difference_cents").alias("difference"), "difference_cents", "ros")


def audit_job_totals(shop: Shop) -> DataFrame:
    """Job-level sums over the jobs of posted orders (semi join)."""
    posted = posted_orders(shop).select(F.col("id").alias("repair_order_id"))
    j = shop.jobs.join(posted, "repair_order_id", "left_semi")
    g = j.agg(*[X.sum_cents(c).alias(c) for c in
                ("labor_total", "parts_total", "discount_total", "fee_total", "subtotal")])
    return g.select(X.dollars("labor_total").alias("labor"), X.dollars("parts_total").alias("parts"),
                    X.dollars("discount_total").alias("discounts"),
                    X.dollars("fee_total").alias("fees"), X.dollars("subtotal").alias("subtotal"))
