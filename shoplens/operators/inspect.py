"""Posted / end-of-day analysis and database inspection reports, plus the
data-integrity (orphan) checks."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import _as_date
from shoplens.operators.audit import posted_orders
from shoplens.sources.silver import TABLE_NAMES, Shop, footers

# Fixed value: the trailing posted-sales report covers day >= as_of - 30.
TRAILING_DAYS = 30

SEVEN = (("labor_sales", "labor"), ("parts_sales", "parts"), ("sublet_sales", "sublet"),
         ("discount_total", "discounts"), ("fee_total", "fees"), ("taxes", "taxes"),
         ("total_sales", "total"))


def _seven_dollars():
    return [X.dollars(F.sum(c)).alias(n) for c, n in SEVEN]


def posted_totals(shop: Shop) -> DataFrame:
    """Posted count, seven sums, average (NULL when nothing posted)."""
    g = posted_orders(shop).agg(F.count(F.lit(1)).alias("ros"), *_seven_dollars())
    return g.withColumn("average_ro", X.safe_div("total", "ros", otherwise=None))


def posted_monthly(shop: Shop) -> DataFrame:
    """Posted sales per month (raw text month)."""
    g = posted_orders(shop).groupBy(F.substring("posted_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("ros"), *_seven_dollars())
    return g.withColumn("average_ro", X.safe_div("total", "ros")).orderBy("month")


def posted_status_counts(shop: Shop) -> DataFrame:
    """Posted orders per status name (NULL is its own group)."""
    return (posted_orders(shop).groupBy("status_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc()))


def posted_last_30_days(shop: Shop, as_of) -> DataFrame:
    """Daily posted sales for day >= as_of - 30 (no upper bound)."""
    since = _as_date(as_of) - _dt.timedelta(days=TRAILING_DAYS)
    p = posted_orders(shop).filter(X.on_or_after("posted_day", since))
    return p.groupBy(F.substring("posted_date", 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("ros"),
        X.dollars(F.sum("labor_sales")).alias("labor"),
        X.dollars(F.sum("parts_sales")).alias("parts"),
        X.dollars(F.sum("total_sales")).alias("total")).orderBy("day")


def discount_analysis(shop: Shop) -> DataFrame:
    """Gross (labor + parts), discounts, rate (NULL when gross is 0), net."""
    g = posted_orders(shop).agg(*[F.sum(c).alias(c) for c in
                                  ("labor_sales", "parts_sales", "discount_total", "total_sales")])
    gross = X.dollars("labor_sales") + X.dollars("parts_sales")
    out = g.select(gross.alias("gross_sales"), X.dollars("discount_total").alias("discounts"),
                   X.dollars("total_sales").alias("net_sales"))
    return out.select("gross_sales", "discounts",
                      X.pct("discounts", "gross_sales", otherwise=None).alias("discount_rate"),
                      "net_sales")


def data_coverage(shop: Shop) -> DataFrame:
    """Earliest / latest posted text (string order) and posted count."""
    return posted_orders(shop).agg(F.min("posted_date").alias("earliest"),
                                   F.max("posted_date").alias("latest"),
                                   F.count(F.lit(1)).alias("posted_ros"))


def record_counts(shop: Shop) -> DataFrame:
    """Row count of each silver table.  Of stored tables only the file
    footers are read: the count is pushed into the Parquet scan.  (Not so the
    first and last day of D26: Spark refuses to take them from a footer whose
    column is null throughout.)"""
    tables = footers(shop) if shop.root else shop.as_dict()
    parts = [tables[n].agg(F.count(F.lit(1)).alias("count"))
             .select(F.lit(n).alias("table_name"), "count") for n in TABLE_NAMES]
    return reduce(DataFrame.unionByName, parts)


def status_counts(shop: Shop) -> DataFrame:
    """Orders per status name, all orders."""
    return (shop.repair_orders.groupBy("status_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc()))


def category_counts(shop: Shop) -> DataFrame:
    """Jobs per raw (untrimmed) category text, NULL kept."""
    return (shop.jobs.groupBy("job_category_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc()))


def sales_totals(shop: Shop) -> DataFrame:
    """Seven sums over all orders, no date filter."""
    return shop.repair_orders.agg(*_seven_dollars())


def created_monthly(shop: Shop) -> DataFrame:
    """Per created month (raw text; the NULL month is kept)."""
    return shop.repair_orders.groupBy(F.substring("created_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("repair_orders"),
        X.dollars(F.sum("labor_sales")).alias("labor"),
        X.dollars(F.sum("parts_sales")).alias("parts"),
        X.dollars(F.sum("total_sales")).alias("total")).orderBy("month")


def _orphans(child: DataFrame, fk: str, parent: DataFrame) -> DataFrame:
    """Children whose parent key is missing (NULL keys count as orphans).

    Children are first counted per parent key (a partial aggregate, so a key
    holding a third of all rows is one row per task before the shuffle);
    only the distinct keys meet the parent ids in the anti join.
    """
    per_key = child.groupBy(F.col(fk).alias("pk")).agg(F.count(F.lit(1)).alias("n"))
    missing = per_key.join(parent.select(F.col("id").alias("pk")), "pk", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def orphan_counts(shop: Shop) -> DataFrame:
    """C11: jobs without order, labor lines and parts without job."""
    jobs = _orphans(shop.jobs, "repair_order_id", shop.repair_orders)
    labor = _orphans(shop.labor_lines, "job_id", shop.jobs)
    parts = _orphans(shop.parts, "job_id", shop.jobs)
    return jobs.select(
        F.col("n").alias("orphan_jobs"),
        labor.scalar().alias("orphan_labor_lines"),
        parts.scalar().alias("orphan_parts"))
