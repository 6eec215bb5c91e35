"""Registered queries: one callable (spark, sf_dir) -> DataFrame per key.

Each callable reads the silver tables derived from ``sf_dir`` (materialized
once into the shared checkpoint folder) and runs one report with fixed,
documented parameters.  The oracle text for each key lives in
``shoplens.plans.oracle`` with the same parameters.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.params import Period, date_range, ingest_window, trend_window
from shoplens.operators import (audit, categories, daily, indicators, inspect, missed, people,
                                revenue, upsert)
from shoplens.sources import documents, landed
from shoplens.sources import schemas as S
from shoplens.sources.silver import Shop, land_documents, load_shop

# Fixed report parameters of the registered queries.
AS_OF = _dt.date(2001, 8, 1)                       # last order day of the test data
# the whole history: orders are posted and completed some days after the last order day
HISTORY = Period(_dt.date(1995, 1, 1), _dt.date(2001, 12, 31))
YEAR = date_range(days=365, as_of=AS_OF)           # dashboard 365-day period
QUARTER = date_range(days=90, as_of=AS_OF)         # longest period with a daily trend
ONE_TECHNICIAN = 5                                 # the technician of the single-technician trend
TREND_WEEKS = 52
TREND = trend_window(TREND_WEEKS, AS_OF)
SYNC_WINDOW = ingest_window(AS_OF)                 # previous 12 months
# Orders created before the window were stored by an earlier sync.
KNOWN_BEFORE = SYNC_WINDOW.start
RESYNC_TOTAL_BUMP_CENTS = 100
AS_OF_TEXT = AS_OF.isoformat() + "T00:00:00Z"

Query = Callable[[SparkSession, str], DataFrame]


class Landed:
    """Silver tables plus the landed JSON documents rendered from them, each kind when first read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.shop = load_shop(spark, sf_dir)

    def read(self, name: str, schema) -> DataFrame:
        return landed.read_json(self.spark, f"{land_documents(self.spark, self.sf_dir, (name,))}/{name}", schema)

    def order_pages(self) -> DataFrame:
        return self.read("order_pages", S.ORDER_PAGE)

    def employee_pages(self) -> DataFrame:
        return self.read("employee_pages", S.EMPLOYEE_PAGE)

    def job_docs(self) -> DataFrame:
        return self.read("job_documents", S.JOB)


def _shop(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_shop(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _landed(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Landed(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


# ----------------------------------------------------------- ingest queries
def with_orphans(shop: Shop) -> Shop:
    """The tables without some parents (the derived ones have no orphans):
    orders whose key divides by 101 and jobs whose id divides by 103."""
    return Shop(shop.employees, shop.repair_orders.filter("id % 101 <> 0"), shop.jobs.filter("id % 103 <> 0"),
                shop.labor_lines, shop.parts)


def _known_jobs(shop: Shop) -> DataFrame:
    """Jobs stored by the earlier sync: those of orders created before the
    current ingest window (most orders: they move by key, whatever Spark takes
    their size to be)."""
    early = shop.repair_orders.filter(F.col("created_day") < F.lit(KNOWN_BEFORE)).select(
        F.col("id").alias("repair_order_id"))
    return shop.jobs.join(early.hint("merge"), "repair_order_id", "left_semi")


def ingest_repair_orders(d: Landed) -> DataFrame:
    return landed.flatten_orders(d.order_pages())


def ingest_employees(d: Landed) -> DataFrame:
    return landed.flatten_employees(d.employee_pages())


def ingest_jobs(d: Landed) -> DataFrame:
    return landed.flatten_jobs(d.job_docs())


def ingest_labor_lines(d: Landed) -> DataFrame:
    return landed.flatten_labor(d.job_docs())


def ingest_parts(d: Landed) -> DataFrame:
    return landed.flatten_parts(d.job_docs())


def ingest_null_order_amounts(d: Landed) -> DataFrame:
    """B16 on orders of which some lack amounts and some say null."""
    pages = landed.parse_text(documents.orders_text_with_gaps(d.shop), S.ORDER_PAGE)
    return landed.flatten_orders(pages).select("id", "labor_sales", "fee_total", "parts_sales")


def ingest_null_job_amounts(d: Landed) -> DataFrame:
    """B16 on jobs of which some lack amounts and some say null."""
    docs = landed.parse_text(documents.jobs_text_with_gaps(d.shop), S.JOB)
    return landed.flatten_jobs(docs).select("id", "repair_order_id", "labor_hours", "subtotal", "labor_total")


def ingest_null_part_amounts(d: Landed) -> DataFrame:
    """B16 on parts of which some lack amounts and some say null."""
    docs = landed.parse_text(documents.jobs_text_with_gaps(d.shop), S.JOB)
    return landed.flatten_parts(docs).select("id", "job_id", "quantity", "cost", "retail")


def ingest_window_orders(d: Landed) -> DataFrame:
    return landed.in_ingest_window(landed.flatten_orders(d.order_pages()), SYNC_WINDOW)


def upsert_latest_orders(d: Landed) -> DataFrame:
    """First sync stores every order; the re-sync re-fetches the orders of
    the ingest window with a changed total and update stamp: latest wins."""
    first = landed.flatten_orders(d.order_pages())
    again = (landed.in_ingest_window(first, SYNC_WINDOW)
             .withColumn("total_sales", F.col("total_sales") + RESYNC_TOTAL_BUMP_CENTS)
             .withColumn("updated_date", F.lit(AS_OF_TEXT)))
    return upsert.upsert_latest(upsert.with_seq(first, F.lit(0)),
                                upsert.with_seq(again, F.lit(1)))


def upsert_latest_employees(d: Landed) -> DataFrame:
    first = landed.flatten_employees(d.employee_pages())
    # the re-sync brings every third employee only: the others stay as they are
    again = first.filter("id % 3 = 0").withColumn("updated_date", F.lit(AS_OF_TEXT))
    return upsert.upsert_latest(upsert.with_seq(first, F.lit(0)),
                                upsert.with_seq(again, F.lit(1)))


def upsert_new_jobs(d: Landed) -> DataFrame:
    """Stored jobs are never refreshed; only unseen ids are inserted."""
    fetched = upsert.with_seq(landed.flatten_jobs(d.job_docs()), F.col("id"))
    return upsert.upsert_first(_known_jobs(d.shop), fetched)


def new_jobs_anti(d: Landed) -> DataFrame:
    summaries = landed.order_job_summaries(d.order_pages())
    return upsert.unseen_job_ids(summaries, _known_jobs(d.shop))


def ingest_stats(d: Landed) -> DataFrame:
    return upsert.ingest_stats(landed.order_job_summaries(d.order_pages()), _known_jobs(d.shop).select("id"),
                               _usable_jobs(d))


def _usable_jobs(d: Landed) -> DataFrame:
    """Job documents of a fetch that failed for every 29th job id."""
    return landed.flatten_jobs(d.job_docs()).filter("id % 29 <> 0")


def ingest_errors(d: Landed) -> DataFrame:
    return upsert.ingest_errors(landed.order_job_summaries(d.order_pages()), _known_jobs(d.shop).select("id"),
                                _usable_jobs(d))


INGEST = {
    "ingest_repair_orders": ingest_repair_orders,
    "ingest_employees": ingest_employees,
    "ingest_jobs": ingest_jobs,
    "ingest_labor_lines": ingest_labor_lines,
    "ingest_parts": ingest_parts,
    "ingest_null_order_amounts": ingest_null_order_amounts,
    "ingest_null_job_amounts": ingest_null_job_amounts,
    "ingest_null_part_amounts": ingest_null_part_amounts,
    "ingest_window": ingest_window_orders,
    "upsert_latest_orders": upsert_latest_orders,
    "upsert_latest_employees": upsert_latest_employees,
    "upsert_new_jobs": upsert_new_jobs,
    "new_jobs_anti": new_jobs_anti,
    "ingest_stats": ingest_stats,
    "ingest_errors": ingest_errors,
}


# ----------------------------------------------------------- registry
def queries() -> dict[str, Query]:
    H, Y = HISTORY, YEAR
    q: dict[str, Callable[[Shop], DataFrame]] = {
        # revenue
        "revenue": lambda s: revenue.revenue(s, H, "revenue"),
        "revenue_by_basis": lambda s: revenue.revenue_by_basis(s, H),
        "daily_trends": lambda s: revenue.daily_trends(s, H, "revenue"),
        "monthly_trends": lambda s: revenue.monthly_trends(s, H, "revenue"),
        "trend_total_fallback": lambda s: revenue.trend_total_fallback(s, H, "activity"),
        "dashboard_trend": lambda s: revenue.dashboard_trend(s, Y, "production"),
        "dashboard_trend_daily": lambda s: revenue.dashboard_trend(s, QUARTER, "production"),
        "period_comparison": lambda s: revenue.period_comparison(s, Y, "revenue"),
        # from one scan, and from daily rows
        "order_cube": lambda s: revenue.order_cube(s, Y, "revenue"),
        "revenue_from_daily": lambda s: daily.revenue_report(daily.daily_sums(s.repair_orders), H, "revenue"),
        "monthly_trends_from_daily": lambda s: daily.trend_report(daily.daily_sums(s.repair_orders), H, "revenue"),
        "comparison_from_daily": lambda s: daily.comparison_report(daily.daily_sums(s.repair_orders), Y, "revenue"),
        "category_order_counts": lambda s: daily.distinct_in(daily.category_order_bitmaps(s), H, "revenue"),
        "technician_distinct_jobs": lambda s: daily.distinct_in(daily.technician_job_bitmaps(s), H, "revenue"),
        # people
        "technician_metrics": lambda s: people.technician_metrics(s, H, "revenue"),
        "technician_trend": lambda s: people.technician_trend(s, TREND, "revenue"),
        "technician_trend_one": lambda s: people.technician_trend(s, TREND, "revenue", ONE_TECHNICIAN),
        "technician_trend_direction": lambda s: people.technician_trend_direction(
            people.technician_trend(s, TREND, "revenue", ordered=False)),
        "advisor_metrics": lambda s: people.advisor_metrics(s, H, "revenue"),
        "technician_job_counts": people.technician_job_counts,
        "technician_labor_hours": people.technician_labor_hours,
        # categories and missed work
        "job_category_metrics": lambda s: categories.job_category_metrics(s, H, "revenue"),
        "parts_cost_per_job": categories.parts_cost_per_job,
        "labor_hours_per_job": categories.labor_hours_per_job,
        "missed_revenue_summary": lambda s: missed.missed_revenue_summary(s, H, "revenue"),
        "missed_revenue_by_category": lambda s: missed.missed_revenue_by_category(s, H, "revenue"),
        "top_declined_jobs": lambda s: missed.top_declined_jobs(s, H, "revenue"),
        # audit
        "audit_overall": audit.audit_overall,
        "audit_ladder": audit.audit_ladder,
        "audit_monthly": audit.audit_monthly,
        "audit_discrepancies": audit.audit_discrepancies,
        "audit_top_discrepancies": audit.audit_top_discrepancies,
        "audit_common_amounts": audit.audit_common_amounts,
        "audit_job_totals": audit.audit_job_totals,
        # posted / inspection
        "posted_totals": inspect.posted_totals,
        "posted_monthly": inspect.posted_monthly,
        "posted_status_counts": inspect.posted_status_counts,
        "posted_last_30_days": lambda s: inspect.posted_last_30_days(s, AS_OF),
        "discount_analysis": inspect.discount_analysis,
        "data_coverage": inspect.data_coverage,
        "record_counts": inspect.record_counts,
        "status_counts": inspect.status_counts,
        "category_counts": inspect.category_counts,
        "sales_totals": inspect.sales_totals,
        "created_monthly": inspect.created_monthly,
        "orphan_counts": lambda s: inspect.orphan_counts(with_orphans(s)),
        # indicators
        "shop_rate": lambda s: indicators.shop_rate(s, H, "revenue"),
        "alerts": lambda s: indicators.alerts(s, H, "revenue"),
        "technician_review_flags": lambda s: indicators.technician_review_flags(s, H, "revenue"),
        "technician_scorecard": lambda s: indicators.technician_scorecard(s, H, "revenue"),
        "job_category_classes": lambda s: indicators.job_category_classes(s, H, "revenue"),
        "missed_category_classes": lambda s: indicators.missed_category_classes(s, H, "revenue"),
        "management_snapshot": lambda s: indicators.management_snapshot(s, H, "revenue"),
    }
    out = {k: _shop(v) for k, v in q.items()}
    out.update({k: _landed(v) for k, v in INGEST.items()})
    return out
