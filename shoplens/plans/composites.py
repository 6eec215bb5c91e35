"""Composite reports (K1 dashboard response, K2 snapshot, K3 missed work).

A report takes everything it says about orders from one scan of them: an order
cube (:func:`shoplens.operators.revenue.order_cube`) with totals, buckets, advisors
and the period before.  The cube, the technician report and the sums of sold and
declined work per category are small; they are written once to the shared
folder, and the members that use them read that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.params import DAILY_TREND_MAX_DAYS, Period, check_days, date_range, validate_basis
from shoplens.operators import categories, indicators, missed, people, revenue
from shoplens.session import delete_folder, stored
from shoplens.sources.silver import Shop


class Report(dict):
    """``dict[str, DataFrame]`` that also remembers its stored intermediate tables."""

    def __init__(self, *a, spark=None, folders=(), **kw):
        super().__init__(*a, **kw)
        self._spark, self._folders = spark, list(folders)

    def unpersist(self) -> None:
        """Delete the stored intermediate tables: the members cannot be read any more."""
        for path in self._folders:
            delete_folder(self._spark, path)
        self._folders = []

    def write(self, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
        """A11 report sink: every member DataFrame to ``<path>/<name>``
        (JSON by default, any DataFrameWriter format otherwise)."""
        for name, df in self.items():
            df.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")


def _bases(shop: Shop, period: Period, basis: str, by_day: bool, store: bool):
    """Order cube, technician report, sold and declined sums; and the folders they are stored in."""
    parts = {"cube": revenue.order_cube(shop, period, basis, by_day),
             "technicians": people.technician_metrics(shop, period, basis, ordered=False),
             "missed": missed.split_by_category(shop, period, basis)}
    if not store:
        return *parts.values(), []
    made = [stored(df, name) for name, df in parts.items()]
    return *[df for df, _ in made], [path for _, path in made]


def dashboard_report(shop: Shop, days: int = 30, basis: str = "revenue", as_of=None,
                     cache: bool = True) -> Report:
    """K1: revenue, trend (daily up to 90 days, else monthly), technicians,
    advisors, categories, missed work and the period comparison, plus the
    derived indicators the page computes.  Without ``cache`` nothing runs here,
    and every member is computed by itself."""
    check_days(days)
    validate_basis(basis)
    period = date_range(days=days, as_of=as_of)
    by_day = period.days <= DAILY_TREND_MAX_DAYS
    cube, tech, split, folders = _bases(shop, period, basis, by_day, cache)
    trend = revenue.trend_of(cube, by_day)
    fig = indicators.figures_from(revenue.order_figures(cube), tech, trend)
    return Report({
        "revenue": revenue.revenue_of(cube, period, basis),
        "trend": trend,
        "technicians": tech.orderBy(F.col("labor_hours").desc(), "technician_name"),
        "advisors": people.advisors_from(shop, revenue.per_advisor(cube)),
        "job_categories": categories.job_category_metrics(shop, period, basis),
        "missed_summary": missed.summary_of(split),
        "missed_by_category": missed.by_category_of(split),
        "top_declined_jobs": missed.top_declined_jobs(shop, period, basis),
        "comparison": revenue.comparison_of(cube, period, basis),
        "shop_rate": indicators.shop_rate_from(fig),
        "alerts": indicators.alerts_from(fig),
        "technician_scorecard": indicators.scorecard_from(tech, fig),
        "management_snapshot": indicators.snapshot_from(fig),
    }, spark=shop.repair_orders.sparkSession, folders=folders)


def dashboard_snapshot(shop: Shop, start=None, end=None, basis: str = "revenue",
                       as_of=None, cache: bool = True) -> Report:
    """K2: period, revenue, monthly trend, technicians, advisors, categories
    and missed work for an explicit range."""
    period = date_range(start, end, as_of=as_of)
    validate_basis(basis)
    cube, tech, split, folders = _bases(shop, period, basis, False, cache)
    return Report({
        "revenue": revenue.revenue_of(cube, period, basis),
        "monthly_trends": revenue.trend_of(cube, False),
        "technicians": tech.orderBy(F.col("labor_hours").desc(), "technician_name"),
        "advisors": people.advisors_from(shop, revenue.per_advisor(cube)),
        "job_categories": categories.job_category_metrics(shop, period, basis),
        "missed_summary": missed.summary_of(split),
        "missed_by_category": missed.by_category_of(split),
        "top_declined_jobs": missed.top_declined_jobs(shop, period, basis),
    }, spark=shop.repair_orders.sparkSession, folders=folders)


def missed_revenue(shop: Shop, period: Period, basis: str = "revenue",
                   job_limit: int = missed.DEFAULT_JOB_LIMIT) -> dict[str, DataFrame]:
    """K3: summary, by-category and top declined jobs."""
    return {
        "missed_summary": missed.missed_revenue_summary(shop, period, basis),
        "missed_by_category": missed.missed_revenue_by_category(shop, period, basis),
        "top_declined_jobs": missed.top_declined_jobs(shop, period, basis, job_limit),
    }
