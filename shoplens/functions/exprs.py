"""Reusable column expressions (all JVM-side, codegen friendly).

Money is LONG cents through every sum and becomes DOUBLE dollars once, at
the end, through :func:`dollars`.  Ratios are guarded with ``when`` so ANSI
mode never raises on a zero denominator.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.params import Period

ISO_DAY = "yyyy-MM-dd"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dollars(c) -> Column:
    """Cents -> dollars as DOUBLE; NULL counts as 0 (Python float literal is
    a DOUBLE literal, so no DECIMAL arithmetic sneaks in)."""
    return F.coalesce(col(c), F.lit(0)).cast("double") / F.lit(100.0)


def sum_cents(c) -> Column:
    """SUM of a cents column, 0 when empty."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("long")


def safe_div(num, den, otherwise=0.0) -> Column:
    """num / den, or ``otherwise`` (NULL when None) when den is 0 or NULL.

    ``try_divide`` yields NULL for a zero divisor, so the denominator is
    referenced once (it may be a scalar subquery: it then runs once)."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return q if otherwise is None else F.coalesce(q, F.lit(float(otherwise)))


def pct(num, den, otherwise=0.0) -> Column:
    """num / den * 100 with the same guard as :func:`safe_div`."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double")) * F.lit(100.0)
    return q if otherwise is None else F.coalesce(q, F.lit(float(otherwise)))


def parse_day(raw) -> Column:
    """First ten characters of an ISO text as a DATE; NULL when malformed
    (``08/09/2025`` and the like never raise)."""
    return F.try_to_date(F.substring(col(raw), 1, 10), ISO_DAY)


def in_period(day_col, period: Period) -> Column:
    """Inclusive calendar-day predicate on a DATE column (NULL drops).
    Date literals keep the predicate pushable to the Parquet scan."""
    return col(day_col).between(F.lit(period.start), F.lit(period.end))


#: Partition columns that the large tables may have: year * 100 + month, or the year, of the posted day.
MONTH_PARTITION, YEAR_PARTITION = "posted_month", "posted_year"


def month_number(day) -> Column:
    return F.year(col(day)) * 100 + F.month(col(day))


def period_rows(df: DataFrame, day: str, period: Period) -> DataFrame:
    """Rows whose day column lies in the period.  On the posted basis the month
    or year partitions are restricted too, where the table has them."""
    df = df.filter(in_period(day, period))
    if day != "posted_day":
        return df
    ends = (period.start, period.end)
    if MONTH_PARTITION in df.columns:
        df = df.filter(F.col(MONTH_PARTITION).between(*[F.lit(d.year * 100 + d.month) for d in ends]))
    if YEAR_PARTITION in df.columns:
        df = df.filter(F.col(YEAR_PARTITION).between(*[F.lit(d.year) for d in ends]))
    return df


def on_or_after(day_col, day: _dt.date) -> Column:
    return col(day_col) >= F.lit(day)


def week_start(day_col) -> Column:
    """Monday on or before the day (ISO week start)."""
    d = col(day_col)
    return F.date_sub(d, F.weekday(d))


def day_text(day_col) -> Column:
    return F.date_format(col(day_col), ISO_DAY)


def month_text(day_col) -> Column:
    return F.date_format(col(day_col), "yyyy-MM")


def category_label(c="job_category_name") -> Column:
    """Trimmed category; empty or NULL -> 'Uncategorized' (case kept)."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("Uncategorized"))


def display_name(first="first_name", last="last_name") -> Column:
    """trim(first || ' ' || last) with NULL parts as ''."""
    return F.trim(F.concat(F.coalesce(col(first), F.lit("")), F.lit(" "),
                           F.coalesce(col(last), F.lit(""))))


def default_if_blank(c, label: str) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(label))


def role_is(role_col, role: str) -> Column:
    """Case-insensitive role match; NULL role matches nothing."""
    return F.lower(F.coalesce(col(role_col), F.lit(""))) == F.lit(role.lower())


def not_archived(c="archived") -> Column:
    return col(c).isNull() | (col(c) == 0)


def sold(authorized="authorized", archived="archived") -> Column:
    return (col(authorized) == 1) & not_archived(archived)


def declined(authorized="authorized", archived="archived") -> Column:
    return (col(authorized) == 0) & not_archived(archived)


def flag01(c) -> Column:
    """JSON truthiness -> 0/1; NULL or absent -> 0."""
    return F.coalesce(col(c).cast("boolean"), F.lit(False)).cast("int")


def rebuilt_total_cents(labor, parts, sublet, fees, taxes, discounts) -> Column:
    return (col(labor) + col(parts) + col(sublet) + col(fees) + col(taxes) - col(discounts))


def normalized_total_cents(total, rebuilt) -> Column:
    """Reported total when positive, else the rebuilt total floored at 0."""
    return F.when(col(total) > 0, col(total)).otherwise(F.greatest(col(rebuilt), F.lit(0)))


def change_pct(cur, prev) -> Column:
    """(cur - prev) / |prev| * 100; NULL when prev is 0 or NULL."""
    c, p = col(cur).cast("double"), col(prev).cast("double")
    return F.when(p.isNotNull() & (p != 0), (c - p) / F.abs(p) * F.lit(100.0))


def change_class(c) -> Column:
    x = col(c)
    return F.when(x.isNull(), F.lit("none")).when(x >= 0, F.lit("good")).otherwise(F.lit("bad"))
