"""Reports from daily rows.

Two summaries of the facts, each far smaller than they are, from which any
period is answered without touching an order or a job:

* **daily sums**: count and money of the orders per basis and day.  A table of
  them is partitioned by month; after a batch only the days that it touches
  (those its orders had before and those they have now) are summed again, and
  only their months are rewritten.
* **daily bitmaps**: the distinct ids per basis, day and key as bitmaps of
  64 ids each, one LONG a row.  Bitmaps of any days merge by OR, so distinct
  counts of any period are exact although no id is looked at again.  A row
  exists only where an id does: ids far apart cost a row each, never an empty
  stretch, and both aggregates keep 8 bytes a group.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions import exprs as X
from shoplens.functions.params import Period, basis_column
from shoplens.operators import revenue
from shoplens.session import delete_folder, path_exists, stored
from shoplens.sources.silver import Shop

BASES = ("revenue", "production", "activity")
MONEY = [f"{name}_c" for _, name in revenue.ORDER_MONEY]
SCHEMA = T.StructType([T.StructField("basis", T.StringType()), T.StructField("day", T.DateType()),
                       T.StructField("ro_count", T.LongType()), *[T.StructField(c, T.LongType()) for c in MONEY],
                       T.StructField("month", T.IntegerType())])

Day = tuple[str, _dt.date]


def _by_basis(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """A row per basis on which a row has a day: basis, day and ``columns``."""
    tags = F.array(*[F.struct(F.lit(b).alias("basis"), F.col(basis_column(b)).alias("day")) for b in BASES])
    return rows.select(F.inline(tags), *columns).filter("day is not null")


# ------------------------------------------------------------------ sums
def daily_sums(orders: DataFrame, days: list[Day] | None = None) -> DataFrame:
    """Count and money (cents) per basis and day, of all days or of some."""
    if days is not None:
        per = {b: [d for basis, d in days if basis == b] for b in BASES}
        some = F.lit(False)
        for b, ds in per.items():
            some = some | F.col(basis_column(b)).isin(ds) if ds else some
        orders = orders.filter(some)
    rows = _by_basis(orders, *[src for src, _ in revenue.ORDER_MONEY])
    if days is not None:
        wanted = F.lit(False)
        for b, ds in per.items():
            wanted = wanted | ((F.col("basis") == b) & F.col("day").isin(ds)) if ds else wanted
        rows = rows.filter(wanted)
    sums = rows.groupBy("basis", "day").agg(F.count(F.lit(1)).alias("ro_count"),
                                            *[X.sum_cents(src).alias(f"{name}_c") for src, name in revenue.ORDER_MONEY])
    return sums.withColumn("month", (F.year("day") * 100 + F.month("day")).cast("int"))


def touched_days(*orders: DataFrame) -> list[Day]:
    """The days of ``orders`` on every basis: pass a batch's orders as they were
    and as they are.  A row per calendar day at most comes to the driver."""
    out: set[Day] = set()
    for df in orders:
        out |= {(r["basis"], r["day"]) for r in _by_basis(df).distinct().collect()}
    return sorted(out)


def read_sums(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, root):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(root)


def refresh(root: str, orders: DataFrame, days: list[Day]) -> None:
    """Sum ``days`` again from ``orders`` (all of them) and rewrite their months
    of the table at ``root``; other months are not opened."""
    spark = orders.sparkSession
    if not days:
        return
    months = sorted({d.year * 100 + d.month for _, d in days})
    gone = spark.createDataFrame(days, "basis string, day date")
    other = read_sums(spark, root).filter(F.col("month").isin(months)).join(gone, ["basis", "day"], "left_anti")
    new, aside = stored(other.select(SCHEMA.names).unionByName(daily_sums(orders, days)), "daily-sums")
    left = {r["month"] for r in new.select("month").distinct().collect()}  # of the few months above
    (new.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month")
     .parquet(root))
    for month in set(months) - left:  # no order is left in it
        delete_folder(spark, f"{root}/month={month}")
    delete_folder(spark, aside)


def cube(sums: DataFrame, period: Period, basis: str = "revenue", by_day: bool = False) -> DataFrame:
    """Totals and buckets of the period, and totals of the one before it, as
    :func:`shoplens.operators.revenue.order_cube` has them, from daily sums."""
    both = Period(period.previous().start, period.end)
    months = [d.year * 100 + d.month for d in (both.start, both.end)]
    rows = sums.filter((F.col("basis") == basis) & X.in_period("day", both) & F.col("month").between(*months))
    current = X.in_period("day", period)
    text = X.day_text("day") if by_day else X.month_text("day")
    rows = rows.select(current.alias("current"), F.when(current, text).alias("bucket"), "ro_count", *MONEY)
    sets = [[F.col("current")], [F.col("current"), F.col("bucket")]]
    g = rows.groupingSets(sets, "current", "bucket").agg(
        F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ["ro_count", *MONEY]])
    level = F.when(F.col("gid") == 0, revenue.BUCKET).otherwise(revenue.TOTAL)
    return g.withColumn("level", level).drop("gid")


def revenue_report(sums: DataFrame, period: Period, basis: str = "revenue") -> DataFrame:
    """D1 from daily sums."""
    return revenue.revenue_of(cube(sums, period, basis), period, basis)


def trend_report(sums: DataFrame, period: Period, basis: str = "revenue", by_day: bool = False) -> DataFrame:
    """D2 / D3 (with D4) from daily sums."""
    return revenue.trend_of(cube(sums, period, basis, by_day), by_day)


def comparison_report(sums: DataFrame, period: Period, basis: str = "revenue") -> DataFrame:
    """E3 from daily sums."""
    return revenue.comparison_of(cube(sums, period, basis), period, basis)


# ------------------------------------------------------------------ distinct ids
#: log2 of the ids of a bitmap (a LONG).
BITMAP_SHIFT = 6


def daily_bitmaps(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Distinct ids per basis, day and key: basis, day, key, bucket, bitmap
    (bit i of the bitmap: id bucket * 64 + i)."""
    x = _by_basis(rows.filter(F.col(id_col).isNotNull()), key.alias("key"), F.col(id_col).alias("_id"))
    bit = F.expr(f"shiftleft(1L, cast(_id & {(1 << BITMAP_SHIFT) - 1} AS INT))")
    return (x.withColumn("bucket", F.shiftright("_id", BITMAP_SHIFT)).groupBy("basis", "day", "key", "bucket")
            .agg(F.bit_or(bit).alias("bitmap")))


def distinct_in(bitmaps: DataFrame, period: Period, basis: str = "revenue") -> DataFrame:
    """Exact distinct ids per key in a period, from its daily bitmaps: key, n."""
    rows = bitmaps.filter((F.col("basis") == basis) & X.in_period("day", period))
    whole = rows.groupBy("key", "bucket").agg(F.bit_or("bitmap").alias("bitmap"))
    return whole.groupBy("key").agg(F.sum(F.bit_count("bitmap").cast("long")).alias("n"))


def category_order_bitmaps(shop: Shop) -> DataFrame:
    """Orders with sold jobs per category and day."""
    return daily_bitmaps(shop.jobs.filter(X.sold()), X.category_label(), "repair_order_id")


def technician_job_bitmaps(shop: Shop) -> DataFrame:
    """Jobs with billed lines per technician and day."""
    return daily_bitmaps(shop.labor_lines.filter("technician_id is not null"), F.col("technician_id"), "job_id")
