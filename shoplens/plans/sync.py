"""K4: one full sync run in batch form (employees, then orders, then jobs),
with its result.

Landed folders hold whatever the last fetch wrote: employee pages, order
pages and job documents.  The run takes the orders of the ingest window (the
previous 12 months), the job documents that these orders mention and that are
not stored yet, and all employees, and logs them as the batch ``run_id`` of the
stream ``run``: a repeated run id writes its own batch again, and runs may come
in any order.  Each landed folder is read once; counts of that pass come from
``Observation`` metrics, everything else from the batch just written.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.params import Period, ingest_window
from shoplens.operators import upsert
from shoplens.sources import landed
from shoplens.sources import schemas as S
from shoplens.sources.silver import Shop
from shoplens.streaming import ingest_stream as ST

SOURCE = "run"


@dataclass
class SyncResult:
    """``stats``: one row of counts (jobs found / synced / skipped / failed,
    employees and orders synced, pages missing); ``errors``: the first failures."""
    stats: DataFrame
    errors: DataFrame
    started_at: _dt.datetime
    finished_at: _dt.datetime


def _orders_in(pages: DataFrame, window: Period) -> DataFrame:
    """Order pages with only the orders created in the window (orders without
    an id stay, for the rejects)."""
    day = lambda o: F.try_to_date(F.substring(o["createdDate"], 1, 10), "yyyy-MM-dd")
    inside = lambda o: F.coalesce(day(o).between(F.lit(window.start), F.lit(window.end)), F.lit(False)) | o["id"].isNull()
    return pages.withColumn("content", F.filter("content", inside))


def _observed(rows: DataFrame, root: str, table: str, run_id: int) -> int:
    """Log the rows; the number of them that could be stored, counted by the write itself."""
    seen = Observation()
    rows = rows.observe(seen, F.count_if(F.col(S.REASON).isNull()).alias("stored"))
    ST.append(rows, root, table, SOURCE, run_id)
    return seen.get["stored"]


def missing_pages(entries: DataFrame) -> DataFrame:
    """A1: pages (from 0) of a landed sequence that are not there, by the
    largest `pages` any of them tells; pages that tell no number count as the
    missing ones in order."""
    spark = entries.sparkSession
    told = entries.agg(F.max("pages").alias("pages"), F.count_if(F.col("page").isNull() & F.col("pages").isNotNull())
                       .alias("unnumbered")).first()
    if not told["pages"]:
        return spark.createDataFrame([], "page long")
    there = entries.select(F.col("page").cast("long").alias("page")).filter("page is not null").distinct()
    if told["unnumbered"]:
        return spark.createDataFrame([], "page long")  # the sequence cannot be told
    return spark.range(told["pages"]).select(F.col("id").alias("page")).join(there, "page", "left_anti")


def run_full_sync(spark: SparkSession, landing_root: str, table_root: str, run_id: int, as_of=None) -> SyncResult:
    started = _dt.datetime.now(_dt.timezone.utc)
    window = ingest_window(as_of if as_of is not None else started.date())
    read = lambda name, schema: landed.read_json(spark, f"{landing_root}/{name}", schema, with_time=True)
    own = lambda table: ST.log(spark, table_root, table, f"stream={SOURCE}/batch={int(run_id)}")

    employees = _observed(landed.employee_entries(read("employee_pages", S.EMPLOYEE_PAGE)), table_root, "employees", run_id)
    orders = _observed(landed.order_entries(_orders_in(read("order_pages", S.ORDER_PAGE), window)), table_root,
                       "repair_orders", run_id)
    logged = own("repair_orders")
    summaries = logged.filter(F.col(S.REASON).isNull()).select(
        F.col("id").alias("repair_order_id"), "repair_order_number", F.explode("mentions").alias("job_id"))

    # what was stored before this run; what its batch held when it was tried before does not count
    known = ST.job_ids(spark, table_root, f"stream={SOURCE}/batch={int(run_id)}")
    flags = (summaries.select(F.col("job_id").alias("id")).distinct().join(known, "id", "left_anti")
             .withColumn("_asked", F.lit(True)))
    documents = landed.job_entries(read("job_documents", S.JOB))
    # documents of other jobs are not part of this run; unreadable and id-less ones are rejects of it
    kept = documents.join(flags, "id", "left").filter(
        F.col("_asked") | F.col("id").isNull() | (F.col(S.REASON) == "unreadable")).drop("_asked")
    ST.append(kept, table_root, "jobs", SOURCE, run_id)

    fetched = own("jobs").filter(F.col(S.REASON).isNull()).select("id").distinct()
    gaps = missing_pages(logged)
    stats = (upsert.ingest_stats(summaries, known, fetched)
             .select("*", F.lit(employees).alias("employees_synced"), F.lit(orders).alias("orders_synced"),
                     gaps.agg(F.count("*")).scalar().alias("pages_missing")))
    lost = gaps.orderBy("page").limit(upsert.ERROR_LIMIT).select(
        F.lit(None).cast("long").alias("repair_order"), F.lit(None).cast("long").alias("job_id"),
        F.concat(F.lit("order page "), F.col("page"), F.lit(" is missing")).alias("error"))
    errors = lost.unionByName(upsert.ingest_errors(summaries, known, fetched)).limit(upsert.ERROR_LIMIT)
    # both read the tables as they are before the merge
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # one row
    errors = spark.createDataFrame(errors.collect(), errors.schema)  # at most 25 rows
    ST.merge_log(spark, table_root)
    return SyncResult(stats, errors, started, _dt.datetime.now(_dt.timezone.utc))


def refine(spark: SparkSession, table_root: str, silver_root: str) -> Shop:
    """The published tables as silver tables: parsed day columns, the ingest
    time, and the layout that reports read.  Returns them opened."""
    t = ST.published(spark, table_root)
    full = {n: landed.stamp(t[n]) for n in ST.TABLES}
    full["repair_orders"] = landed.with_order_days(full["repair_orders"])
    Shop.of(full).write(silver_root)
    return Shop.read(spark, silver_root)
