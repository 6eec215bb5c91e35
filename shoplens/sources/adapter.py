"""Derive the five silver tables from the driver's TPC-H-ish test tables.

The driver ships orders / lineitem / supplier / part, not shop data, so the
silver tables are *derived* with integer arithmetic only (same rule in the
DuckDB oracle, see ``shoplens.plans.oracle``):

* repair_orders  <- orders (one per order; money from the order total)
* jobs           <- lineitem grouped by (l_orderkey, l_linenumber)
* labor_lines    <- one per lineitem row
* parts          <- one per lineitem row not returned and not in a PROMO job
* employees      <- supplier

Everything is expressed as DataFrame operators, and no step gathers the
lines of a hot order into a single task (see ``_lines``): they are split
across partitions by range.  The wide rows move three times (by order, by
part, by day) and are written once, in the layout of the silver tables; jobs,
labor lines and parts are then plain selections of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.session import ensure_checkpoint_dir
from shoplens.sources.landed import with_order_days
from shoplens.sources.schemas import ORDER_DAY_COLUMNS

TABLES = ("orders", "lineitem", "supplier", "part")

# Fixed values of the derivation (shared with the oracle text).
JOB_KEY_FACTOR = 8      # job_id = l_orderkey * 8 + l_linenumber (line numbers 0..7, checked)
ORDER_NUMBER_OFFSET = 1000
ZERO_TOTAL_MONTH = "1996-02"


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES}


def cents(c: Column) -> Column:
    """Round a DOUBLE money value to integer cents (half up)."""
    return F.floor(c * F.lit(100) + F.lit(0.5)).cast("long")


def idiv(a: Column, b) -> Column:
    """Integral division (``div``)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _iso(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


def employees(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    both_null = (k % 10) == 9
    first = F.when(both_null, F.lit(None)).otherwise(F.substring("s_name", 1, 8))
    last = (F.when(both_null | ((k % 7) == 6), F.lit(None))
            .otherwise(F.expr("substring(s_name, 10)")))
    role = (F.when((k % 10).isin(0, 1, 2), F.lit("Service Advisor"))
            .when((k % 10) == 3, F.lit("SERVICE ADVISOR"))
            .when((k % 10) == 8, F.lit(None))
            .otherwise(F.lit("Technician")))
    role_id = (F.when((k % 10) <= 3, F.lit(1)).when((k % 10) == 8, F.lit(None))
               .otherwise(F.lit(2))).cast("long")
    return supplier.select(
        k.cast("long").alias("id"), first.alias("first_name"), last.alias("last_name"),
        role_id.alias("role_id"), role.alias("role_name"),
        F.lit(None).cast("string").alias("updated_date"))


def repair_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.to_date(F.col("o_orderdate"))
    st = F.col("o_orderstatus")
    b = idiv(cents(F.col("o_totalprice")), 100)
    labor, parts = idiv(b * 30, 100), idiv(b * 50, 100)
    sublet, fee = idiv(b * 5, 100), idiv(b * 3, 100)
    tax, disc = idiv(b * 7, 100), idiv(b * 4, 100)
    rebuilt = labor + parts + sublet + fee + tax - disc
    total = (F.when(F.date_format(day, "yyyy-MM") == ZERO_TOTAL_MONTH, F.lit(0))
             .otherwise(rebuilt + F.when((k % 7) == 0, k % 5).otherwise(F.lit(0))))
    # created text comes in several ISO shapes plus a malformed US form
    created = (F.when((k % 97) == 0, F.date_format(day, "MM/dd/yyyy"))
               .when((k % 4) == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00")))
               .when((k % 4) == 2, F.date_format(day, "yyyy-MM-dd"))
               .otherwise(_iso(day)))
    completed = F.when(st.isin("F", "P"), _iso(F.date_add(day, 2)))
    posted = F.when(st == "F", _iso(F.date_add(day, 3)))
    status_name = (F.when(st == "F", F.lit("Posted")).when(st == "P", F.lit("Complete"))
                   .when((k % 11) == 0, F.lit(None)).otherwise(F.lit("Estimate")))
    status_code = F.upper(status_name)
    status_id = (F.when(st == "F", F.lit(5)).when(st == "P", F.lit(3))
                 .when((k % 11) == 0, F.lit(None)).otherwise(F.lit(1))).cast("long")
    return orders.select(
        k.alias("id"), (k + ORDER_NUMBER_OFFSET).alias("repair_order_number"),
        F.lit(1).cast("long").alias("shop_id"), status_id.alias("status_id"),
        status_code.alias("status_code"), status_name.alias("status_name"),
        F.substring("o_orderpriority", 1, 1).alias("label_code"),
        F.expr("substring(o_orderpriority, 3)").alias("label_name"),
        F.lit(None).cast("string").alias("appointment_start_time"),
        F.col("o_custkey").alias("customer_id"), F.col("o_custkey").alias("vehicle_id"),
        F.lit(None).cast("long").alias("technician_id"),
        (F.col("o_custkey") % 5).alias("service_writer_id"),
        F.lit(None).cast("long").alias("miles_in"), F.lit(None).cast("long").alias("miles_out"),
        completed.alias("completed_date"), posted.alias("posted_date"),
        created.alias("created_date"), _iso(day).alias("updated_date"),
        labor.alias("labor_sales"), parts.alias("parts_sales"), sublet.alias("sublet_sales"),
        disc.alias("discount_total"), fee.alias("fee_total"), tax.alias("taxes"),
        total.cast("long").alias("total_sales"))


# Order of the lines inside a job (line ids follow it) and the job key.
LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate")
JOB = ("l_orderkey", "l_linenumber")
#: Lines from which an order is numbered by range, over several tasks.
HOT_LINES = 1_000_000
ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def _staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    stage = f"{ensure_checkpoint_dir(df.sparkSession)}/shoplens-stage/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(stage)
    return df.sparkSession.read.schema(df.schema).parquet(stage)


def _offsets(parts: DataFrame, n: Column) -> DataFrame:
    """_p, _off: what the range partitions before _p hold together (a row per partition)."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.groupBy("_p").agg(n.alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))


def _order_offsets(lineitem: DataFrame) -> DataFrame:
    """Lines per order (n) and in the orders before it (before): prefix sums
    inside range partitions and over a row per partition."""
    counts = _staged(lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
                     .repartitionByRange("l_orderkey").withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("_b", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(_offsets(counts, F.sum("n")), "_p")
            .select("l_orderkey", "n", (F.col("_b") + F.col("_off")).alias("before")))


def _numbered(li: DataFrame) -> DataFrame:
    """Lines with their rank in their order (_r), whether they are their job's
    first, and the job's smallest part / supplier and its sums: one sort of the
    lines of an order."""
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *LINE_ORDER)
    job = Window.partitionBy(*JOB)
    return li.select("*", (F.row_number().over(in_order) - 1).alias("_r"),
                     (F.row_number().over(job.orderBy(*LINE_ORDER)) == 1).alias("job_first"),
                     F.min("l_partkey").over(job).alias("pk"), F.min("l_suppkey").over(job).alias("sk"),
                     F.sum("lb").over(job).alias("job_lb"), F.sum("l_quantity").over(job).alias("job_qty"))


def _numbered_by_range(li: DataFrame) -> DataFrame:
    """:func:`_numbered` of a few orders with very many lines: rows are
    range-sorted on (job, line order), so a job spans several tasks; a line's
    place is that in its partition plus the partitions before.  What is known
    per order or job is at most 9 rows an order."""
    keys = [*JOB, *LINE_ORDER]
    rows = _staged(li.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_m", ROW_BITS))
    place = F.col("_m").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("_off")
    rows = rows.join(_offsets(rows, F.count(F.lit(1))), "_p").withColumn("_g", place)
    orders = rows.groupBy("l_orderkey").agg(F.min("_g").alias("_o"))
    jobs_ = rows.groupBy(*JOB).agg(F.min("_g").alias("_f"), F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
                                   F.sum("lb").alias("job_lb"), F.sum("l_quantity").alias("job_qty"))
    return (rows.join(F.broadcast(orders), "l_orderkey").join(F.broadcast(jobs_), [*JOB])
            .withColumn("_r", F.col("_g") - F.col("_o")).withColumn("job_first", F.col("_g") == F.col("_f")))


def _lines(lineitem: DataFrame, part: DataFrame, orders: DataFrame | None = None,
           hot_lines: int = HOT_LINES) -> DataFrame:
    """Lineitem rows with their job key, the job's smallest part / supplier,
    the job's part type and the line's id: its rank among all lines, ordered
    by job and line order (so no bound on the lines of a job); on the first
    line of a job, the job's sums; the days of the order, if ``orders`` (their
    ``id`` and days) are given.

    A line's id is its rank in its order plus the lines of the orders before,
    which are prefix sums over order counts: so the lines meet once, by order.
    No step collects a hot order into one task: the (few, by their counts)
    orders of ``hot_lines`` lines and more are ranked by range instead.
    """
    offsets = _staged(_order_offsets(lineitem))
    hot = [r["l_orderkey"] for r in offsets.filter(
        (F.col("n") >= hot_lines) & F.col("l_orderkey").isNotNull()).select("l_orderkey").collect()]
    li = (lineitem.select(*JOB, *LINE_ORDER, idiv(cents(F.col("l_extendedprice")), 100).alias("lb"))
          .filter("l_orderkey is not null"))
    before = offsets.select("l_orderkey", "before")
    number = F.col("l_linenumber")
    key = F.when(number.between(0, JOB_KEY_FACTOR - 1), F.col("l_orderkey") * JOB_KEY_FACTOR + number).otherwise(
        F.raise_error(F.concat(F.lit("line number outside the job key: "), number.cast("string"))))

    def finished(rows: DataFrame, few) -> DataFrame:
        rows = rows.join(few(before), "l_orderkey")
        days = []
        if orders is not None:
            days = list(ORDER_DAY_COLUMNS)
            rows = rows.join(few(orders.select(F.col("id").alias("l_orderkey"), *days)), "l_orderkey", "left")
        return rows.filter("l_linenumber is not null").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
            key.cast("long").alias("job_id"), "lb", "pk", "sk", (F.col("_r") + F.col("before")).alias("line_id"),
            "job_first", *[F.when(F.col("job_first"), F.col(c)).alias(c) for c in ("job_lb", "job_qty")], *days)

    is_hot = F.col("l_orderkey").isin(hot)
    out = finished(_numbered(li.filter(~is_hot) if hot else li), lambda d: d)
    if hot:
        out = out.unionByName(finished(_numbered_by_range(li.filter(is_hot)), lambda d: F.broadcast(d.filter(is_hot))))
    # one row a part, so that a part that comes twice doubles the lines but not the jobs
    types = part.groupBy(F.col("p_partkey").alias("pk")).agg(F.collect_list(F.struct("p_type", "p_name")).alias("_t"))
    out = out.join(types, "pk", "inner").select(
        "*", F.size("_t").alias("_times"), F.posexplode("_t").alias("_at", "_part"))
    first = F.col("job_first") & (F.col("_at") == 0)
    return out.select(*[c for c in out.columns if c not in ("_t", "_times", "_at", "_part", "job_first", "job_lb", "job_qty")],
                      first.alias("job_first"),
                      *[F.when(first, F.col(c) * F.col("_times")).alias(c) for c in ("job_lb", "job_qty")],
                      F.col("_part.p_type").alias("p_type"), F.when(first, F.col("_part.p_name")).alias("p_name"))


def _category() -> Column:
    jid = F.col("job_id")
    return (F.when(jid % 23 == 0, F.lit("Courtesy"))
            .when(jid % 13 == 0, F.lit("  "))
            .when(jid % 17 == 0, F.lit(None))
            .when(jid % 5 == 0, F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")))
            .otherwise(F.col("p_type")))


def _kept(lines: DataFrame) -> list[str]:
    """The days and partition columns that lines carry over."""
    return [c for c in (*ORDER_DAY_COLUMNS, X.MONTH_PARTITION, X.YEAR_PARTITION) if c in lines.columns]


def jobs(lines: DataFrame) -> DataFrame:
    """A row per job, from the job's first line."""
    jid = F.col("id")
    ptype = F.col("p_type")
    courtesy = F.col("job_category_name") == "Courtesy"
    lb = F.col("lb")
    labor_total = idiv(lb * 60, 100)
    authorized = (F.when(ptype == "STANDARD", F.when(jid % 5 >= 3, 1).otherwise(0))
                  .otherwise(F.when(jid % (F.length(ptype) % 4 + 2) == 0, 0).otherwise(1)))
    base = lines.filter("job_first").select(
        F.col("job_id").alias("id"), F.col("l_orderkey").alias("repair_order_id"), "p_type", "p_name", "sk",
        F.col("job_lb").alias("lb"), F.col("job_qty").alias("qty"), _category().alias("job_category_name"), *_kept(lines))
    zero_if_courtesy = lambda c: F.when(courtesy, F.lit(0)).otherwise(c).cast("long")
    return base.select(
        "id", "repair_order_id",
        F.lit(None).cast("long").alias("vehicle_id"), F.lit(None).cast("long").alias("customer_id"),
        F.col("p_name").alias("name"),
        authorized.cast("int").alias("authorized"),
        F.lit(None).cast("string").alias("authorized_date"),
        authorized.cast("int").alias("selected"),
        F.when(jid % 6 == 0, F.lit(None)).otherwise(F.col("sk")).cast("long").alias("technician_id"),
        F.lit(None).cast("string").alias("note"),
        "job_category_name",
        zero_if_courtesy(lb - labor_total).alias("parts_total"),
        zero_if_courtesy(labor_total).alias("labor_total"),
        zero_if_courtesy(idiv(lb * 3, 100)).alias("discount_total"),
        F.lit(0).cast("long").alias("fee_total"),
        zero_if_courtesy(lb - idiv(lb * 3, 100)).alias("subtotal"),
        F.when(jid % 3 == 0, F.lit(None)).when(jid % 19 == 0, F.lit(1)).otherwise(F.lit(0))
        .cast("int").alias("archived"),
        F.lit(None).cast("string").alias("created_date"),
        F.lit(None).cast("string").alias("updated_date"),
        F.lit(None).cast("string").alias("completed_date"),
        (F.col("qty") / F.lit(16.0)).alias("labor_hours"), *_kept(lines))


def labor_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("line_id").alias("id"), "job_id",
        F.lit(None).cast("string").alias("name"),
        (F.lit(8500) + (F.col("l_suppkey") % 5) * 1000 + (F.col("l_partkey") % 50) * 20)
        .cast("long").alias("rate"),
        (F.col("l_quantity") / F.lit(16.0)).alias("hours"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).cast("int").alias("complete"),
        F.col("l_suppkey").alias("technician_id"), F.col("l_orderkey").alias("repair_order_id"), *_kept(lines))


def parts(lines: DataFrame) -> DataFrame:
    qty = F.col("l_quantity").cast("long")
    keep = (F.col("l_returnflag") != "R") & (
        F.coalesce(F.trim(_category()), F.lit("")) != "PROMO")
    return lines.filter(keep).select(
        F.col("line_id").alias("id"), "job_id",
        F.col("l_quantity").alias("quantity"),
        F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("name"),
        F.col("l_partkey").cast("string").alias("part_number"),
        F.lit(None).cast("string").alias("description"),
        idiv(F.col("lb") * 6 * F.length("p_type"), qty * 100).alias("cost"),
        idiv(F.col("lb"), qty).alias("retail"), F.col("l_orderkey").alias("repair_order_id"), *_kept(lines))


#: Test tables that a silver table (and the lines of three of them) comes from.
LINES = "lines"
FROM_LINES = {"jobs": jobs, "labor_lines": labor_lines, "parts": parts}


def order_days(orders: DataFrame) -> DataFrame:
    """Id and days of the orders."""
    return with_order_days(repair_orders(orders)).select("id", *ORDER_DAY_COLUMNS)


def write_orders(orders: DataFrame, path: str, unit: str, value: Column) -> None:
    """Repair orders in the silver layout; the few columns they come from are
    what moves, the wide rows are made after."""
    status = F.col("o_orderstatus") == "F"
    posted = F.when(status, X.parse_day(_iso(F.date_add(F.to_date("o_orderdate"), 3))))
    dealt = orders.withColumn("posted_day", posted).withColumn("_unit", value).drop("posted_day").hint("rebalance", F.col("_unit"))
    rows = with_order_days(repair_orders(dealt)).withColumn(unit, value)
    (rows.sortWithinPartitions(unit, "posted_day", "created_day").write.option("compression", "zstd")
     .partitionBy(unit).parquet(path))


def write_lines(tables: dict[str, DataFrame], path: str, unit: str, value: Column) -> None:
    """The lines with all that jobs, labor lines and parts need, in the silver layout."""
    lines = _lines(tables["lineitem"], tables["part"], order_days(tables["orders"]))
    rows = (lines.drop("l_linenumber", "pk").withColumn("sk", F.when(F.col("job_first"), F.col("sk")))
            .withColumn(unit, value).hint("rebalance", F.col(unit)))
    (rows.sortWithinPartitions(unit, "posted_day", "created_day").write.option("compression", "zstd")
     .partitionBy(unit).parquet(path))


def write_from_lines(spark: SparkSession, name: str, lines_path: str, path: str, unit: str, columns: list[str]) -> None:
    """A table that is a selection of the lines: their layout is its layout, nothing moves."""
    rows = FROM_LINES[name](spark.read.parquet(lines_path)).select(*columns, unit)
    (rows.sortWithinPartitions(unit, "posted_day", "created_day").write.option("compression", "zstd")
     .partitionBy(unit).parquet(path))
