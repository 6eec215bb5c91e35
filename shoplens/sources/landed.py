"""Landed JSON documents -> flat silver rows (bronze to silver).

* order pages    ``{content: [order], totalElements, totalPages}``
* employee pages ``{content: [employee], ...}``
* job documents  one job with ``labor[]`` and ``parts[]``

Reading always uses the declared schema.  Flattening rules:
nested objects become columns (an absent object gives NULLs), booleans
become 0/1 with NULL/absent -> 0, amounts default to 0 where their *key* is
absent while an explicit JSON null stays NULL (:func:`amount`),
``explode`` skips NULL / empty arrays (a job whose ``labor`` is JSON null
simply has no labor rows), and job stubs without an id (or id 0) are
skipped.  ``synced_at`` is added by :func:`stamp`, separately, so the flat
rows stay deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.params import Period
from shoplens.sources import schemas as S


def amount(value: Column, kind: str) -> Column:
    """0 for an absent key, NULL for an explicit JSON null, else the value as ``kind``."""
    return F.when(value.isNull(), F.lit(0).cast(kind)).otherwise(F.try_variant_get(value, "$", kind))


def readable(value: Column, kind: str) -> Column:
    """Whether :func:`amount` says all that the document says (no other type, no fraction of a cent)."""
    exact = F.try_variant_get(value, "$", "double" if kind == "double" else "decimal(38,6)")
    same = F.lit(True) if kind == "double" else exact == F.try_variant_get(value, "$", kind)
    return value.isNull() | F.is_variant_null(value) | F.coalesce(exact.isNotNull() & same, F.lit(False))


def _all_readable(record: Column | None, kinds: dict[str, str]) -> Column:
    ok = F.lit(True)
    for name, kind in kinds.items():
        ok = ok & readable(F.col(name) if record is None else record[name], kind)
    return ok


def read_json(spark: SparkSession, path: str, schema, multi_line: bool = False, with_time: bool = False) -> DataFrame:
    """Typed read of landed documents.  Malformed lines keep their raw text
    in ``_corrupt_record`` (PERMISSIVE) instead of failing the job;
    ``with_time`` adds the landing time of the file as ``_landed_at``."""
    from pyspark.sql import types as T
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    if with_time:
        lines = spark.read.text(path, wholetext=multi_line).select(
            "value", F.col("_metadata.file_modification_time").alias("_landed_at")).filter("trim(value) <> ''")
        parsed = F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        return lines.select(parsed.alias("d"), "_landed_at").select("d.*", "_landed_at")
    return (spark.read.schema(with_corrupt).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("multiLine", str(multi_line).lower()).json(path))


def parse_text(text: DataFrame, schema, column: str = "value") -> DataFrame:
    """Parse a column of JSON text with the declared schema (same result as
    :func:`read_json` on files holding that text)."""
    return text.select(F.from_json(F.col(column), schema).alias("d")).select("d.*")


def _amounts(kinds: dict[str, str], names: list[str]) -> list[Column]:
    return [amount(F.col(c), kinds[c]).alias(n) for c, n in zip(kinds, names)]


def _no_reason(*reasons: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for test, text in reversed(reasons):
        out = F.when(test, F.lit(text)).otherwise(out)
    return out


def flatten_orders(pages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """A1 + B14 + B16: one row per order in the pages (with the page's columns
    ``keep``)."""
    o = pages.select(F.explode("content").alias("o"), *keep).select("o.*", *keep)
    return o.select(*keep, *_order_columns())


def _order_columns() -> list[Column]:
    return [
        F.col("id"), F.col("repairOrderNumber").alias("repair_order_number"),
        F.col("shopId").alias("shop_id"),
        F.col("repairOrderStatus.id").alias("status_id"),
        F.col("repairOrderStatus.code").alias("status_code"),
        F.col("repairOrderStatus.name").alias("status_name"),
        F.col("repairOrderLabel.code").alias("label_code"),
        F.col("repairOrderLabel.name").alias("label_name"),
        F.col("appointmentStartTime").alias("appointment_start_time"),
        F.col("customerId").alias("customer_id"), F.col("vehicleId").alias("vehicle_id"),
        F.col("technicianId").alias("technician_id"),
        F.col("serviceWriterId").alias("service_writer_id"),
        F.col("milesIn").alias("miles_in"), F.col("milesOut").alias("miles_out"),
        F.col("completedDate").alias("completed_date"), F.col("postedDate").alias("posted_date"),
        F.col("createdDate").alias("created_date"), F.col("updatedDate").alias("updated_date"),
        *_amounts(S.ORDER_AMOUNTS, ["labor_sales", "parts_sales", "sublet_sales", "discount_total", "fee_total", "taxes",
                                    "total_sales"])]


# ------------------------------------------------------------------ log rows
def _records(pages: DataFrame, keep: list[str]) -> DataFrame:
    """A row per record `o` of the pages, with the page's landing time, and one
    for a page without any (unreadable text, no records): one pass over them."""
    corrupt = F.col("_corrupt_record") if "_corrupt_record" in pages.columns else F.lit(None).cast("string")
    at = F.col(S.LANDED_AT) if S.LANDED_AT in pages.columns else F.lit(None).cast("timestamp")
    content = F.when(corrupt.isNull(), F.col("content"))
    return pages.select(F.explode_outer(content).alias("o"), at.alias(S.LANDED_AT), corrupt.alias("_page_text"), *keep)


def _entry(without_id: Column, bad_amount: Column, record: Column) -> list[Column]:
    """The reason why a record cannot be stored, and its text."""
    reason = _no_reason((F.col("_page_text").isNotNull(), "unreadable"), (record.isNull(), "no records"),
                        (without_id, "no id"), (bad_amount, "unreadable amount"))
    text = F.coalesce("_page_text", F.when(reason.isNotNull(), F.to_json(record)))
    return [F.col(S.LANDED_AT), reason.alias(S.REASON), text.alias(S.TEXT)]


def order_entries(pages: DataFrame) -> DataFrame:
    """Log rows of order pages: the flat order with the ids of the jobs it
    mentions and its page; or the reason why there is none."""
    o = _records(pages, ["number", "totalPages"])
    mentions = F.filter(F.transform("jobs", lambda j: j["id"]), lambda i: i.isNotNull() & (i != 0))
    return (o.select("o.*", F.col("number").alias("page"), F.col("totalPages").alias("pages"),
                     *_entry(F.col("o.id").isNull(), ~_all_readable(F.col("o"), S.ORDER_AMOUNTS), F.col("o")))
            .select(*_order_columns(), S.LANDED_AT, S.REASON, S.TEXT, mentions.alias("mentions"), "page", "pages"))


def employee_entries(pages: DataFrame) -> DataFrame:
    """Log rows of employee pages."""
    e = _records(pages, [])
    return (e.select("o.*", *_entry(F.col("o.id").isNull(), F.lit(False), F.col("o")))
            .select(*_employee_columns(), S.LANDED_AT, S.REASON, S.TEXT))


def job_entries(docs: DataFrame) -> DataFrame:
    """Log rows of job documents: the flat job with its flat labor lines and
    parts in one row, so that a job is stored whole or not at all."""
    corrupt = F.col("_corrupt_record") if "_corrupt_record" in docs.columns else F.lit(None).cast("string")
    at = F.col(S.LANDED_AT) if S.LANDED_AT in docs.columns else F.lit(None).cast("timestamp")
    bad = ~(_all_readable(None, S.JOB_AMOUNTS)
            & F.coalesce(F.forall("labor", lambda x: _all_readable(x, S.LABOR_AMOUNTS)), F.lit(True))
            & F.coalesce(F.forall("parts", lambda x: _all_readable(x, S.PART_AMOUNTS)), F.lit(True)))
    reason = _no_reason((corrupt.isNotNull(), "unreadable"), (F.col("id").isNull(), "no id"), (bad, "unreadable amount"))
    own = F.struct(*[c for c in docs.columns if c not in (S.LANDED_AT, "_corrupt_record")])
    text = F.coalesce(corrupt, F.when(reason.isNotNull(), F.to_json(own)))
    return docs.select(*_job_columns(), _labor_rows().alias("labor"), _part_rows().alias("parts"),
                       at.alias(S.LANDED_AT), reason.alias(S.REASON), text.alias(S.TEXT))


def with_order_days(orders: DataFrame) -> DataFrame:
    """Silver adds parsed DATE columns next to the raw ISO text."""
    return orders.select("*", *[X.parse_day(c.replace("_day", "_date")).alias(c)
                                for c in S.ORDER_DAY_COLUMNS])


def order_job_summaries(pages: DataFrame) -> DataFrame:
    """(order, job id) pairs from the orders' ``jobs`` arrays; orders
    without jobs and stubs without a (truthy) id are skipped."""
    o = pages.select(F.explode("content").alias("o"))
    j = o.select(F.col("o.id").alias("repair_order_id"),
                 F.col("o.repairOrderNumber").alias("repair_order_number"),
                 F.explode("o.jobs").alias("j"))
    return (j.select("repair_order_id", "repair_order_number", F.col("j.id").alias("job_id"))
            .filter(F.col("job_id").isNotNull() & (F.col("job_id") != 0)))


def flatten_employees(pages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """A2: every employee in every page (no 100-row cap)."""
    e = pages.select(F.explode("content").alias("e"), *keep).select("e.*", *keep)
    return e.select(*keep, *_employee_columns())


def _employee_columns() -> list[Column]:
    return [F.col("id"), F.col("firstName").alias("first_name"), F.col("lastName").alias("last_name"),
            F.col("employeeRole.id").alias("role_id"), F.col("employeeRole.name").alias("role_name"),
            F.col("updatedDate").alias("updated_date")]


def flatten_jobs(docs: DataFrame) -> DataFrame:
    """A3 + B15 + B16: one row per job document with an id."""
    return docs.filter(F.col("id").isNotNull()).select(*_job_columns())


def _job_columns() -> list[Column]:
    sums = _amounts(S.JOB_AMOUNTS, ["parts_total", "labor_total", "discount_total", "fee_total", "subtotal", "labor_hours"])
    return [
        F.col("id"), F.col("repairOrderId").alias("repair_order_id"),
        F.col("vehicleId").alias("vehicle_id"), F.col("customerId").alias("customer_id"),
        F.col("name"), X.flag01("authorized").alias("authorized"),
        F.col("authorizedDate").alias("authorized_date"), X.flag01("selected").alias("selected"),
        F.col("technicianId").alias("technician_id"), F.col("note"),
        F.col("jobCategoryName").alias("job_category_name"),
        *sums[:5], X.flag01("archived").alias("archived"),
        F.col("createdDate").alias("created_date"), F.col("updatedDate").alias("updated_date"),
        F.col("completedDate").alias("completed_date"), sums[5]]


def _line_id(line: Column, at: Column) -> Column:
    """A line's own id; without one, a stable negative key of its job, place
    and content (the same document always gives the same key)."""
    made = F.xxhash64(F.col("id"), at, F.to_json(line)).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(line["id"], -1 - made).alias("id")


def _labor_rows() -> Column:
    return F.transform("labor", lambda x, at: F.struct(
        _line_id(x, at), F.col("id").alias("job_id"), x["name"].alias("name"),
        amount(x["rate"], "bigint").alias("rate"), amount(x["hours"], "double").alias("hours"),
        X.flag01(x["complete"]).alias("complete"), x["technicianId"].alias("technician_id")))


def _part_rows() -> Column:
    return F.transform("parts", lambda x, at: F.struct(
        _line_id(x, at), F.col("id").alias("job_id"), amount(x["quantity"], "double").alias("quantity"),
        x["brand"].alias("brand"), x["name"].alias("name"), x["partNumber"].alias("part_number"),
        x["description"].alias("description"), amount(x["cost"], "bigint").alias("cost"),
        amount(x["retail"], "bigint").alias("retail")))


def flatten_labor(docs: DataFrame) -> DataFrame:
    """Labor children, keyed by line id, carrying their job id."""
    return docs.filter(F.col("id").isNotNull()).select(F.inline(_labor_rows()))


def flatten_parts(docs: DataFrame) -> DataFrame:
    """Part children, keyed by part id, carrying their job id."""
    return docs.filter(F.col("id").isNotNull()).select(F.inline(_part_rows()))


def stamp(df: DataFrame, synced_at: Column | None = None) -> DataFrame:
    """Add ``synced_at`` (ingest time, UTC) to flat rows."""
    return df.withColumn("synced_at", synced_at if synced_at is not None else F.current_timestamp())


def in_ingest_window(orders: DataFrame, window: Period) -> DataFrame:
    """A10: orders created within the ingest window (inclusive days)."""
    return orders.filter(X.in_period(X.parse_day("created_date"), window))
