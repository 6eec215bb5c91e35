"""Render silver rows as the landed JSON documents (order pages, employee
pages, job documents).

Used to land test data and to round-trip the ingest path: the text these
functions produce is exactly what ``landed.read_json`` reads from files.
It renders test data only: a page holds at most ``page_size`` orders, but a
job document holds all lines of its job, however many the data has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.sources.silver import Shop

# Fixed value: orders per landed page.
PAGE_SIZE = 100


def _bool(c: str):
    return F.when(F.col(c).isNull(), F.lit(None).cast("boolean")).otherwise(F.col(c) == 1)


def order_structs(shop: Shop) -> DataFrame:
    """One nested order struct per order, with its job summaries."""
    summaries = shop.jobs.groupBy("repair_order_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("name")))).alias("jobs"))
    ro = shop.repair_orders.join(summaries, shop.repair_orders["id"] == summaries["repair_order_id"],
                                 "left")
    status = F.when(F.col("status_name").isNotNull() | F.col("status_id").isNotNull(),
                    F.struct(F.col("status_id").alias("id"), F.col("status_code").alias("code"),
                             F.col("status_name").alias("name")))
    label = F.struct(F.col("label_code").alias("code"), F.col("label_name").alias("name"))
    return ro.select(F.col("id"), F.struct(
        F.col("id").alias("id"), F.col("repair_order_number").alias("repairOrderNumber"),
        F.col("shop_id").alias("shopId"), status.alias("repairOrderStatus"),
        label.alias("repairOrderLabel"),
        F.col("appointment_start_time").alias("appointmentStartTime"),
        F.col("customer_id").alias("customerId"), F.col("vehicle_id").alias("vehicleId"),
        F.col("technician_id").alias("technicianId"),
        F.col("service_writer_id").alias("serviceWriterId"),
        F.col("miles_in").alias("milesIn"), F.col("miles_out").alias("milesOut"),
        F.col("completed_date").alias("completedDate"), F.col("posted_date").alias("postedDate"),
        F.col("created_date").alias("createdDate"), F.col("updated_date").alias("updatedDate"),
        F.col("labor_sales").alias("laborSales"), F.col("parts_sales").alias("partsSales"),
        F.col("sublet_sales").alias("subletSales"),
        F.col("discount_total").alias("discountTotal"), F.col("fee_total").alias("feeTotal"),
        F.col("taxes").alias("taxes"), F.col("total_sales").alias("totalSales"),
        F.col("jobs").alias("jobs")).alias("o"))


def order_pages_text(shop: Shop, orders: DataFrame | None = None,
                     page_size: int = PAGE_SIZE) -> DataFrame:
    """Order pages as JSON text (column ``value``); page = id div page_size."""
    o = order_structs(shop) if orders is None else orders
    total = o.agg(F.count(F.lit(1))).scalar()
    pages = o.groupBy(F.call_function("div", F.col("id"), F.lit(page_size)).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("id", "o"))).alias("c"))
    doc = F.struct(F.col("c.o").alias("content"), total.alias("totalElements"),
                   F.ceil(total / F.lit(float(page_size))).cast("int").alias("totalPages"))
    return pages.select(F.to_json(doc).alias("value"))


def employee_pages_text(shop: Shop, page_size: int = PAGE_SIZE) -> DataFrame:
    e = shop.employees
    total = e.agg(F.count(F.lit(1))).scalar()
    role = F.when(F.col("role_id").isNotNull() | F.col("role_name").isNotNull(),
                  F.struct(F.col("role_id").alias("id"), F.col("role_name").alias("name")))
    emp = e.select("id", F.struct(
        F.col("id").alias("id"), F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"), role.alias("employeeRole"),
        F.col("updated_date").alias("updatedDate")).alias("e"))
    pages = emp.groupBy(F.call_function("div", F.col("id"), F.lit(page_size)).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("id", "e"))).alias("c"))
    doc = F.struct(F.col("c.e").alias("content"), total.alias("totalElements"),
                   F.ceil(total / F.lit(float(page_size))).cast("int").alias("totalPages"))
    return pages.select(F.to_json(doc).alias("value"))


def job_documents_text(shop: Shop) -> DataFrame:
    """One JSON document per job with its labor and parts arrays."""
    labor = shop.labor_lines.groupBy("job_id").agg(F.collect_list(F.struct(
        F.col("id").alias("id"), F.col("name").alias("name"), F.col("rate").alias("rate"),
        F.col("hours").alias("hours"), _bool("complete").alias("complete"),
        F.col("technician_id").alias("technicianId"))).alias("labor"))
    parts = shop.parts.groupBy("job_id").agg(F.collect_list(F.struct(
        F.col("id").alias("id"), F.col("quantity").alias("quantity"),
        F.col("brand").alias("brand"), F.col("name").alias("name"),
        F.col("part_number").alias("partNumber"), F.col("description").alias("description"),
        F.col("cost").alias("cost"), F.col("retail").alias("retail"))).alias("parts"))
    j = (shop.jobs.join(labor, shop.jobs["id"] == labor["job_id"], "left").drop("job_id")
         .join(parts, shop.jobs["id"] == parts["job_id"], "left").drop("job_id"))
    doc = F.struct(
        F.col("id").alias("id"), F.col("repair_order_id").alias("repairOrderId"),
        F.col("vehicle_id").alias("vehicleId"), F.col("customer_id").alias("customerId"),
        F.col("name").alias("name"), _bool("authorized").alias("authorized"),
        F.col("authorized_date").alias("authorizedDate"), _bool("selected").alias("selected"),
        F.col("technician_id").alias("technicianId"), F.col("note").alias("note"),
        F.col("job_category_name").alias("jobCategoryName"),
        F.col("parts_total").alias("partsTotal"), F.col("labor_total").alias("laborTotal"),
        F.col("discount_total").alias("discountTotal"), F.col("fee_total").alias("feeTotal"),
        F.col("subtotal").alias("subtotal"), _bool("archived").alias("archived"),
        F.col("created_date").alias("createdDate"), F.col("updated_date").alias("updatedDate"),
        F.col("completed_date").alias("completedDate"), F.col("labor_hours").alias("laborHours"),
        F.col("labor").alias("labor"), F.col("parts").alias("parts"))
    return j.select(F.to_json(doc).alias("value"))


def _with_gaps(doc, fields, at):
    """``doc`` as JSON: of three neighbours one has ``fields`` as explicit
    nulls, one lacks them, and one has their values."""
    none = doc
    for f in fields:
        none = none.withField(f, F.lit(None).cast("bigint"))
    return (F.when(at % 3 == 0, F.to_json(none, {"ignoreNullFields": "false"}))
            .when(at % 3 == 1, F.to_json(none)).otherwise(F.to_json(doc)))


def orders_text_with_gaps(shop: Shop) -> DataFrame:
    """A page per order, some amounts as explicit nulls or absent."""
    o = order_structs(shop)
    doc = _with_gaps(F.col("o"), ["laborSales", "feeTotal"], F.col("id"))
    return o.select(F.concat(F.lit('{"content": ['), doc, F.lit("]}")).alias("value"))


def jobs_text_with_gaps(shop: Shop) -> DataFrame:
    """Job documents with some amounts as explicit nulls or absent, of the job and of its parts."""
    parts = shop.parts.select("job_id", _with_gaps(F.struct(
        "id", "quantity", "cost", "retail"), ["quantity", "cost"], F.col("id")).alias("part"))
    parts = parts.groupBy("job_id").agg(F.array_join(F.collect_list("part"), ", ").alias("parts"))
    j = shop.jobs.join(parts, shop.jobs["id"] == parts["job_id"], "left")
    doc = _with_gaps(F.struct("id", F.col("repair_order_id").alias("repairOrderId"), F.col("labor_hours").alias("laborHours"),
                              F.col("subtotal").alias("subtotal")), ["laborHours", "subtotal"], F.col("id"))
    return j.select(F.concat(F.substring_index(doc, "}", 1), F.lit(', "parts": ['), F.coalesce("parts", F.lit("")),
                             F.lit("]}")).alias("value"))
