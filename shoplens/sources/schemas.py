"""Declared schemas: bronze JSON documents and the five silver tables.

Reading landed JSON always goes through these schemas (no inference), so a
malformed file can never change a column's type.
"""

from pyspark.sql import types as T

L, I, S, D, TS, B = (T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(),
                     T.TimestampType(), T.BooleanType())


# A field whose default depends on whether its key is there: a variant keeps
# the JSON null that a typed read would take for an absent key.
V = T.VariantType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---------------------------------------------------------------- bronze
ORDER_STATUS = _struct(("id", L), ("code", S), ("name", S))
ORDER_LABEL = _struct(("code", S), ("name", S))
JOB_SUMMARY = _struct(("id", L), ("name", S))

ORDER = _struct(
    ("id", L), ("repairOrderNumber", L), ("shopId", L),
    ("repairOrderStatus", ORDER_STATUS), ("repairOrderLabel", ORDER_LABEL),
    ("appointmentStartTime", S), ("customerId", L), ("vehicleId", L),
    ("technicianId", L), ("serviceWriterId", L), ("milesIn", L), ("milesOut", L),
    ("completedDate", S), ("postedDate", S), ("createdDate", S), ("updatedDate", S),
    ("laborSales", V), ("partsSales", V), ("subletSales", V), ("discountTotal", V),
    ("feeTotal", V), ("taxes", V), ("totalSales", V),
    ("jobs", T.ArrayType(JOB_SUMMARY)),
)

# `number`: the page's place in its sequence, from 0 (not all sources tell)
ORDER_PAGE = _struct(("content", T.ArrayType(ORDER)), ("totalElements", L), ("totalPages", I), ("number", I))

EMPLOYEE_ROLE = _struct(("id", L), ("name", S))
EMPLOYEE = _struct(("id", L), ("firstName", S), ("lastName", S),
                   ("employeeRole", EMPLOYEE_ROLE), ("updatedDate", S))
EMPLOYEE_PAGE = _struct(("content", T.ArrayType(EMPLOYEE)), ("totalElements", L),
                        ("totalPages", I))

LABOR = _struct(("id", L), ("name", S), ("rate", V), ("hours", V), ("complete", B),
                ("technicianId", L))
PART = _struct(("id", L), ("quantity", V), ("brand", S), ("name", S), ("partNumber", S),
               ("description", S), ("cost", V), ("retail", V))
JOB = _struct(
    ("id", L), ("repairOrderId", L), ("vehicleId", L), ("customerId", L), ("name", S),
    ("authorized", B), ("authorizedDate", S), ("selected", B), ("technicianId", L),
    ("note", S), ("jobCategoryName", S), ("partsTotal", V), ("laborTotal", V),
    ("discountTotal", V), ("feeTotal", V), ("subtotal", V), ("archived", B),
    ("createdDate", S), ("updatedDate", S), ("completedDate", S), ("laborHours", V),
    ("labor", T.ArrayType(LABOR)), ("parts", T.ArrayType(PART)),
)

# ---------------------------------------------------------------- silver
EMPLOYEES = _struct(("id", L), ("first_name", S), ("last_name", S), ("role_id", L),
                    ("role_name", S), ("updated_date", S))

REPAIR_ORDERS = _struct(
    ("id", L), ("repair_order_number", L), ("shop_id", L), ("status_id", L),
    ("status_code", S), ("status_name", S), ("label_code", S), ("label_name", S),
    ("appointment_start_time", S), ("customer_id", L), ("vehicle_id", L),
    ("technician_id", L), ("service_writer_id", L), ("miles_in", L), ("miles_out", L),
    ("completed_date", S), ("posted_date", S), ("created_date", S), ("updated_date", S),
    ("labor_sales", L), ("parts_sales", L), ("sublet_sales", L), ("discount_total", L),
    ("fee_total", L), ("taxes", L), ("total_sales", L),
)

# Parsed business days added next to the raw text (silver only).
ORDER_DAY_COLUMNS = ("completed_day", "posted_day", "created_day")

JOBS = _struct(
    ("id", L), ("repair_order_id", L), ("vehicle_id", L), ("customer_id", L), ("name", S),
    ("authorized", I), ("authorized_date", S), ("selected", I), ("technician_id", L),
    ("note", S), ("job_category_name", S), ("parts_total", L), ("labor_total", L),
    ("discount_total", L), ("fee_total", L), ("subtotal", L), ("archived", I),
    ("created_date", S), ("updated_date", S), ("completed_date", S), ("labor_hours", D),
)

LABOR_LINES = _struct(("id", L), ("job_id", L), ("name", S), ("rate", L), ("hours", D),
                      ("complete", I), ("technician_id", L))

PARTS = _struct(("id", L), ("job_id", L), ("quantity", D), ("brand", S), ("name", S),
                ("part_number", S), ("description", S), ("cost", L), ("retail", L))

#: Documents' fields that default to zero where their key is absent, with the type they are stored in.
ORDER_AMOUNTS = {c: "bigint" for c in ("laborSales", "partsSales", "subletSales", "discountTotal", "feeTotal", "taxes",
                                       "totalSales")}
JOB_AMOUNTS = {"partsTotal": "bigint", "laborTotal": "bigint", "discountTotal": "bigint", "feeTotal": "bigint",
               "subtotal": "bigint", "laborHours": "double"}
LABOR_AMOUNTS = {"rate": "bigint", "hours": "double"}
PART_AMOUNTS = {"quantity": "double", "cost": "bigint", "retail": "bigint"}

# ---------------------------------------------------------------- ingest log
#: What a landed row carries besides its own columns: the landing time of its
#: file, and for what cannot be stored the reason and the text.
LANDED_AT, REASON, TEXT = "_landed_at", "_reason", "_text"
ENTRY = [T.StructField(LANDED_AT, TS), T.StructField(REASON, S), T.StructField(TEXT, S)]
LOG = {
    "employees": T.StructType(EMPLOYEES.fields + ENTRY),
    "repair_orders": T.StructType(REPAIR_ORDERS.fields + ENTRY + [
        T.StructField("mentions", T.ArrayType(L)), T.StructField("page", I), T.StructField("pages", I)]),
    "jobs": T.StructType(JOBS.fields + [T.StructField("labor", T.ArrayType(LABOR_LINES)),
                                        T.StructField("parts", T.ArrayType(PARTS))] + ENTRY),
}
