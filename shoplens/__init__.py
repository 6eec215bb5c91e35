"""shoplens: repair-shop analytics as Spark DataFrame jobs.

Layout
------
sources/    schemas, landed-JSON readers, silver tables, test-data adapter
functions/  reporting parameters and reusable column expressions
operators/  the reports (revenue, people, categories, missed work, audit,
            inspection, indicators) and the upsert/anti-join ingest operators
plans/      composites (dashboard, full sync) and the query registry
streaming/  Structured Streaming ingest (foreachBatch, versioned tables)

Every report takes a :class:`~shoplens.sources.silver.Shop` (five silver
DataFrames) plus driver-side parameters and returns a lazy DataFrame.
"""

from shoplens.functions.params import Period, basis_column, date_range
from shoplens.sources.silver import Shop

__all__ = ["Period", "Shop", "basis_column", "date_range"]
