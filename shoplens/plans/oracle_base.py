"""DuckDB text of the silver derivation (mirror of ``sources/adapter.py``).

Every oracle query starts with these CTEs so DuckDB computes the same five
silver tables from the same parquet views.  Integer arithmetic only:
``//`` here is Spark's ``div``; money is rounded to cents with
``floor(x * 100 + 0.5)``.
"""

SILVER_CTES = r"""
WITH
_o AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, o_orderpriority,
         CAST(o_orderdate AS DATE) AS d,
         CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) // 100 AS b
  FROM orders
),
_o2 AS (
  SELECT *, (b * 30) // 100 AS lab, (b * 50) // 100 AS par, (b * 5) // 100 AS sub,
         (b * 3) // 100 AS fee, (b * 7) // 100 AS tax, (b * 4) // 100 AS dis
  FROM _o
),
repair_orders_raw AS (
  SELECT
    k AS id, k + 1000 AS repair_order_number, CAST(1 AS BIGINT) AS shop_id,
    CAST(CASE WHEN st = 'F' THEN 5 WHEN st = 'P' THEN 3 WHEN k % 11 = 0 THEN NULL ELSE 1 END AS BIGINT) AS status_id,
    upper(CASE WHEN st = 'F' THEN 'Posted' WHEN st = 'P' THEN 'Complete' WHEN k % 11 = 0 THEN NULL ELSE 'Estimate' END) AS status_code,
    CASE WHEN st = 'F' THEN 'Posted' WHEN st = 'P' THEN 'Complete' WHEN k % 11 = 0 THEN NULL ELSE 'Estimate' END AS status_name,
    substr(o_orderpriority, 1, 1) AS label_code, substr(o_orderpriority, 3) AS label_name,
    CAST(NULL AS VARCHAR) AS appointment_start_time,
    o_custkey AS customer_id, o_custkey AS vehicle_id, CAST(NULL AS BIGINT) AS technician_id,
    o_custkey % 5 AS service_writer_id,
    CAST(NULL AS BIGINT) AS miles_in, CAST(NULL AS BIGINT) AS miles_out,
    CASE WHEN st IN ('F', 'P') THEN strftime(d + 2, '%Y-%m-%d') || 'T00:00:00Z' END AS completed_date,
    CASE WHEN st = 'F' THEN strftime(d + 3, '%Y-%m-%d') || 'T00:00:00Z' END AS posted_date,
    CASE WHEN k % 97 = 0 THEN strftime(d, '%m/%d/%Y')
         WHEN k % 4 = 1 THEN strftime(d, '%Y-%m-%d') || 'T00:00:00'
         WHEN k % 4 = 2 THEN strftime(d, '%Y-%m-%d')
         ELSE strftime(d, '%Y-%m-%d') || 'T00:00:00Z' END AS created_date,
    strftime(d, '%Y-%m-%d') || 'T00:00:00Z' AS updated_date,
    lab AS labor_sales, par AS parts_sales, sub AS sublet_sales, dis AS discount_total,
    fee AS fee_total, tax AS taxes,
    CAST(CASE WHEN strftime(d, '%Y-%m') = '1996-02' THEN 0
              ELSE lab + par + sub + fee + tax - dis + CASE WHEN k % 7 = 0 THEN k % 5 ELSE 0 END
         END AS BIGINT) AS total_sales
  FROM _o2
),
repair_orders AS (
  SELECT *,
    CAST(try_strptime(substr(completed_date, 1, 10), '%Y-%m-%d') AS DATE) AS completed_day,
    CAST(try_strptime(substr(posted_date, 1, 10), '%Y-%m-%d') AS DATE) AS posted_day,
    CAST(try_strptime(substr(created_date, 1, 10), '%Y-%m-%d') AS DATE) AS created_day
  FROM repair_orders_raw
),
employees AS (
  SELECT
    s_suppkey AS id,
    CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE substr(s_name, 1, 8) END AS first_name,
    CASE WHEN s_suppkey % 10 = 9 OR s_suppkey % 7 = 6 THEN NULL ELSE substr(s_name, 10) END AS last_name,
    CAST(CASE WHEN s_suppkey % 10 <= 3 THEN 1 WHEN s_suppkey % 10 = 8 THEN NULL ELSE 2 END AS BIGINT) AS role_id,
    CASE WHEN s_suppkey % 10 IN (0, 1, 2) THEN 'Service Advisor'
         WHEN s_suppkey % 10 = 3 THEN 'SERVICE ADVISOR'
         WHEN s_suppkey % 10 = 8 THEN NULL ELSE 'Technician' END AS role_name,
    CAST(NULL AS VARCHAR) AS updated_date
  FROM supplier
),
_li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
    l_orderkey * 8 + l_linenumber AS job_id,
    CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) // 100 AS lb,
    min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS pk,
    min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS sk,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, l_shipdate) - 1 AS line_id
  FROM lineitem
),
_lines AS (
  SELECT _li.*, p.p_type, p.p_name,
    CASE WHEN job_id % 23 = 0 THEN 'Courtesy'
         WHEN job_id % 13 = 0 THEN '  '
         WHEN job_id % 17 = 0 THEN NULL
         WHEN job_id % 5 = 0 THEN '  ' || p.p_type || ' '
         ELSE p.p_type END AS category
  FROM _li JOIN part p ON p.p_partkey = _li.pk
),
_jobs AS (
  SELECT job_id, any_value(l_orderkey) AS l_orderkey, any_value(sk) AS sk,
         any_value(p_type) AS p_type, any_value(p_name) AS p_name,
         any_value(category) AS category, sum(lb) AS lb, sum(l_quantity) AS qty
  FROM _lines GROUP BY l_orderkey, l_linenumber, job_id
),
jobs AS (
  SELECT
    job_id AS id, l_orderkey AS repair_order_id,
    CAST(NULL AS BIGINT) AS vehicle_id, CAST(NULL AS BIGINT) AS customer_id,
    p_name AS name,
    CAST(CASE WHEN p_type = 'STANDARD' THEN CASE WHEN job_id % 5 >= 3 THEN 1 ELSE 0 END
              ELSE CASE WHEN job_id % (length(p_type) % 4 + 2) = 0 THEN 0 ELSE 1 END END AS INTEGER) AS authorized,
    CAST(NULL AS VARCHAR) AS authorized_date,
    CAST(CASE WHEN p_type = 'STANDARD' THEN CASE WHEN job_id % 5 >= 3 THEN 1 ELSE 0 END
              ELSE CASE WHEN job_id % (length(p_type) % 4 + 2) = 0 THEN 0 ELSE 1 END END AS INTEGER) AS selected,
    CAST(CASE WHEN job_id % 6 = 0 THEN NULL ELSE sk END AS BIGINT) AS technician_id,
    CAST(NULL AS VARCHAR) AS note,
    category AS job_category_name,
    CAST(CASE WHEN category = 'Courtesy' THEN 0 ELSE lb - (lb * 60) // 100 END AS BIGINT) AS parts_total,
    CAST(CASE WHEN category = 'Courtesy' THEN 0 ELSE (lb * 60) // 100 END AS BIGINT) AS labor_total,
    CAST(CASE WHEN category = 'Courtesy' THEN 0 ELSE (lb * 3) // 100 END AS BIGINT) AS discount_total,
    CAST(0 AS BIGINT) AS fee_total,
    CAST(CASE WHEN category = 'Courtesy' THEN 0 ELSE lb - (lb * 3) // 100 END AS BIGINT) AS subtotal,
    CAST(CASE WHEN job_id % 3 = 0 THEN NULL WHEN job_id % 19 = 0 THEN 1 ELSE 0 END AS INTEGER) AS archived,
    CAST(NULL AS VARCHAR) AS created_date, CAST(NULL AS VARCHAR) AS updated_date,
    CAST(NULL AS VARCHAR) AS completed_date,
    qty / 16.0 AS labor_hours
  FROM _jobs
),
labor_lines AS (
  SELECT line_id AS id, job_id, CAST(NULL AS VARCHAR) AS name,
    CAST(8500 + (l_suppkey % 5) * 1000 + (l_partkey % 50) * 20 AS BIGINT) AS rate,
    l_quantity / 16.0 AS hours,
    CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS complete,
    l_suppkey AS technician_id
  FROM _lines
),
parts AS (
  SELECT line_id AS id, job_id, l_quantity AS quantity,
    CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS name,
    CAST(l_partkey AS VARCHAR) AS part_number, CAST(NULL AS VARCHAR) AS description,
    (lb * 6 * length(p_type)) // (CAST(l_quantity AS BIGINT) * 100) AS cost,
    lb // CAST(l_quantity AS BIGINT) AS retail
  FROM _lines
  WHERE l_returnflag <> 'R' AND coalesce(trim(category), '') <> 'PROMO'
)
"""
