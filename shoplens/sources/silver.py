"""Silver tables: the five typed business tables every report reads.

A :class:`Shop` is just five DataFrames.  Jobs, labor lines and parts carry the
id and the three business days of their order, so a report restricts each table
by its own columns, before any join.  ``write`` partitions the four large
tables by the month of the default basis (``posted_month``), or while a month
would be a small file by its year (``posted_year``), and sorts by day within
files, so a period prunes partitions on that basis and row groups on the
others.  Rows are dealt to files by Spark's rebalance step: a month, job or
order that holds a third of all rows becomes several files, and small months
share a task.

``load_shop`` derives a table of a test-data folder when a report first asks for
it, and writes it once under the cluster's shared ``spark.checkpoint.dir``
(cutting the derivation's lineage, so a lost executor re-reads files instead of
recomputing the derivation): to a private folder first, published by renaming it.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions import exprs as X
from shoplens.functions.params import Period, basis_column
from shoplens.session import ensure_checkpoint_dir, path_exists, released_shuffles, rename_folder, touch
from shoplens.sources import schemas as S
from shoplens.sources.schemas import ORDER_DAY_COLUMNS

TABLE_NAMES = ("employees", "repair_orders", "jobs", "labor_lines", "parts")
DAYS = list(ORDER_DAY_COLUMNS)
MONTH, YEAR = X.MONTH_PARTITION, X.YEAR_PARTITION
#: Orders of a month from which a table is partitioned by month, not by year.
MONTH_ROWS = 500_000

# Adapter version: bump when the derivation or the layout changes so stale
# copies are ignored.
DERIVATION_VERSION = "9"


def _with_days(child: DataFrame, fk: str, parent: DataFrame, *more: str) -> DataFrame:
    """``child`` with the business days (and ``more``) of its parent; none if it has no parent."""
    if set(DAYS) <= set(child.columns):
        return child
    cols = [c for c in (*more, *DAYS) if c not in child.columns]
    right = parent.select(F.col("id").alias("_parent"), *cols)
    return child.join(right, F.col(fk) == F.col("_parent"), "left").drop("_parent")


@dataclass
class Shop:
    employees: DataFrame
    repair_orders: DataFrame
    jobs: DataFrame
    labor_lines: DataFrame
    parts: DataFrame
    #: Where the tables are stored as they are, if they are.
    root: str | None = field(default=None, compare=False)

    def __post_init__(self):
        self.jobs = _with_days(self.jobs, "repair_order_id", self.repair_orders)
        self.labor_lines = _with_days(self.labor_lines, "job_id", self.jobs, "repair_order_id")
        self.parts = _with_days(self.parts, "job_id", self.jobs, "repair_order_id")

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> "Shop":
        return cls(**{n: tables[n] for n in TABLE_NAMES})

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLE_NAMES}

    def of_period(self, name: str, period: Period, basis: str) -> DataFrame:
        """Rows of a table whose order's basis day lies in the period."""
        return X.period_rows(getattr(self, name), basis_column(basis), period)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> "Shop":
        """The tables under ``root``, with their declared columns (nothing is
        inferred from files; partition columns come from the folders)."""
        stamped = path_exists(spark, f"{root}/{STAMPED}")
        shop = cls(**{n: spark.read.schema(silver_schema(n, stamped)).parquet(f"{root}/{n}") for n in TABLE_NAMES})
        shop.root = root
        return shop

    def write(self, root: str, mode: str = "overwrite", month_rows: int = MONTH_ROWS) -> None:
        """Write the five tables under ``root``, side by side."""
        unit, value = partition_unit(self.repair_orders, month_rows)
        stamped = "synced_at" in self.repair_orders.columns

        def write(n: str) -> None:
            df = getattr(self, n)
            df = df.select(*[c for c in df.columns if c in silver_schema(n, stamped).names])
            if n == "employees":
                df.write.mode(mode).parquet(f"{root}/{n}")
                return
            df = df.withColumn(unit, value).hint("rebalance", F.col(unit))
            (df.sortWithinPartitions(unit, "posted_day", "created_day").write.mode(mode)
             .partitionBy(unit).parquet(f"{root}/{n}"))

        # the jobs of several tables share the cluster
        with ThreadPool(len(TABLE_NAMES)) as pool:
            pool.map(write, TABLE_NAMES)
        if stamped:
            touch(self.repair_orders.sparkSession, f"{root}/{STAMPED}")


def partition_unit(orders: DataFrame, month_rows: int = MONTH_ROWS) -> tuple[str, Column]:
    """The partition column of the large tables and its value from ``posted_day``."""
    months = orders.agg(F.count("*").alias("n"), F.count_distinct(X.month_number("posted_day")).alias("m")).first()
    return ((MONTH, X.month_number("posted_day")) if months["n"] >= month_rows * max(1, months["m"])
            else (YEAR, F.year("posted_day")))


#: Marker of tables that carry their ingest time.
STAMPED = "_synced"


def silver_schema(name: str, stamped: bool = False) -> T.StructType:
    """Columns of a written table: its own, the ids and days of its order, the ingest time."""
    own = {"employees": S.EMPLOYEES, "repair_orders": S.REPAIR_ORDERS, "jobs": S.JOBS, "labor_lines": S.LABOR_LINES,
           "parts": S.PARTS}[name]
    fields = list(own.fields)
    if name in ("labor_lines", "parts"):
        fields.append(T.StructField("repair_order_id", T.LongType()))
    if name != "employees":
        fields += [T.StructField(d, T.DateType()) for d in DAYS]
    if stamped:
        fields.append(T.StructField("synced_at", T.TimestampType()))
    return T.StructType(fields)


def footers(shop: Shop) -> dict[str, DataFrame]:
    """The stored tables through the Parquet source that pushes counts into the
    scan and answers them from the file footers."""
    spark = [getattr(shop, n) for n in TABLE_NAMES][0].sparkSession  # all of them are written
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    key = "spark.sql.sources.useV1SourceList"
    v1 = spark.conf.get(key)
    spark.conf.set(key, ",".join(x for x in v1.split(",") if x != "parquet"))
    try:
        return {n: spark.read.schema(silver_schema(n)).parquet(f"{shop.root}/{n}") for n in TABLE_NAMES}
    finally:
        spark.conf.set(key, v1)


def _fingerprint(spark: SparkSession, sf_dir: str, names) -> str:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    parts = [DERIVATION_VERSION]
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{n}.parquet")
        fs = p.getFileSystem(conf)
        st = fs.getFileStatus(p)
        size = st.getLen() if st.isFile() else fs.getContentSummary(p).getLength()
        parts.append(f"{n}:{size}:{st.getModificationTime()}")
    key = str(p.getFileSystem(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(sf_dir)))
    return hashlib.sha1("|".join([key] + parts).encode()).hexdigest()[:16]


def silver_root(spark: SparkSession, sf_dir: str) -> str:
    from shoplens.sources import adapter

    fp = _fingerprint(spark, sf_dir, adapter.TABLES)
    return f"{ensure_checkpoint_dir(spark)}/shoplens-silver/{fp}"


# concurrent callers of one process wait for the first build; another process
# that builds the same tables loses the rename and uses the published ones
_BUILD_LOCK = threading.RLock()


def _publish(spark: SparkSession, path: str, write) -> None:
    """``write`` to a private folder, then one rename, unless ``path`` is there."""
    if not path_exists(spark, path):
        private = f"{path}.{uuid.uuid4().hex}"
        write(private)
        rename_folder(spark, private, path)


def materialize(spark: SparkSession, sf_dir: str, root: str | None = None, names=TABLE_NAMES) -> str:
    """Derive silver tables from ``sf_dir`` once and publish them in the
    shared folder; later calls (any session on the cluster) reuse them.  Only the
    test tables that ``names`` come from are read.
    An explicit ``root`` builds a copy there (used to time a fresh build)."""
    from shoplens.sources import adapter

    root = root or silver_root(spark, sf_dir)
    with _BUILD_LOCK, released_shuffles(spark):
        missing = [n for n in names if not path_exists(spark, f"{root}/{n}")]
        if not missing:
            return root
        t = adapter.read_tables(spark, sf_dir)
        unit, value = (None, None) if missing == ["employees"] else partition_unit(adapter.order_days(t["orders"]))
        lines = f"{root}/{adapter.LINES}"
        if any(n in adapter.FROM_LINES for n in missing):
            _publish(spark, lines, lambda p: adapter.write_lines(t, p, unit, value))

        def build(n: str) -> None:
            if n == "employees":
                _publish(spark, f"{root}/{n}", lambda p: adapter.employees(t["supplier"]).write.parquet(p))
            elif n == "repair_orders":
                _publish(spark, f"{root}/{n}", lambda p: adapter.write_orders(t["orders"], p, unit, value))
            else:
                _publish(spark, f"{root}/{n}", lambda p: adapter.write_from_lines(
                    spark, n, lines, p, unit, silver_schema(n).names))

        # the jobs of several tables share the cluster
        with ThreadPool(len(missing)) as pool:
            pool.map(build, missing)
    return root


LANDED = {"orders": "order_pages", "employees": "employee_pages", "jobs": "job_documents"}


def land_documents(spark: SparkSession, sf_dir: str, kinds=tuple(LANDED.values())) -> str:
    """Render the silver tables of ``sf_dir`` as landed JSON documents
    (order pages, employee pages, job documents; of ``kinds``, compressed) once,
    next to the silver copy, and return their folder.  Ingest queries read these
    files with the declared schemas, exactly like freshly landed data."""
    from shoplens.sources import documents

    root = silver_root(spark, sf_dir) + ".landed"
    render = {"order_pages": documents.order_pages_text, "employee_pages": documents.employee_pages_text,
              "job_documents": documents.job_documents_text}
    with _BUILD_LOCK, released_shuffles(spark):
        shop = load_shop(spark, sf_dir)
        for kind in kinds:
            _publish(spark, f"{root}/{kind}", lambda p: render[kind](shop).write.text(p, compression="gzip"))
    return root


class DerivedShop(Shop):
    """The tables of a test-data folder, each derived and opened when first asked for."""

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str) -> "DerivedShop":
        shop = cls.__new__(cls)
        shop._source = (spark, sf_dir)
        shop.root = silver_root(spark, sf_dir)
        return shop

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES or "_source" not in self.__dict__:
            raise AttributeError(name)
        spark, sf_dir = self._source
        root = materialize(spark, sf_dir, names=(name,))
        table = spark.read.schema(silver_schema(name)).parquet(f"{root}/{name}")
        setattr(self, name, table)
        return table


_OPENED: dict[str, tuple[SparkSession, Shop]] = {}


def load_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """Silver tables for a test-data folder (each materialized on first use).  The
    opened DataFrames are remembered with their session, under a folder name
    that changes when the input does."""
    with _BUILD_LOCK:
        root = silver_root(spark, sf_dir)
        owner, shop = _OPENED.get(root, (None, None))
        if owner is not spark:
            shop = DerivedShop.open(spark, sf_dir)
            _OPENED[root] = (spark, shop)
    return shop
