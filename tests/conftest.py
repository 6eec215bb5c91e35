from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shoplens.session import SESSION_DEFAULTS

    b = (SparkSession.builder.master("local[*]").appName("shoplens-tests")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from shoplens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)     # uses spark.checkpoint.dir, or a private folder if unset
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shoplens-test-")


def _rows(schema, rows):
    names = [f.name for f in schema.fields]
    out = []
    for r in rows:
        unknown = set(r) - set(names)
        assert not unknown, unknown
        out.append(tuple(r.get(n) for n in names))
    return out


@pytest.fixture()
def make_shop(spark):
    """Build a Shop from small lists of dicts (missing columns are NULL)."""
    from shoplens.sources import schemas as S
    from shoplens.sources.landed import with_order_days
    from shoplens.sources.silver import Shop

    def build(employees=(), orders=(), jobs=(), labor=(), parts=()):
        mk = lambda sch, rows: spark.createDataFrame(_rows(sch, rows), sch)
        return Shop(
            employees=mk(S.EMPLOYEES, employees),
            repair_orders=with_order_days(mk(S.REPAIR_ORDERS, orders)),
            jobs=mk(S.JOBS, jobs),
            labor_lines=mk(S.LABOR_LINES, labor),
            parts=mk(S.PARTS, parts),
        )
    return build


def order(id, posted=None, created=None, completed=None, labor=0, parts=0, sublet=0, fees=0,
          taxes=0, discount=0, total=None, writer=None, status="Posted", number=None):
    if total is None:
        total = labor + parts + sublet + fees + taxes - discount
    return dict(id=id, repair_order_number=number if number is not None else id + 1000,
                posted_date=posted, created_date=created, completed_date=completed,
                labor_sales=labor, parts_sales=parts, sublet_sales=sublet, fee_total=fees,
                taxes=taxes, discount_total=discount, total_sales=total,
                service_writer_id=writer, status_name=status)
