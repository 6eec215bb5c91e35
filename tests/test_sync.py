"""K4 batch sync: window, statistics, first-wins jobs across runs, replay safety, and reports on its tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shoplens.functions.params import ingest_window
from shoplens.operators import revenue
from shoplens.plans import registry
from shoplens.plans.sync import refine, run_full_sync
from shoplens.sources import documents, landed
from shoplens.sources.silver import Shop, load_shop
from shoplens.streaming import ingest_stream as ST

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
AS_OF = registry.AS_OF


def _land(spark, shop, land, extra=()):
    documents.employee_pages_text(shop).write.text(f"{land}/employee_pages")
    documents.order_pages_text(shop).write.text(f"{land}/order_pages")
    docs = documents.job_documents_text(shop)
    if extra:
        docs = docs.unionByName(spark.createDataFrame([(x,) for x in extra], "value string"))
    docs.write.text(f"{land}/job_documents")


def _in_window(shop):
    orders = landed.in_ingest_window(shop.repair_orders, ingest_window(AS_OF))
    jobs = shop.jobs.join(orders.select(F.col("id").alias("repair_order_id")), "repair_order_id", "left_semi")
    return orders, jobs


def test_full_sync_result_and_rerun(spark, tmp_dir):
    shop = load_shop(spark, SF)
    land = os.path.join(tmp_dir, "landed")
    orders, jobs = _in_window(shop)
    cut = jobs.select(F.percentile_approx("id", 0.2)).first()[0]
    # documents of jobs with small ids never arrived; one landed line is corrupt, one is of a job nobody mentions
    present = Shop(shop.employees, shop.repair_orders, shop.jobs.filter(F.col("id") >= cut), shop.labor_lines, shop.parts)
    documents.employee_pages_text(shop).write.text(f"{land}/employee_pages")
    documents.order_pages_text(shop).write.text(f"{land}/order_pages")
    documents.job_documents_text(present).unionByName(spark.createDataFrame(
        [("{not json",), ('{"id": 999999999}',)], "value string")).write.text(f"{land}/job_documents")
    n_jobs, n_missing, n_orders = jobs.count(), jobs.filter(F.col("id") < cut).count(), orders.count()
    assert 0 < n_missing < n_jobs and 0 < n_orders < shop.repair_orders.count()

    root = os.path.join(tmp_dir, "tables")
    r0 = run_full_sync(spark, land, root, 0, AS_OF)
    assert r0.stats.first().asDict() == dict(
        jobs_found=n_jobs, jobs_synced=n_jobs - n_missing, jobs_skipped=0, jobs_failed=n_missing,
        employees_synced=shop.employees.count(), orders_synced=n_orders, pages_missing=0)
    assert r0.errors.count() == min(25, n_missing) and r0.started_at <= r0.finished_at
    out = ST.published(spark, root)
    assert out["jobs"].count() == n_jobs - n_missing and out["repair_orders"].count() == n_orders
    assert out["rejected"].filter("reason = 'unreadable'").count() == 1

    s1 = run_full_sync(spark, land, root, 1, AS_OF).stats.first().asDict()
    assert s1["jobs_synced"] == 0 and s1["jobs_skipped"] == n_jobs - n_missing
    assert s1["jobs_failed"] == n_missing            # failed jobs are retried next run
    assert ST.published(spark, root)["jobs"].count() == n_jobs - n_missing
    # repeating a run id adds nothing
    run_full_sync(spark, land, root, 1, AS_OF)
    out = ST.published(spark, root)
    assert out["jobs"].count() == n_jobs - n_missing and out["repair_orders"].count() == n_orders


def test_stream_after_sync_on_one_root(spark, tmp_dir):
    shop = load_shop(spark, SF)
    land, root = os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "tables")
    _land(spark, shop, land)
    run_full_sync(spark, land, root, 0, AS_OF)
    before = ST.published(spark, root)["repair_orders"].count()
    os.makedirs(f"{tmp_dir}/more")
    with open(f"{tmp_dir}/more/p.json", "w") as f:
        f.write('{"content": [{"id": 99000001, "totalSales": 1}]}\n')
    ST.start(spark, "orders", f"{tmp_dir}/more", root, checkpoint=f"{tmp_dir}/ck").awaitTermination()
    assert ST.published(spark, root)["repair_orders"].count() == before + 1


def test_reports_on_synced_tables(spark, tmp_dir):
    """Sync, refine, read: the reports equal those on the derived tables, within the window."""
    shop = load_shop(spark, SF)
    land, root = os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "tables")
    _land(spark, shop, land)
    run_full_sync(spark, land, root, 0, AS_OF)
    refine(spark, root, f"{tmp_dir}/silver")
    got = Shop.read(spark, f"{tmp_dir}/silver")
    assert {"posted_day", "completed_day", "created_day", "synced_at"} <= set(got.repair_orders.columns)
    orders, jobs = _in_window(shop)
    ids = jobs.select(F.col("id").alias("job_id"))
    want = Shop(shop.employees, orders, jobs, shop.labor_lines.join(ids, "job_id", "left_semi"),
                shop.parts.join(ids, "job_id", "left_semi"))
    from shoplens.operators import categories, people

    for report in (revenue.revenue, people.technician_metrics, categories.job_category_metrics):
        rows = [sorted(map(str, report(s, registry.YEAR, "revenue").collect())) for s in (got, want)]
        assert rows[0] == rows[1] and rows[0]


def _landing(tmp_dir, orders, employees=(), jobs=()):
    for name, lines in (("order_pages", orders), ("employee_pages", employees), ("job_documents", jobs)):
        os.makedirs(f"{tmp_dir}/land/{name}", exist_ok=True)
        with open(f"{tmp_dir}/land/{name}/x.json", "w") as f:
            f.write("\n".join(lines) + "\n")
    return f"{tmp_dir}/land"


def test_missing_pages_are_errors_of_the_run(spark, tmp_dir):
    page = '{"content": [{"id": %d, "createdDate": "2001-07-01", "jobs": [{"id": %d}]}], "totalPages": 6, "number": %d}'
    land = _landing(tmp_dir, [page % (n, n, n) for n in (0, 1, 3)] + ['{"content": [], "totalPages": 6, "number": 5}'],
                    jobs=['{"id": 0}', '{"id": 1}', '{"id": 3}', '{"id": 9}'])
    r = run_full_sync(spark, land, f"{tmp_dir}/t", 1, AS_OF)
    assert r.stats.first().pages_missing == 2
    assert [e.error for e in r.errors.collect()] == ["order page 2 is missing", "order page 4 is missing"]
    # a later run brings what was missing
    land = _landing(tmp_dir, [page % (n, n, n) for n in range(6)], jobs=['{"id": %d}' % n for n in range(6)])
    r = run_full_sync(spark, land, f"{tmp_dir}/t", 2, AS_OF)
    stats = r.stats.first()
    assert (stats.pages_missing, stats.jobs_synced, stats.jobs_skipped, r.errors.count()) == (0, 3, 2, 0)
    assert {x.id for x in ST.published(spark, f"{tmp_dir}/t")["jobs"].collect()} == {1, 2, 3, 4, 5}


def test_each_landed_folder_is_read_once(spark, tmp_dir, monkeypatch):
    """A landed folder is scanned once in the plan that logs it, and is gone for the rest of the run."""
    import shutil

    shop = load_shop(spark, SF)
    land = os.path.join(tmp_dir, "landed")
    _land(spark, shop, land)
    folders = {"employees": "employee_pages", "repair_orders": "order_pages", "jobs": "job_documents"}
    scans: dict = {}
    append = ST.append

    def once(rows, root, table, source, batch):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        scans[table] = {f: plan.count(f"{land}/{f}") for f in folders.values()}
        append(rows, root, table, source, batch)
        shutil.rmtree(f"{land}/{folders[table]}")

    monkeypatch.setattr(ST, "append", once)
    stats = run_full_sync(spark, land, f"{tmp_dir}/t", 0, AS_OF).stats.first()
    assert scans == {t: {f: int(f == own) for f in folders.values()} for t, own in folders.items()}
    assert stats.jobs_synced == _in_window(shop)[1].count()


def test_queries_derive_only_what_they_read(spark, tmp_dir):
    """Employees need neither lines nor orders, and order pages no job documents; landed text is compressed."""
    import glob
    import shutil

    from shoplens.plans import registry
    from shoplens.sources.silver import silver_root

    sf = f"{tmp_dir}/sf"
    shutil.copytree(SF, sf)
    q = registry.queries()
    root = silver_root(spark, sf).removeprefix("file:")
    assert q["ingest_employees"](spark, sf).count() == spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert os.listdir(root) == ["employees"] and os.listdir(f"{root}.landed") == ["employee_pages"]
    q["advisor_metrics"](spark, sf).collect()
    assert sorted(os.listdir(root)) == ["employees", "repair_orders"]
    q["new_jobs_anti"](spark, sf).collect()
    assert sorted(os.listdir(root)) == ["employees", "jobs", "lines", "repair_orders"]
    assert sorted(os.listdir(f"{root}.landed")) == ["employee_pages", "order_pages"]
    assert glob.glob(f"{root}.landed/order_pages/*.txt.gz")
