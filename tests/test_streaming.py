"""Streamed ingest is order- and replay-insensitive."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shoplens.sources import documents, landed
from shoplens.sources import schemas as S
from shoplens.sources.silver import load_shop
from shoplens.streaming import ingest_stream as ST

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _land(text_df, path, n_files):
    text_df.repartition(n_files).write.mode("overwrite").text(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".txt"))


def _rows(df, drop=()):
    cols = sorted(c for c in df.columns if c not in drop)
    key = lambda t: tuple((v is None, str(v)) for v in t)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def _run(spark, kind, landing, root, ckpt, max_files=None):
    q = ST.start(spark, kind, landing, root, checkpoint=ckpt, max_files_per_trigger=max_files)
    q.awaitTermination()


def test_orders_one_batch_equals_many_batches_and_replay(spark, tmp_dir):
    shop = load_shop(spark, SF)
    landing = os.path.join(tmp_dir, "landing_orders")
    files = _land(documents.order_pages_text(shop), landing, 3)
    # a later page re-lands some orders with a changed total and newer stamp
    changed = (landed.flatten_orders(landed.parse_text(documents.order_pages_text(shop),
                                                       S.ORDER_PAGE))
               .filter(F.col("id") < 50).select("id"))
    o = documents.order_structs(shop).join(changed, "id", "left_semi")
    o = o.withColumn("o", F.col("o").withField("totalSales", F.col("o.totalSales") + 7)
                     .withField("updatedDate", F.lit("2999-01-01T00:00:00Z")))
    extra = os.path.join(tmp_dir, "landing_orders_extra")
    _land(documents.order_pages_text(shop, orders=o), extra, 1)
    for f in os.listdir(extra):
        if f.endswith(".txt"):
            os.link(os.path.join(extra, f), os.path.join(landing, "zz-" + f))

    one = os.path.join(tmp_dir, "one")
    many = os.path.join(tmp_dir, "many")
    _run(spark, "orders", landing, one, os.path.join(tmp_dir, "ck1"))
    _run(spark, "orders", landing, many, os.path.join(tmp_dir, "ck2"), max_files=1)
    a, b = ST.published(spark, one)["repair_orders"], ST.published(spark, many)["repair_orders"]
    assert _rows(a) == _rows(b)
    bumped = a.filter(F.col("id") < 50).agg(F.min("updated_date")).first()[0]
    assert bumped.startswith("2999")
    assert a.count() == shop.repair_orders.count()

    # a replayed batch writes its own folder again; a re-landed page is harmless
    before = _rows(b)
    writer = ST.batch_writer("orders", many)
    page = spark.read.schema(S.ORDER_PAGE).json(files[0])
    writer(page, 7, "other")
    once = _log_files(many, "repair_orders")
    writer(page, 7, "other")
    assert len(_log_files(many, "repair_orders")) == len(once)
    assert _rows(ST.published(spark, many)["repair_orders"]) == before
    # merged or not, in one go or file by file: the same table
    ST.merge_log(spark, one)
    ST.merge_log(spark, many, max_files_per_trigger=1)
    assert _rows(ST.published(spark, one)["repair_orders"]) == before == _rows(ST.published(spark, many)["repair_orders"])


def _log_files(root, table):
    return [os.path.join(d, f) for d, _, fs in os.walk(f"{root}/{table}/log") for f in fs if f.endswith(".parquet")]


def _page(*orders):
    import json

    return json.dumps({"content": [dict(id=i, repairOrderNumber=i, totalSales=t, updatedDate=u) for i, t, u in orders]})


def _write(path, name, *lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _orders(spark, root):
    return {r.id: r.total_sales for r in ST.published(spark, root)["repair_orders"].collect()}


def test_new_checkpoint_counts_new_files(spark, tmp_dir):
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "a.json", _page((1, 10, "2020-01-01")))
    _run(spark, "orders", land, root, f"{tmp_dir}/ck1")
    _write(f"{tmp_dir}/in2", "b.json", _page((2, 20, "2020-01-01")))
    _run(spark, "orders", f"{tmp_dir}/in2", root, f"{tmp_dir}/ck2")
    assert _orders(spark, root) == {1: 10, 2: 20}


def test_default_checkpoints_tell_targets_apart(spark, tmp_dir):
    land = f"{tmp_dir}/in"
    _write(land, "a.json", _page((1, 10, "2020-01-01")))
    for target in ("x", "y"):
        _run(spark, "orders", land, f"{tmp_dir}/{target}", None)
        assert _orders(spark, f"{tmp_dir}/{target}") == {1: 10}


@pytest.mark.parametrize("max_files", [None, 1])
def test_update_stamp_wins_whatever_the_file_name(spark, tmp_dir, max_files):
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "page-10.json", _page((1, 10, "2020-02-01")))
    _write(land, "page-9.json", _page((1, 9, "2020-01-01"), (2, 5, None), (2, 5, None)))
    _run(spark, "orders", land, root, f"{tmp_dir}/ck", max_files)
    assert _orders(spark, root) == {1: 10, 2: 5}


def test_later_landing_wins_without_stamps(spark, tmp_dir):
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "z.json", '{"content": [{"id": 1, "firstName": "Zoe"}]}')
    os.utime(f"{land}/z.json", (1_000_000_000, 1_000_000_000))
    _write(land, "a.json", '{"content": [{"id": 1, "firstName": "Ann"}]}')
    os.utime(f"{land}/a.json", (1_100_000_000, 1_100_000_000))
    _run(spark, "employees", land, root, f"{tmp_dir}/ck")
    assert [r.first_name for r in ST.published(spark, root)["employees"].collect()] == ["Ann"]


def test_rejects_and_lines_without_id(spark, tmp_dir):
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "j.json", "{broken", '{"name": "no id"}',
           '{"id": 7, "labor": [{"hours": 1.0}, {"hours": 1.0}, {"id": 3}], "parts": [{"cost": 5}]}')
    _run(spark, "jobs", land, root, f"{tmp_dir}/ck")
    out = ST.published(spark, root)
    assert sorted((r.kind, r.reason) for r in out["rejected"].collect()) == [("job", "no id"), ("job", "unreadable")]
    assert [r.id for r in out["jobs"].collect()] == [7]
    labor = out["labor_lines"].collect()
    assert len(labor) == 3 and len({r.id for r in labor}) == 3 and out["parts"].count() == 1
    # the same documents again: same generated keys, nothing doubled
    _run(spark, "jobs", land, root, f"{tmp_dir}/ck-other")
    assert ST.published(spark, root)["labor_lines"].count() == 3


def test_jobs_first_wins_with_children(spark, tmp_dir):
    shop = load_shop(spark, SF)
    landing = os.path.join(tmp_dir, "landing_jobs")
    _land(documents.job_documents_text(shop), landing, 3)
    # a later document of an already stored job must not change it
    again = shop.jobs.filter(F.col("id") < 200).withColumn("authorized", 1 - F.col("authorized"))
    shop2 = type(shop)(shop.employees, shop.repair_orders, again, shop.labor_lines, shop.parts)
    extra = os.path.join(tmp_dir, "extra")
    _land(documents.job_documents_text(shop2), extra, 1)

    root = os.path.join(tmp_dir, "silver")
    _run(spark, "jobs", landing, root, os.path.join(tmp_dir, "ckj"))
    for f in os.listdir(extra):
        if f.endswith(".txt"):
            os.link(os.path.join(extra, f), os.path.join(landing, "zz-" + f))
    _run(spark, "jobs", landing, root, os.path.join(tmp_dir, "ckj"))

    out = ST.published(spark, root)
    jobs, labor, parts = out["jobs"], out["labor_lines"], out["parts"]
    docs = landed.parse_text(documents.job_documents_text(shop), S.JOB)
    assert _rows(jobs) == _rows(landed.flatten_jobs(docs))
    assert _rows(labor) == _rows(landed.flatten_labor(docs))
    assert _rows(parts) == _rows(landed.flatten_parts(docs))


def test_job_documents_null_missing_empty_children(spark):
    text = spark.createDataFrame([
        ('{"id": 1, "labor": null, "parts": []}',),
        ('{"id": 2}',),
        ('{"id": 3, "labor": [{"id": 30, "hours": 1.5}], "parts": [{"id": 31}],'
         ' "authorized": true, "archived": null}',),
        ('{"labor": [{"id": 40}]}',),
    ], "value string")
    docs = landed.parse_text(text, S.JOB)
    jobs = {r.id: r for r in landed.flatten_jobs(docs).collect()}
    assert set(jobs) == {1, 2, 3}
    assert (jobs[3].authorized, jobs[3].archived, jobs[2].subtotal) == (1, 0, 0)
    labor = landed.flatten_labor(docs).collect()
    assert [(r.id, r.job_id, r.rate, r.hours, r.complete) for r in labor] == [(30, 3, 0, 1.5, 0)]
    parts = landed.flatten_parts(docs).collect()
    assert [(r.id, r.quantity, r.cost) for r in parts] == [(31, 0.0, 0)]


def test_order_summaries_skip_empty_and_idless(spark):
    text = spark.createDataFrame([
        ('{"content": [{"id": 1, "repairOrderNumber": 11, "jobs": []},'
         ' {"id": 2, "repairOrderNumber": 12},'
         ' {"id": 3, "repairOrderNumber": 13, "jobs": [{"id": 0}, {"name": "x"}, {"id": 5}]}],'
         ' "totalElements": 3, "totalPages": 1}',)], "value string")
    pages = landed.parse_text(text, S.ORDER_PAGE)
    s = landed.order_job_summaries(pages).collect()
    assert [(r.repair_order_id, r.job_id) for r in s] == [(3, 5)]
    flat = {r.id: r for r in landed.flatten_orders(pages).collect()}
    assert flat[2].status_name is None and flat[2].total_sales == 0


# ------------------------------------------------------------------ log and base
def test_runs_in_any_order_and_two_streams_keep_everything(spark, tmp_dir):
    """Run 20, then run 7; and two streams whose batches alternate: nothing is lost, rejects included."""
    root = f"{tmp_dir}/out"
    page = lambda name, i: spark.read.schema(S.EMPLOYEE_PAGE).json(spark.sparkContext.parallelize(
        ['{"content": [{"id": %d, "firstName": "%s"}, {"firstName": "no id"}]}' % (i, name)]))
    write = ST.batch_writer("employees", root)
    write(page("Ann", 1), 20, "run")
    write(page("Bob", 2), 7, "run")
    for batch in range(2):
        for stream in ("a", "b"):
            write(page(f"{stream}{batch}", 100 + 10 * batch + ord(stream)), batch, stream)
    for _ in range(2):
        out = ST.published(spark, root)
        assert {r.first_name for r in out["employees"].collect()} == {"Ann", "Bob", "a0", "a1", "b0", "b1"}
        assert out["rejected"].count() == 6
        ST.merge_log(spark, root)


def test_a_merge_touches_only_the_partitions_it_meets(spark, tmp_dir):
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "a.json", _page(*[(i, i, "2020-01-01") for i in range(300)]))
    _run(spark, "orders", land, root, f"{tmp_dir}/ck")
    ST.merge_log(spark, root)

    def files():
        base = ST._base_path(root, "repair_orders")
        return {p: os.stat(p).st_mtime_ns for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")
                for p in [os.path.join(d, f)]}

    before = files()
    _write(land, "b.json", _page((5, 999, "2020-02-01"), (1000, 1, "2020-01-01"), (6, 0, "2019-01-01")))
    _run(spark, "orders", land, root, f"{tmp_dir}/ck")
    ST.merge_log(spark, root)
    after = files()
    kept = {p for p in before if after.get(p) == before[p]}
    gone = {os.path.dirname(p) for p in set(before) - kept}
    assert len(kept) >= ST.BUCKETS - 3 and 1 <= len(gone) <= 3
    orders = _orders(spark, root)
    assert orders == {**{i: i for i in range(300)}, 5: 999, 1000: 1}


def test_a_merge_cut_off_in_its_overwrite_is_repeated_from_its_copy(spark, tmp_dir):
    import shutil

    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "a.json", _page(*[(i, i, "2020-01-01") for i in range(50)]))
    _run(spark, "orders", land, root, f"{tmp_dir}/ck")
    rows = ST.log(spark, root, "repair_orders")
    ST._merge_batch(spark, root, "repair_orders", rows, 0)
    # the folders of the base are gone as after a loss between deletion and renaming
    shutil.rmtree(ST._base_path(root, "repair_orders"))
    ST._merge_batch(spark, root, "repair_orders", rows, 0)
    assert _orders(spark, root) == {i: i for i in range(50)}


def test_first_job_wins_in_one_batch_or_many_and_after_a_restart(spark, tmp_dir):
    """Two documents of a job: the earlier landing stays, however the files fall into batches."""
    land = f"{tmp_dir}/in"
    for k, name in enumerate(("z.json", "m.json", "a.json")):
        _write(land, name, *['{"id": %d, "name": "%s", "labor": [{"id": %d, "hours": %d}]}' % (i, name, i, k)
                             for i in range(k, 12)])
        os.utime(f"{land}/{name}", (1_000_000_000 + k, 1_000_000_000 + k))
    want = {i: "z.json" for i in range(12)}
    for target, files in (("one", None), ("many", 1)):
        root = f"{tmp_dir}/{target}"
        _run(spark, "jobs", land, root, f"{tmp_dir}/ck-{target}", files)
        assert {r.id: r.name for r in ST.published(spark, root)["jobs"].collect()} == want
        _write(land, f"later-{target}.json", '{"id": 3, "name": "later"}', '{"id": 50, "name": "new"}', '{"name": "lost"}')
        _run(spark, "jobs", land, root, f"{tmp_dir}/ck-{target}", files)
        out = ST.published(spark, root)
        assert {r.id: r.name for r in out["jobs"].collect()} == {**want, 50: "new"}
        assert out["rejected"].count() == 1 and {r.hours for r in out["labor_lines"].collect()} == {0.0}
        # the second landing of a known job is not even logged
        assert ST.log(spark, root, "jobs").filter("id = 3").count() == 1
        os.remove(f"{land}/later-{target}.json")


def test_lines_are_never_seen_without_their_job(spark, tmp_dir):
    """A batch whose folder is not complete is not there at all."""
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "a.json", '{"id": 1, "labor": [{"id": 10}]}')
    _run(spark, "jobs", land, root, f"{tmp_dir}/ck")
    _write(land, "b.json", '{"id": 2, "labor": [{"id": 20}]}')
    _run(spark, "jobs", land, root, f"{tmp_dir}/ck")
    done = [os.path.join(d, "_SUCCESS") for d, _, fs in os.walk(f"{root}/jobs/log") if "_SUCCESS" in fs]
    os.remove([p for p in done if "batch=1" in p][0])
    out = ST.published(spark, root)
    assert [r.id for r in out["jobs"].collect()] == [1] and [r.id for r in out["labor_lines"].collect()] == [10]


def test_explicit_null_stays_null_and_odd_amounts_are_rejected(spark, tmp_dir):
    land, root = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(land, "o.json", '{"content": [{"id": 1, "laborSales": null, "taxes": 5}, {"id": 2, "laborSales": "x"}, '
           '{"id": 3, "laborSales": 12.5}, {"id": 4}, {"id": 5, "totalSales": 7.0}]}')
    _write(f"{tmp_dir}/jobs", "j.json", '{"id": 1, "laborHours": null, "labor": [{"id": 1, "rate": null}, {"id": 2}]}',
           '{"id": 2, "parts": [{"id": 3, "cost": "abc"}]}')
    _run(spark, "orders", land, root, f"{tmp_dir}/ck")
    _run(spark, "jobs", f"{tmp_dir}/jobs", root, f"{tmp_dir}/ckj")
    out = ST.published(spark, root)
    rows = {r.id: (r.labor_sales, r.taxes, r.total_sales) for r in out["repair_orders"].collect()}
    assert rows == {1: (None, 5, 0), 4: (0, 0, 0), 5: (0, 0, 7)}
    assert sorted((r.kind, r.reason) for r in out["rejected"].collect()) == [
        ("job", "unreadable amount"), ("order", "unreadable amount"), ("order", "unreadable amount")]
    assert [(r.labor_hours, r.subtotal) for r in out["jobs"].collect()] == [(None, 0)]
    assert {r.id: (r.rate, r.hours) for r in out["labor_lines"].collect()} == {1: (None, 0.0), 2: (0, 0.0)}
