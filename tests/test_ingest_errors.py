"""Ingest errors: the ids of stored and fetched jobs are never sent through the driver."""

from __future__ import annotations

import json
import os
from types import SimpleNamespace

import pytest

from shoplens.plans import registry
from shoplens.sources import landed
from shoplens.sources import schemas as S
from shoplens.sources.silver import Shop

from conftest import order

MISSING = "job document missing or unreadable"


def _write(path, docs):
    os.makedirs(path)
    with open(f"{path}/x.json", "w") as f:
        f.write("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")


@pytest.fixture()
def landing(spark, tmp_dir, make_shop):
    """Order 1 was stored by the sync before (twice, so are its jobs), 2 to 4 are new."""
    shop = make_shop(orders=[order(1, created="2000-07-31"), order(1, created="2000-07-31"), order(2, created="2000-08-01"),
                             order(3, created="2001-07-31"), order(4, created=None)],
                     jobs=[dict(id=i, repair_order_id=o) for i, o in ((10, 1), (10, 1), (11, 1), (20, 2), (21, 2), (30, 3))])
    shop.write(f"{tmp_dir}/silver")
    jobs = {1: [10, 11], 2: [20, 21, 22, 29], 3: [30, 22, 10, 0, None], 4: [40, 41, 42]}
    pages = [{"content": [{"id": o, "repairOrderNumber": 1000 + o, "jobs": [{"id": i} for i in ids]}]} for o, ids in jobs.items()]
    _write(f"{tmp_dir}/order_pages", pages)
    # 29 divides by 29 (its fetch failed); 21 and 30 come twice, 41 is cut off, one document has no id
    _write(f"{tmp_dir}/job_documents", [{"id": i} for i in (20, 21, 21, 29, 30, 30, 40)] + ['{"id": 41, "na', '{"name": "x"}'])
    read = lambda name, schema: landed.read_json(spark, f"{tmp_dir}/{name}", schema)
    return SimpleNamespace(shop=Shop.read(spark, f"{tmp_dir}/silver"), order_pages=lambda: read("order_pages", S.ORDER_PAGE),
                           job_docs=lambda: read("job_documents", S.JOB))


def test_rows(landing):
    got = [tuple(r) for r in registry.ingest_errors(landing).collect()]
    assert got == [(n, i, MISSING) for n, i in ((1002, 22), (1002, 29), (1003, 22), (1004, 41), (1004, 42))]


def test_ids_move_by_key_whatever_their_size_is_taken_for(landing):
    """At 60 x sf0.1 the 35 million ids of the fetched documents were taken for 1.2 MB, and broadcast."""
    errors = registry.ingest_errors(landing)
    for _ in range(2):  # as planned, then as run
        plan = errors._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan
        assert errors.collect()
