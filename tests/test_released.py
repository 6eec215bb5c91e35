"""The test-data build leaves no dead shuffle files on the executors' disks."""

from __future__ import annotations

import os
import time

import pytest

from shoplens.session import released_shuffles
from shoplens.sources import silver

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark) -> set[str]:
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {n for n in map(os.path.basename, names.split("\n")) if n.startswith("shuffle_")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_a_build_leaves_no_shuffle_files(spark, tmp_dir):
    before = _shuffle_files(spark)
    silver.materialize(spark, SF, root=os.path.join(tmp_dir, "silver"))
    for _ in range(20):  # files are deleted aside
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    assert not left


def test_the_setting_is_given_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), released_shuffles(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key, None) == before
