import os
from types import SimpleNamespace

import pytest

from tracewright.session import materialize, release, shared_dir


def test_shared_tables(spark):
    df = spark.range(10).toDF("x")
    kept = materialize(df, "t")
    assert kept.count() == 10
    assert os.path.isdir(shared_dir(spark).removeprefix("file:"))
    assert release(spark) >= 1 and release(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default: default)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: pytest.fail("a folder of one machine"))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context))
