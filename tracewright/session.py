"""Session, shared-folder and skew helpers used by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are tuned for."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a temporary folder is made once and kept for the session, but only with a local master, where one
    machine is all there is. On a cluster every executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="tracewright-")
        sc.setCheckpointDir(set_dir)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir


_WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and the plan stays columnar."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tw-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has written into the shared folder; frames that read them end with that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

