"""Session helpers: configuration, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "clausegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    Parallelism is left to the cluster: AQE coalesces or splits shuffle
    partitions at run time, so only the upper bound is given here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="clausegrid-")
    sc.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so retries cannot mix outputs."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table under the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Paths written inside each ``passing_tables``, the innermost last.
_PASSING: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end, but for the lasting ones.

    For jobs whose result is written inside as a lasting table: its retries read no other.
    """
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            remove(spark, path)


def materialize(df: DataFrame, label: str = "stage", lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs. The written table survives executor
    loss, is computed once, and gives AQE exact sizes for the next join. A ``lasting`` table
    outlives the innermost ``passing_tables``.
    """
    path = scratch_path(df.sparkSession, label)
    scopes = _PASSING[:-1] if lasting else _PASSING
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, by a hash of the key, if the scan has fewer tasks than the
    cluster has cores. Large inputs have enough tasks and pass through without a shuffle.
    For work that costs far more per row than moving the row, such as regular expressions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
