"""Session defaults and the shared scratch area."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
#: Paths of the open ``scratch`` blocks, innermost last.
_OWNED: list[list[str]] = []


def build_session(app: str = "plaudit", master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the settings every job here relies on.

    The shuffle width is left to the cluster; adaptive execution coalesces it.  Callers that
    run locally pass ``master`` and ``**{"spark.sql.shuffle.partitions": "8"}``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.mergeSchema": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(overrides)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder serves a local master, whose tasks all run on
    this machine; on a cluster that is an error, as each machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="plaudit-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it belongs to the innermost open ``scratch`` block."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system Spark can write to; a path that is not there is no error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns every table that ``materialize`` stores inside the block, and removes them at its end.

    Results that outlive the block must be written or collected inside it.
    """
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            remove(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    For results with several consumers or iterative use.  The table outlives lost executors,
    and readers still get column pruning and predicate pushdown.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
