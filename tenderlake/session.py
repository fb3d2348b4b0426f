"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Operators never rely on these: they are the settings the package runs best with.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are large rows: small Arrow batches bound the Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build_session(app: str = "tenderlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master, where driver and executors are one machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    root = root or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tenderlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


_FOLDERS: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one. The file system deletes it when the application ends:
    what lies in it is read by results that may be asked for until then."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        path = os.path.join(shared_dir(spark), f"tenderlake-{application}-{uuid.uuid4().hex[:8]}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _FOLDERS[application] = path
    return _FOLDERS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")


_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder.

    Later readers neither recompute it nor lose it with an executor, and read only the columns they use.
    """
    return _stored(df, _SCOPE.get())


def _stored(df: DataFrame, folder: str | None) -> DataFrame:
    path = os.path.join(folder or run_folder(df.sparkSession), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, or a folder of them, that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``cut`` stores inside is deleted at the end. The function given stores like ``cut``, but for whoever
    comes after: all that is read later must go through it."""
    outer, folder = _SCOPE.get(), scratch_path(spark, "passing")
    token = _SCOPE.set(folder)
    try:
        yield lambda df: _stored(df, outer)
    finally:
        _SCOPE.reset(token)
        delete(spark, folder)
