"""Reading tables, cutting lineage with files that every executor can reach, and deleting those files again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: dict[str, list[DataFrame]] = {}
_local = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set a temporary folder serves a local master, whose tasks run on this machine;
    on a cluster executors could not share it, so that is an error.
    """
    sc = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return given.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="cutweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[sc.applicationId] = "file://" + folder
    return _own[sc.applicationId]


class Scratch:
    """The tables made within a ``scratch()`` block."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` outlives the block: the block around it, or else the session, holds it from now on."""
        self.tables = [t for t in self.tables if t is not df]
        outer = _scopes()[:-1]
        (outer[-1].tables if outer else _left.setdefault(df.sparkSession.sparkContext.applicationId, [])).append(df)
        return df


def _scopes() -> list[Scratch]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch() -> Iterator[Scratch]:
    """At the end of the block the files of all tables made inside are deleted, but for those kept."""
    own = Scratch()
    _scopes().append(own)
    try:
        yield own
    finally:
        _scopes().pop()
        for df in own.tables:
            discard(df)


def release(spark: SparkSession) -> None:
    """Delete all tables of the session that results still read: for the end of a job, once those are written."""
    for df in _left.pop(spark.sparkContext.applicationId, []):
        discard(df)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again; ``by`` names columns that become folders.

    This cuts the lineage: executors may be lost afterwards without recomputing
    what stands before, and each later use reads columns and not a whole plan.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cutweave_path = path
    scopes = _scopes()
    (scopes[-1].tables if scopes else _left.setdefault(spark.sparkContext.applicationId, [])).append(back)
    return back


def bucketed(df: DataFrame, name: str, by: str, *, dealt: bool = False) -> DataFrame:
    """As :func:`materialise`, dealt and sorted by ``by`` into as many buckets as a shuffle has partitions: joins and groups by it don't move these rows.

    Rows that are ``dealt`` already, as those that come out of groups by it, are neither moved nor sorted.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, called = fresh_path(spark, name), f"cutweave_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(n, by) if dealt else df.repartition(n, by).write.bucketBy(n, by).sortBy(by)
    writer.option("path", path).saveAsTable(called)
    back = spark.table(called)
    back._cutweave_path, back._cutweave_table = path, called
    scopes = _scopes()
    (scopes[-1].tables if scopes else _left.setdefault(spark.sparkContext.applicationId, [])).append(back)
    return back


def written(df: DataFrame) -> bool:
    """Whether ``df`` is a table of :func:`materialise` or :func:`bucketed` itself, whose files are still there."""
    return getattr(df, "_cutweave_path", None) is not None


def apart(df: DataFrame) -> DataFrame:
    """``df`` for joins in which it grows with the input: both sides are shuffled, and it is never sent whole through the driver."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` or :func:`bucketed` that no plan needs any more."""
    path = getattr(df, "_cutweave_path", None)
    if path:
        df._cutweave_path = None
        spark = df.sparkSession
        if called := getattr(df, "_cutweave_table", None):
            spark.sql(f"drop table if exists {called}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
