"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build_session(app: str = "fillgauge", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators expect; cluster settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fillgauge-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in this application's part of the work folder that nothing has written to yet."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark).rstrip('/')}/fillgauge-{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.

    For the end of a run, once all results have been written: DataFrames that the
    operators returned may still read these tables.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def replace_path(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder beside ``path`` and then put it in its place.

    If writing fails the old content stays.  The change itself is two renames; if the
    second fails the old folder is put back.
    """
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())

    def beside(label: str):
        return sc._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{label}-{uuid.uuid4().hex}")

    fresh, old = beside("new"), beside("old")
    fs.mkdirs(target.getParent())
    try:
        write(fresh.toString())
    except BaseException:
        fs.delete(fresh, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path} cannot be replaced")
    if had:
        fs.delete(old, True)


def settle(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once to the work folder and read it back; ``options`` are those of the Parquet writer.

    Cuts the lineage, survives lost executors, and gives the planner the true
    size of the table for its join choice.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, jobs: Sequence[Callable[[], T]], threads: int = 8) -> list[T]:
    """Run independent driver steps side by side, so their small jobs share the cluster."""
    if len(jobs) < 2 or threads < 2:
        return [job() for job in jobs]
    wrap = inheritable_thread_target(spark)
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(lambda job: wrap(job)(), list(jobs), chunksize=1)
