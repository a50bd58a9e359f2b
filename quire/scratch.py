"""Shared scratch space for lineage cuts.

Everything that is written between jobs goes below the folder that the cluster
names in ``spark.checkpoint.dir``, through Spark's own writers, so that every
executor sees it and a lost executor loses nothing.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where the setting is missing and all executors are in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends in good order."""
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already; the folder is scratch space
        pass


#: Spark's setting by which a finished action deletes its shuffle files, in place of keeping them until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows and bytes of a batch that Spark hands to Python where the rows hold whole texts. Its own 10,000 rows are some 35 MB of
#: text, which an executor holds several times for each task: as vectors, as the message, and in the worker.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Actions inside run under ``values``; later ones are left as the session has it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_deleted(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Actions inside delete their shuffle files when they end."""
    return settings(spark, {CLEANUP: "true"})


def text_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Actions inside hand texts to Python in small batches."""
    return settings(spark, TEXT_BATCHES)


def materialize(df: DataFrame, label: str, rows: int | None = None, rows_per_file: int = 500_000) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: a lineage cut that survives lost executors.

    ``rows``, where the caller knows about how many narrow rows there are, keeps small tables from becoming many tiny files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_deleted(spark):  # the written table is read from now on, so nothing asks for them again
        fewer(df, rows, rows_per_file).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: neither a pending query nor one that a lost executor may set back."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def fewer(df: DataFrame, rows: int | None, rows_per_file: int = 500_000) -> DataFrame:
    """``df`` in as many partitions as ``rows`` narrow rows fill, at least one for each core; never more than before."""
    if rows is None:
        return df
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // rows_per_file + 1))
