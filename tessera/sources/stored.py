"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that drops the shuffle files of a run once it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on this machine alone gets a folder of its own; on a cluster that
    would be another folder on every machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application stores."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application stored.

    A result is read from stored tables when it is used, so they live until this is called: after
    the results have been written elsewhere, or at the application's end.
    """
    _delete(spark, session_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go once it is over; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the plan before them, and a table
    that is used several times is computed once. What was shuffled for it goes as soon as it is written.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that `stored` gave and nothing reads any more, such as the last step of a loop; others are left alone."""
    for t in tables:
        if path := getattr(t, "__dict__", {}).get("_stored_at"):
            _delete(t.sparkSession, path)
