"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a single-JVM local session, where there is one machine, gets a folder of its own.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        path = _own_dirs.get(context.applicationId)
        if path is None:
            path = _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="flowquarry-")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flowquarry/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_table(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    delete_path(df.sparkSession, df._flowquarry_path)


@contextmanager
def eager(spark: SparkSession):
    """Inside, shuffle files of a finished action are removed at once instead of when the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_KEY)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_KEY, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with eager(spark):
        df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    table = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    table._flowquarry_path = path
    return table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]"), "")


def cluster_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
