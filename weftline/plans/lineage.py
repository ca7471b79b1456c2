"""Materialised tables in the shared folder, and numbering of rows without one big task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_folders: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended before; a folder of local mode can still be removed
        if folder.startswith("file:") and tempfile.gettempdir() in folder:
            shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def working_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. It goes when the driver exits."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df below spark.checkpoint.dir, which all executors share, and read it back."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with the 1-based number of each row in the total order of the given columns.

    Rows are dealt out by ranges of the order and numbered within each range; offsets come from one count for each
    range. No task sees more than a range, unlike row_number() over the whole table.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part").count()  # one row for each partition
    offsets = counts.select(F.col("__part").alias("__part_of_offset"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    joined = dealt.withColumn("__r", inner).join(F.broadcast(offsets), F.col("__part") == F.col("__part_of_offset"))
    return joined.withColumn(name, F.col("__offset") + F.col("__r").cast("long")).drop("__part", "__part_of_offset", "__offset", "__r")


def rank_within(df: DataFrame, group: str, *order: str, name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row within its group, for groups of any size."""
    numbered = materialise(number_rows(df, group, *order, name="__n"))
    first = numbered.groupBy(group).agg(F.min("__n").alias("__first")).withColumnRenamed(group, "__group")
    joined = numbered.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__n") - F.col("__first") + 1).drop("__n", "__first", "__group")


def md5_order(seed: int | str, column: str | Column) -> Column:
    """A reproducible pseudo-random order key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column) if isinstance(column, str) else column).cast("binary"))
