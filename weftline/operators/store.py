"""A store of training examples: tables in buckets of one key, which meet without a shuffle, and epochs by row number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.permute import permuted
from weftline.plans.lineage import working_folder


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """df written once in buckets of a key, sorted by it, and read back with that layout known to the planner.

    Tables with the same number of buckets join on the key, in any number of epochs, without moving a row again. The
    files are below path, or a folder of the session's own. A key that holds very many rows makes one bucket large:
    more buckets don't split it; joins of such tables should go without this layout. Null keys are kept in a bucket.
    """
    spark, name = df.sparkSession, f"store_{uuid.uuid4().hex}"
    # one task for each bucket, so that a bucket is one file
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path or working_folder(spark)).saveAsTable(name)
    return spark.table(name)


def batch_of(rows: DataFrame, number: str, n: int, epoch: int, batch: int, size: int) -> DataFrame:
    """The rows of a batch of an epoch, with their places. number: a column that numbers the n rows from 0.

    The numbers at the batch's places come from the inverse permutation, so a batch is a join of `size` numbers with
    the store, not an order of all rows.
    """
    places = rows.sparkSession.range(min(batch * size, n), min((batch + 1) * size, n)).withColumnRenamed("id", "place")
    wanted = places.select("place", permuted(F.col("place"), n, epoch, inverse=True).alias("__number"))
    return rows.join(wanted, F.col(number) == F.col("__number")).drop("__number")
