"""Deduplication of a stream of pages against everything seen before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.text import canonical_url


def unseen(stream: DataFrame, url: str = "url") -> DataFrame:
    """The first page of each link without its query; the state store keeps the links across restarts."""
    return stream.withColumn("seen_key", canonical_url(F.col(url))).dropDuplicates(["seen_key"])


def run_available(spark: SparkSession, path: str, root: str) -> DataFrame:
    """All pages that are below path now through unseen(), written and checkpointed below root, which is shared.

    The state holds every link ever seen, without a horizon: a link counts as seen for good.
    """
    schema = spark.read.parquet(path).schema
    out = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    # a stream takes a folder or a pattern: this one matches the path alone, be it a file or a folder
    pages = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    query = unseen(pages).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")
