"""Shared helpers: tables, the shared folder that cuts lineage, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of the class [\x20\x09-\x0D], the only ones that the operators here treat as blank.
BLANKS = " \t\n\x0b\x0c\r"

#: The same class for Python's and Java's regular expressions.
BLANK_CLASS = r"[\x20\x09-\x0D]"


#: Ids, and bytes of them as text, that are broadcast.
MOST_IDS, MOST_ID_BYTES = 1_000_000, 16 << 20

#: Bytes of a partition that compact() aims at.
FILE_BYTES = 32 << 20


#: Bytes of whole texts that go to Python at a time, and rows of them that a Parquet reader holds. Spark's own limits, 64 MB
#: and 4,096 rows, are held several times over by each task.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries and the pipeline. Lowers the session's limits of batches, which Spark has no options for
    that would hold for one plan alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables that cut lineage.

    On a cluster it must be named in spark.checkpoint.dir. Local mode, where there is one machine, falls back to a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/weftline-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone; a folder of local mode can still be removed
        if folder.startswith("file:") and "/weftline-" in folder and tempfile.gettempdir() in folder:
            shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors never force its inputs to be redone.

    The tables live as long as the application; its folder is removed when the driver exits.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids (its first column), marked for broadcast if it is counted to be small; beyond that as it is,
    so that Spark shuffles it and what it is joined with."""
    n, size = ids.agg(F.count("*"), F.sum(F.octet_length(F.col(ids.columns[0]).cast("string")))).first()
    return F.broadcast(ids) if n <= MOST_IDS and (size or 0) <= MOST_ID_BYTES else ids


def compact(df: DataFrame) -> DataFrame:
    """df in partitions of about FILE_BYTES by Spark's own estimate of its size, without a shuffle, for tables that are
    written next; never in fewer than four for each core, nor in more than it has."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, size // FILE_BYTES), 1 << 30))


def drop_table(df: DataFrame) -> None:
    """Remove a table that cut() wrote and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rpartition("/")[0])


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row, which tells rows apart that share an id."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}).cast("binary"))


def sha256_text(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text, as the fold rules use it; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def batches(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on one Arrow batch, for mapInArrow."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                yield from function(frame)

    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) on distributed tables: each is a minimum
    per node, which combines before the shuffle, and a join, whose hot nodes adaptive execution splits. No
    neighbourhood is ever gathered. Stops when a round leaves the edges as they were. Nulls are not nodes.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node goes to the smallest node around it
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        star = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        low = star.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = star.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = cut(small.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
