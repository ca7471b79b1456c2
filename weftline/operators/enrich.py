"""Enrichment of items category by category, which can be stopped anywhere and goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Categories that a run may have; their names reach the driver.
MOST_CATEGORIES = 10_000

MANIFEST = "run string, category string, rows long, failed long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The finished categories of each run below root."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _finished(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of finished categories, failed ones too (answer is null): schema, __run and __category."""
    finished = manifest(spark, root)
    if finished.isEmpty():
        return spark.createDataFrame([], f"{schema}, __run string, __category string")
    rows = spark.read.schema(f"{schema}, __run string, __category string").parquet(f"{root}/rows")
    known = finished.select(F.col("run").alias("__run"), F.col("category").alias("__category")).distinct()
    return rows.join(F.broadcast(known), ["__run", "__category"], "left_semi")  # at most MOST_CATEGORIES for each run


def enriched(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The answers of finished categories, of all runs: schema (the key and answer), __run and __category. What a
    stopped run left of a category does not count."""
    return _finished(spark, root, schema).where("answer is not null")


def enrich(items: DataFrame, key: str, category: str, ask: Callable[[DataFrame], DataFrame], answer: Column, root: str, run: str, at_once: int = 8) -> DataFrame:
    """Asks about the items that no earlier run has an answer for, at_once categories at a time; returns the manifest.

    ask gives the items further columns; answer, an expression on these, is null where nothing can be made of what came
    back: such rows count as failed, and a later run asks about them again. The rows of a group are written to folders
    of its categories and this run, in place of what a stopped try left there; the manifest's rows then make the
    categories count. A run that is called again does only what it has not finished. Null keys are asked about like
    others, a null category is called __null__. root is a folder that driver and executors share.
    """
    spark = items.sparkSession
    named = items.withColumn("__category", F.coalesce(F.col(category).cast("string"), F.lit("__null__")))
    names = [r[0] for r in named.select("__category").distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"at most {MOST_CATEGORIES} categories")
    done = {r[0] for r in manifest(spark, root).where(F.col("run") == run).select("category").collect()}
    todo = sorted(set(names) - done)
    for at in range(0, len(todo), at_once):
        group = todo[at : at + at_once]
        asked = ask(named.where(F.col("__category").isin(group))).withColumn("answer", answer).withColumn("__run", F.lit(run)).select(key, "answer", "__run", "__category")
        schema = f"`{key}` {asked.schema[key].dataType.simpleString()}, answer {asked.schema['answer'].dataType.simpleString()}"
        known = enriched(spark, root, schema).where(F.col("__category").isin(group)).select(F.col(key).alias("__known")).distinct()
        new = named.where(F.col("__category").isin(group)).join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
        asked = ask(new).withColumn("answer", answer).withColumn("__run", F.lit(run)).select(key, "answer", "__run", "__category")
        asked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__run", "__category").parquet(f"{root}/rows")
        read = spark.read.schema(asked.schema).parquet(f"{root}/rows").where((F.col("__run") == run) & F.col("__category").isin(group))
        counts = {r["__category"]: (r["n"], r["bad"]) for r in read.groupBy("__category").agg(F.count("answer").alias("n"), F.count_if(F.col("answer").isNull()).alias("bad")).collect()}
        spark.createDataFrame([(run, name, *counts.get(name, (0, 0))) for name in group], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return manifest(spark, root)
