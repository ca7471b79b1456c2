"""Readers with declared schemas, and writers."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.text import SPACE
from weftline.plans.lineage import materialise

#: A product item; producers leave fields out, which then are null.
ITEM = (
    "url string, date_scraped string, product_title string, product_color struct<name string, code string>, "
    "price struct<regular string, discount string>, description string, highlights array<string>, product_code string, "
    "composition_care_info array<string>, filename string, img_urls array<string>, _corrupt_record string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, path: str, extension: str = "*.txt", lines: bool = False) -> DataFrame:
    """JSON items below path, one per file or, with lines, one per line, with shop, gender (null in the flat layout) and category from the folders.

    Only files with the extension are read. Items that are no JSON keep their text in _corrupt_record.
    """
    reader = spark.read.schema(ITEM).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", extension)
    path_parts = F.split(F.input_file_name(), "/")
    at = F.array_position(path_parts, "ANNOS").cast("int")
    folders = F.when(at > 0, F.slice(path_parts, at + 1, F.size(path_parts) - at - 1))
    read = reader.json(path).withColumn("__folders", folders).withColumn("shop", F.when(at > 1, F.get(path_parts, at - 2)))
    two = F.size("__folders") > 1
    return read.withColumn("gender", F.when(two, F.get("__folders", F.lit(0)))).withColumn("category", F.element_at("__folders", -1)).drop("__folders")


def good_and_bad(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a description, and a side output of those that could not be parsed. Both read one written table."""
    read = materialise(read)
    good = read.where(F.col("_corrupt_record").isNull() & F.col("description").isNotNull() & (F.col("description") != ""))
    return good.drop("_corrupt_record"), read.where(F.col("_corrupt_record").isNotNull())


def vector_dim(name: str) -> int:
    """The width that a vector file's name announces, such as 300d."""
    for dim in (300, 200, 100, 50):
        if f"{dim}d" in name:
            return dim
    raise ValueError(f"no dimension in {name!r}")


def parse_vectors(lines: DataFrame, dim: int | None = None) -> DataFrame:
    """(word, vec) from lines (line_no, value) of a word and its numbers.

    Lines with something that is no number go, and with dim those of another width, among them the header of files
    that have one. Of a word's lines the last stays.
    """
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), SPACE if dim is None else " ")
    vec = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float"))
    rows = lines.select("line_no", F.element_at(parts, 1).alias("word"), vec.alias("vec")).where(~F.exists("vec", lambda x: x.isNull()))
    if dim is not None:
        rows = rows.where(F.size("vec") == dim)
    return rows.groupBy("word").agg(F.max_by("vec", "line_no").alias("vec"))


def vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Word vectors from a text file; the order of lines is that of their places in the file."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_vectors(lines, dim)


def configs(spark: SparkSession, names: str, folder_of: dict[str, str]) -> DataFrame:
    """JSON configurations named in one hyphen-joined list; the first two letters pick the folder."""
    paths = [os.path.join(folder_of[n[:2]], n) for n in names.split("-")]
    return spark.read.option("multiLine", True).json(paths).withColumn("config", F.element_at(F.split(F.input_file_name(), "/"), -1))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, length, content); empty, unknown and broken off ones go.

    A file stays if it begins and ends as JPEG, PNG or GIF files do; its pixels are not decoded.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") > 0)
    return found.where(whole_image(F.col("content")))


def whole_image(content: Column) -> Column:
    """Whether bytes have the beginning and the end of an image file."""
    head, tail = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, -12, 12))
    jpeg = head.startswith("FFD8FF") & tail.endswith("FFD9")
    png = (head == "89504E470D0A1A0A") & (tail == "0000000049454E44AE426082")
    gif = (head.startswith("474946383761") | head.startswith("474946383961")) & tail.endswith("3B")
    return F.coalesce(jpeg | png | gif, F.lit(False))


def write(df: DataFrame, path: str, kind: str = "parquet", partition: Iterable[str] = ()) -> None:
    """Parquet, JSON or CSV with a header."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    writer = df.write.partitionBy(*partition) if partition else df.write
    getattr(writer, kind)(path, **({"header": True} if kind == "csv" else {}))


def write_parts(df: DataFrame, path: str, *parts: str) -> None:
    """df as Parquet with a folder for each value of the part columns, which are to have few. Rows of a part come from
    all tasks, so that no part, however large, is one task's work."""
    df.write.partitionBy(*parts).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A table laid out in folders part=value, with its parts and their types found from the folders."""
    return spark.read.parquet(path)
