"""Exact deduplication by progressive refinement: length, then a prefix hash, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BLANKS, cut, row_key, sha256_text, small, table, text_of

#: Characters of the normalised text that the second level hashes.
PREFIX = 64

#: Share of the rows that must be alone with their length for a filter by length to be worth a pass over the others.
WORTH = 0.1


def normalised(column: str | Column = "text") -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = text_of(column)
    for c in BLANKS:  # a search for bytes, many times as fast as translate(), which makes an object of each character
        out = F.replace(out, F.lit(c))
    return out


def _candidates(docs: DataFrame, prefix: int) -> DataFrame:
    """Ids (__id) of rows that share the length and the prefix hash of their normalised text with another row."""
    norm = normalised()
    light = cut(docs.select("doc_id", F.length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, prefix)).alias("ph")), "light")
    lengths = cut(light.groupBy("n").count(), "lengths")
    all_rows, left = lengths.agg(F.sum("count"), F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0))).first()
    level1 = light.join(lengths.where("count > 1").select("n"), "n", "left_semi") if (left or 0) < (1 - WORTH) * (all_rows or 0) else light
    heads = cut(level1.groupBy("n", "ph").count().where("count > 1").select("n", "ph"), "heads")
    return light.join(heads, ["n", "ph"], "left_semi").select(F.col("doc_id").alias("__id")).distinct()


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Rows that share their normalised text with another row: (doc_id, fh, keep_id, group_size), once per (doc_id, fh).

    Level 1 counts rows by length of the normalised text and, where that leaves enough rows alone, passes those over.
    Level 2 counts by length and prefix hash. Both levels move a few numbers per row. Only rows that are left then have
    their whole text hashed (SHA-256, fh) and are grouped by it; the row with the longest original text, then the
    smallest doc_id (a null id first) stays. Group counts combine before each shuffle, and a group is never gathered:
    its keeper comes from an aggregate that is joined back. The aggregates are small tables of their own, so that
    Spark either broadcasts them, by their size, or joins two plain shuffles, where adaptive execution splits a hot key.
    """
    full = docs.select("doc_id", F.length(text_of()).alias("cp"), text_of().alias("text"))
    full = full.join(small(cut(_candidates(docs, prefix), "candidates")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    hashed = cut(full.select("doc_id", "cp", F.unhex(sha256_text(normalised())).alias("fh")), "hashed")
    first = F.min(F.struct((-F.col("cp")).alias("x"), F.col("doc_id").alias("id")))
    groups = hashed.groupBy("fh").agg(F.count("*").alias("group_size"), first.alias("k")).where("group_size > 1")
    groups = cut(groups.select("fh", "group_size", F.col("k.id").alias("keep_id")), "keepers")
    return hashed.select("doc_id", "fh").distinct().join(groups, "fh")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (needs doc_id and text).

    Texts are equal when they are identical after deleting all of [\\x20\\x09-\\x0D]; null is the empty text, and
    empty texts are copies of each other. Rows that repeat a doc_id with an equal text are copies too: all carry the
    same values, so of kept rows one for each doc_id is to stay. A repeated doc_id with another text forms a row of
    its own. A null doc_id is an id like any other. An empty table gives no rows; further columns are ignored.
    """
    groups = exact_groups(docs, prefix).select(F.col("doc_id").alias("__id"), "fh", "group_size", "keep_id")
    rows = docs.select("doc_id", sha256_text(normalised()).alias("text_sha256"))
    joined = rows.join(groups, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.unhex("text_sha256") == F.col("fh")), "left")
    keep = F.when(F.col("fh").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept: the row with the longest original text, then
    the smallest doc_id (a null id first), then the smallest hash of all its columns.

    Where ids are unique, only the ids that go are joined back. Where one repeats, the rows of texts that have copies
    are told apart by the hash of their columns; of fully identical rows one stays. Columns that start with two
    underscores are reserved.
    """
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        groups = cut(exact_groups(docs, prefix), "groups")
        gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("__id"))
        return docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    ids = cut(_candidates(docs, prefix), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    marked = docs.withColumns({"__row": row_key(docs), "__cp": F.length(text_of()), "__sha": F.unhex(sha256_text(normalised()))}).join(ids, same, "left_semi")
    stays = marked.groupBy("__sha").agg(F.min(F.struct((-F.col("__cp")).alias("x"), "doc_id", "__row")).alias("__k"))
    stays = cut(stays.select(F.col("__sha").alias("__s"), F.col("__k.__row").alias("__r")), "keepers")
    kept = marked.join(stays, (F.col("__sha") == F.col("__s")) & (F.col("__row") == F.col("__r")), "left_semi")
    kept = kept.dropDuplicates(["__sha"]).select(*docs.columns)  # what is left of a text are identical rows
    return docs.join(ids, same, "left_anti").unionByName(kept)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS nt
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY nt) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(nt) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY nt ORDER BY cp DESC, doc_id)
"""
