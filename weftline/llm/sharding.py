"""Sharding by extendible hashing: a directory indexed by hash-prefix bits whose oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, table, text_of

#: Bits of the hash of an id: 15 hex digits of md5.
BITS = 60

#: Bits of the directory below the depth at which an even hash would fit; what still is too large goes on from there.
SPARE = 5

#: Bytes of text in a shard.
LIMIT = 1 << 20


def assign_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard_depth, shard_prefix, shard_docs, shard_bytes, oversized) for each row of docs.

    The shard of a row is the shortest prefix of its hash whose bucket holds at most limit bytes of text (UTF-8).
    Splitting a bucket on another bit leaves all others alone, as in Fagin et al. (1979). A bucket whose rows all
    have the same hash, such as a single document above the limit or a repeated doc_id, cannot split; it stays at the
    depth where it became alone, marked oversized if it is above the limit. Sizes of all depths come from one
    aggregate on hash prefixes, which combines before the shuffle. Buckets too large at the deepest of them go
    another round with more bits; only their rows do. A null text has 0 bytes, a null id hashes as 'null'. An empty
    table gives no rows. Other columns are ignored.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    rows = docs.select(
        "doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"),
        F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("h"),
    )
    rows = cut(rows, "hashes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, bits = 0, min(BITS, max(1, math.ceil(math.log2(max(total, 1) / limit)) + SPARE if total > limit else 1))
    done: list[DataFrame] = []
    while True:
        fine = rows.groupBy(F.shiftright("h", BITS - bits).alias("f")).agg(F.count("*").alias("c"), F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        level = fine.select("*", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("d"))
        level = level.groupBy("d", F.expr(f"shiftright(f, {bits} - d)").alias("p")).agg(F.sum("c").alias("c"), F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = cut(level.where((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "p", "c", "b"), "fits")
        # what lies in a bucket that fits also fits, so a leaf is one whose parent does not; no key has over two rows
        above = fits.select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
        leaf = fits.join(above, ["d", "p"], "left_anti")
        first, past = F.expr(f"shiftleft(p, {bits} - d)"), F.expr(f"shiftleft(p + 1, {bits} - d) - 1")
        leaf = leaf.select(F.explode(F.sequence(first, past)).alias("f"), F.struct("d", "p", "c", "b").alias("s"))
        leaf = cut(fine.select("f").join(leaf, "f", "left"), "directory")
        marked = rows.withColumn("f", F.shiftright("h", BITS - bits)).join(leaf, "f")
        done.append(marked.where("s is not null").select(
            "doc_id", "n_bytes", F.col("s.d").alias("shard_depth"), F.col("s.p").alias("shard_prefix"),
            F.col("s.c").alias("shard_docs"), F.col("s.b").alias("shard_bytes"), (F.col("s.b") > limit).alias("oversized"),
        ))
        if leaf.where("s is null").isEmpty():
            break
        rows = cut(marked.where("s is null").select("doc_id", "n_bytes", "h"), "hashes")
        top, bits = bits, min(BITS, bits + SPARE + 3)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """docs as Parquet under path, one folder for each shard, named by its depth and prefix.

    All columns of docs are in the files. The folder column is called shard, or with underscores before it where docs
    has a column of that name.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    shards = assign_shards(docs, limit).select(F.col("doc_id").alias("__id"), F.concat_ws("-", "shard_depth", "shard_prefix").alias(name)).distinct()
    joined = docs.join(shards, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
    joined.repartition(name).write.partitionBy(name).parquet(path)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {BITS // 4}))::BIGINT AS h
  FROM documents
),
x AS (SELECT *, d, h >> ({BITS} - d)::INT AS p FROM r, range(0, {BITS + 1}) AS g(d)),
l AS (
  SELECT d, p, count(*) AS c, sum(n_bytes)::BIGINT AS b FROM x GROUP BY d, p
  HAVING sum(n_bytes) <= {LIMIT} OR min(h) = max(h)
)
SELECT doc_id, n_bytes, d::INT AS shard_depth, p AS shard_prefix, c AS shard_docs, b AS shard_bytes, b > {LIMIT} AS oversized
FROM x JOIN l USING (d, p)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
"""
