"""Items: keys, splits, samples, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.plans.lineage import md5_order, number_rows, rank_within


def with_ids(items: DataFrame, prefix: str, *order: str, name: str = "new_id") -> DataFrame:
    """items with ids PREFIX_000001, PREFIX_000002, ... in the given order (which must be total)."""
    numbered = number_rows(items, *order, name="__n")
    digits = F.col("__n").cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return numbered.withColumn(name, F.concat(F.lit(f"{prefix}_"), padded)).drop("__n")


def split_parts(items: DataFrame, key: str, train: float = 0.75, val: float = 0.05, seed: int = 0) -> DataFrame:
    """items with part TRAIN, VAL or TEST: exact sizes by the order of md5(seed | key), the first int(train x n) rows
    being TRAIN, those up to int((train + val) x n) VAL. key must be unique."""
    n = items.count()
    numbered = number_rows(items.withColumn("__order", md5_order(seed, key)), "__order", key, name="__n")
    part = F.when(F.col("__n") <= int(train * n), "TRAIN").when(F.col("__n") <= int((train + val) * n), "VAL").otherwise("TEST")
    return numbered.withColumn("part", part).drop("__order", "__n")


def part_of(items: DataFrame, key: str, train: float = 0.75, val: float = 0.05, seed: int = 0) -> Column:
    """The part that split_parts() gives a row, as an expression of its key, so that wide rows need neither move nor meet
    a table of parts. Keys alone are numbered; the rows at the two bounds reach the driver. key must be unique."""
    keys = items.select(key)
    n = keys.count()
    order, last = md5_order(seed, key), [int(train * n), int((train + val) * n)]
    numbered = number_rows(keys.withColumn("__order", order), "__order", key, name="__n")
    bounds = {r["__n"]: (r["__order"], r[key]) for r in numbered.where(F.col("__n").isin(last)).collect()}
    kind = keys.schema[key].dataType

    def upto(k: int) -> Column:
        if k not in bounds:
            return F.lit(False)
        at, least = bounds[k]
        return (order < at) | (order == at) & F.coalesce(F.col(key) <= F.lit(least).cast(kind), F.col(key).isNull())

    return F.when(upto(last[0]), "TRAIN").when(upto(last[1]), "VAL").otherwise("TEST")


def sample_k(items: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows at random, always the same: the first k in the order of md5(seed | key)."""
    order = md5_order(seed, key)
    return items.orderBy(order, key).limit(k)


def every_nth(items: DataFrame, n: int, *order: str) -> DataFrame:
    """Every n-th row of the order, from the first."""
    return number_rows(items, *order, name="__n").where((F.col("__n") - 1) % n == 0).drop("__n")


def shuffled(items: DataFrame, key: str, epoch: int) -> DataFrame:
    """items in an order that depends on the epoch only."""
    return items.orderBy(md5_order(epoch, key), key)


def batches_of(items: DataFrame, size: int, *order: str, whole: bool = False) -> DataFrame:
    """items with the number of their batch, from 0; with whole, rows of an incomplete last batch go."""
    numbered = number_rows(items, *order, name="__n").withColumn("batch", F.floor((F.col("__n") - 1) / size))
    if whole:
        numbered = numbered.where(F.col("batch") < items.count() // size)
    return numbered.drop("__n")


def stratified_sample(items: DataFrame, group: str, key: str, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """(group, key, part): int(n_group / n x n_test) rows of each group for TEST, then int(n_group / n x n_train) of
    the rest for TRAIN, by the order of md5(seed | key). With no more than n_train + n_test rows, TRAIN takes what TEST leaves."""
    n = items.count()
    ranked = rank_within(items.select(group, key).withColumn("__order", md5_order(seed, key)), group, "__order", key)
    sizes = items.groupBy(group).count().withColumnRenamed(group, "__g")
    joined = ranked.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    test = F.floor(F.col("count") * n_test / F.lit(max(n, 1)))
    train = F.lit(n) if n <= n_train + n_test else F.floor(F.col("count") * n_train / F.lit(max(n, 1)))
    part = F.when(F.col("rank") <= test, "TEST").when(F.col("rank") <= test + train, "TRAIN")
    return joined.select(group, key, part.alias("part")).where(F.col("part").isNotNull())


def tagged(items: DataFrame, key: str, members: dict[str, DataFrame], name: str = "part") -> DataFrame:
    """items with the first of the given tags whose table holds the key; null if none does."""
    out, found = items, []
    for i, (tag, table) in enumerate(members.items()):
        column = f"__m{i}"
        out = out.join(table.select(F.col(key).alias(column)).distinct(), F.col(key) == F.col(column), "left")
        found.append(F.when(F.col(column).isNotNull(), F.lit(tag)))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"__m{i}" for i in range(len(members))])


def with_fallback(left: DataFrame, right: DataFrame, key: str, right_key: str, fallback: Column) -> DataFrame:
    """left joined with right on key, or where that misses on the fallback key; rows that miss both go.

    right must have one row for each key and no column of left.
    """
    first = left.join(right, F.col(key) == F.col(right_key), "left")
    hit = first.where(F.col(right_key).isNotNull())
    miss = first.where(F.col(right_key).isNull()).select(*left.columns)
    return hit.unionByName(miss.join(right, fallback == F.col(right_key)))


def first_seen(items: DataFrame, value: str, *order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return items.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).select(value, "first.*")


def best_of(items: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The row of each group with the highest score; of equal scores the one that comes later."""
    best = items.groupBy(group).agg(F.max(F.struct(F.col(score), F.col(tie), F.struct(*[c for c in items.columns if c not in (group, score, tie)]).alias("rest"))).alias("b"))
    return best.select(group, f"b.{score}", f"b.{tie}", "b.rest.*")


def top_within(items: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows for each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return items.withColumn("place", place).where(F.col("place") <= k)
