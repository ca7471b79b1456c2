"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, table, text_of

#: A Poisson variable with a larger mean is the sum of several with at most this one.
PART = 8.0

#: Terms of the distribution function of one part; at mean 8 the rest is below 1e-40.
TERMS = 72

#: Rates of no more sources, with no more bytes of names, are broadcast.
MOST_SOURCES, MOST_NAME_BYTES = 10_000, 1 << 20

#: Parts into which a hot source is salted when the rates are too many to broadcast.
SALT = 64

SEED = "mix-1"


def _uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, measure: str = "chars") -> DataFrame:
    """(source, size, rate) for each source: rate is the mean number of copies of each of its documents.

    The rate is weight / sum of weights x total / size, with size the characters or documents of the source over all
    rows. total is the size of the mixture, as large as the input if not given. Without weights every source has the
    same one. Sources without a weight, or with one of 0, get the rate 0 and leave. A source of size 0 (only empty
    texts) cannot take up its share; its rate is 1. A null source is a source of its own.
    """
    if measure not in ("chars", "documents"):
        raise ValueError(f"measure is chars or documents, not {measure!r}")
    size = F.sum(F.length(text_of()).cast("long")) if measure == "chars" else F.count("*")
    sizes = cut(docs.groupBy("source").agg(size.alias("size")), "sizes")
    whole, n = sizes.agg(F.sum("size"), F.count("*")).first()
    if weights is None:
        weighted, norm = sizes.withColumn("w", F.lit(1.0)), float(n or 1)
    else:
        if any(not w >= 0 for w in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights must not be negative, and one must be above 0")
        given = sizes.sparkSession.createDataFrame(list(weights.items()), "__s string, w double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        norm = float(weighted.agg(F.sum("w")).first()[0] or 1)
    weighted = weighted.withColumn("w", F.coalesce("w", F.lit(0.0)))
    rate = F.col("w") / F.lit(norm) * F.lit(float(total if total is not None else whole or 0)) / F.col("size")
    rate = F.when(F.col("w") == 0, 0.0).when(F.col("size") == 0, 1.0).otherwise(rate)
    return weighted.select("source", "size", rate.alias("rate"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, measure: str = "chars", seed: str = SEED) -> DataFrame:
    """docs with every row repeated a Poisson number of times, in a global random order; adds __copy and __key.

    The number comes from inverting the Poisson distribution at a uniform hash of seed and doc_id, so reruns and
    retries agree, and rows with the same doc_id are repeated equally often. A mean above PART is split into
    independent parts, each with a hash of its own, so that nothing underflows. __copy counts from 1. __key is a
    hash of seed, doc_id and copy; rows are dealt out by it and sorted by it within each partition. The rates, one
    row for each source, are broadcast up to a checked size; beyond it, documents and rates meet by source and salt.
    All columns of docs pass through; names that start with two underscores are reserved. A null text has size 0, a
    null source is a source of its own, a null doc_id hashes as 'null', and repeated rows are repeated equally often.
    An empty table gives no rows.
    """
    rates = source_rates(docs, weights, total, measure)
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART).cast("double"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-F.col("l")).alias("p"), F.array(F.exp(-F.col("l"))).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("l") / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("l") / k)).alias("c")),
        lambda a: a["c"],
    )
    rates = rates.withColumn("__parts", parts.cast("int")).withColumn("l", F.col("rate") / parts)
    rates = cut(rates.select(F.col("source").alias("__source"), "__parts", terms.alias("__cdf")), "rates")
    n, name_bytes = rates.agg(F.count("*"), F.sum(F.octet_length("__source"))).first()
    same = F.col("source").eqNullSafe(F.col("__source"))
    if n <= MOST_SOURCES and (name_bytes or 0) <= MOST_NAME_BYTES:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        left = docs.withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
        joined = left.join(salted, same & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")
    hashes = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: _uniform(seed, F.col("doc_id"), j))  # once for each part
    copies = F.aggregate(hashes, F.lit(0), lambda a, u: a + F.size(F.filter("__cdf", lambda c: c <= u)))
    joined = joined.withColumn("__copies", copies).where("__copies > 0")
    out = joined.withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).drop("__copies", "__parts", "__cdf", "__source")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "__copy").cast("binary"))
    return out.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, measure: str = "chars", seed: str = SEED) -> DataFrame:
    """The columns of docs only, rows as replicate() gives them."""
    return replicate(docs, weights, total, measure, seed).select(*docs.columns)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to equal weights of the sources, by characters, at the size of the input."""
    mixed = replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__copy").alias("copy"), F.col("__key").alias("mix_key"), "source", "lang", "text")


SQL = rf"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS whole, count(*)::DOUBLE AS n FROM s),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE 1.0 / n * whole / size END AS rate FROM s, t),
p AS (SELECT source, greatest(1, ceil(rate / {PART}))::INT AS parts, rate / greatest(1, ceil(rate / {PART})) AS l FROM r),
c AS (
  SELECT source, k, sum(exp(-l + k * ln(l) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM p, range(0, {TERMS}) AS g(k)
),
u AS (
  SELECT d.doc_id, d.source, j,
         ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, parts + 1)) AS g(j)
),
n AS (
  SELECT doc_id, count(*) AS copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY doc_id
)
SELECT d.doc_id, copy::INT AS copy, md5('{SEED}:order:' || d.doc_id || ':' || copy) AS mix_key, source, lang, text
FROM documents d JOIN n USING (doc_id), unnest(range(1, copies + 1)) AS g(copy)
"""
