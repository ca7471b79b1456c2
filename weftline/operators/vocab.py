"""Vocabularies and dictionary encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.plans.lineage import number_rows


def _words(items: DataFrame, words: str) -> DataFrame:
    """(word) of all lists. The outer form keeps Spark from inferring a filter on the list, which it would push below
    joins and so work out the words of every row twice."""
    return items.select(F.explode_outer(words).alias("word")).where("word is not null")


def _places(items: DataFrame, key: str, words: str) -> DataFrame:
    """(key, pos, word) of all lists."""
    return items.select(key, F.posexplode_outer(words).alias("pos", "word")).where("word is not null")


def counts(items: DataFrame, words: str, least: int = 1) -> DataFrame:
    """(word, n) of the words of the token lists that occur at least `least` times."""
    return _words(items, words).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def index(items: DataFrame, key: str, words: str, least: int = 1) -> DataFrame:
    """(word, n, ix): words that occur often enough, numbered from 1 by first occurrence (order of key, then place).

    0 is left for padding.
    """
    seen = _places(items, key, words).groupBy("word")
    found = seen.agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("f")).where(F.col("n") >= least)
    found = found.select("word", "n", F.col("f")[key].alias("__k"), F.col("f")["pos"].alias("__p"))
    return number_rows(found, "__k", "__p", name="ix").drop("__k", "__p")


def index_by_frequency(items: DataFrame, key: str, words: str) -> DataFrame:
    """(word, n, ix): words numbered from 1 by falling count, then first occurrence."""
    seen = _places(items, key, words).groupBy("word")
    found = seen.agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("f"))
    found = found.select("word", "n", (-F.col("n")).alias("__n"), F.col("f")[key].alias("__k"), F.col("f")["pos"].alias("__p"))
    return number_rows(found, "__n", "__k", "__p", name="ix").drop("__n", "__k", "__p")


def encode(items: DataFrame, key: str, words: str, vocabulary: DataFrame) -> DataFrame:
    """(key, seq) with the indices of the words that the vocabulary has, in order; lists without any give an empty one.

    The vocabulary is joined, not shipped: adaptive execution broadcasts it while it is small.
    """
    at = _places(items, key, words)
    found = at.join(vocabulary.select("word", "ix"), "word")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "ix"))).alias("l"))
    lists = lists.select(F.col(key).alias("__key"), F.col("l.ix").alias("seq"))
    return items.select(key).join(lists, F.col(key) == F.col("__key"), "left").select(key, F.coalesce("seq", F.array().cast("array<bigint>")).alias("seq"))


def decode(items: DataFrame, key: str, seq: str, vocabulary: DataFrame) -> DataFrame:
    """(key, words): the inverse of encode(), joined by spaces; 0 and unknown indices are left out."""
    at = items.select(key, F.posexplode(seq).alias("pos", "ix"))
    found = at.join(vocabulary.select("word", "ix"), "ix")
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("l"))
    lists = lists.select(F.col(key).alias("__key"), F.array_join("l.word", " ").alias("words"))
    return items.select(key).join(lists, F.col(key) == F.col("__key"), "left").select(key, F.coalesce("words", F.lit("")).alias("words"))


def matrix(vocabulary: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(ix, word, vec): the vector of each word of the vocabulary, zeros where there is none."""
    empty = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return vocabulary.join(vectors.select("word", "vec"), "word", "left").select("ix", "word", F.coalesce("vec", empty).alias("vec"))
