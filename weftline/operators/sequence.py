"""Training sequences from index lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.functions.text import pad


def next_words(items: DataFrame, key: str, seq: str, length: int) -> DataFrame:
    """(key, j, prefix, target): for each j from 1 the words before place j, padded on the left to length, and the word there.

    A longer prefix keeps its last length words, so that a row stays of fixed size however long the list is.
    """
    pairs = items.where(F.size(seq) > 1).select(key, seq, F.explode(F.sequence(F.lit(1), F.size(seq) - 1)).alias("j"))
    prefix = F.slice(F.col(seq), F.greatest(F.lit(1), F.col("j") - (length - 1)), F.least(F.col("j"), F.lit(length)))
    return pairs.select(key, "j", pad(prefix, length, left=True).alias("prefix"), F.get(seq, F.col("j")).alias("target"))


def shifted(items: DataFrame, key: str, seq: str, length: int) -> DataFrame:
    """(key, input, output): the list without its last and without its first word, padded on the right to length.

    Longer lists keep their first length words on either side, as a fixed row asks for; lists of fewer than two words go.
    """
    body = items.where(F.size(seq) > 1)
    return body.select(
        key, pad(F.slice(seq, 1, F.size(seq) - 1), length, left=False).alias("input"),
        pad(F.slice(seq, 2, F.size(seq) - 1), length, left=False).alias("output"),
    )
