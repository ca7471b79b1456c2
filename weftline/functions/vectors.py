"""Expressions on numeric arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero as floats are scaled: a negative one that vanishes is -0.0, as in SQL."""
    by = F.lit(10.0**digits)
    out = F.signum(x) * F.round(F.abs(x) * by, 0) / by
    return F.when(F.isnan(out) | (F.abs(out) == F.lit(float("inf"))), x).otherwise(out)


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.lit(float(by)))


def first_max(v: Column) -> Column:
    """The 0-based place of the first largest element; null for an empty array."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1)


def one_hot(ix: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == ix).cast("int"))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def position_mean(v: Column, width: int, digits: int | None = None) -> Column:
    """The mean of a grid over its positions: v holds them one after the other, width numbers each."""
    n = F.floor(F.size(v) / F.lit(width)).cast("int")

    def at(k: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, p: a + F.get(v, (p - 1) * width + k).cast("double"))
        return rounded(total / n, digits) if digits is not None else total / n

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at))


def hashed_bag(words: Column, width: int) -> Column:
    """Counts of the words of a list by hash modulo width, scaled to length 1; zeros for an empty list or none."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counted(places: pa.Array) -> pa.Array:  # one pass over the words, which lambdas within lambdas work out again for each number
        n, rows = len(places), np.repeat(np.arange(len(places)), pc.fill_null(pc.list_value_length(places), 0).to_numpy())
        count = np.bincount(rows * width + places.flatten().to_numpy(), minlength=n * width).reshape(n, width).astype(float)
        norm = np.sqrt((count * count).sum(1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array((count / np.where(norm > 0, norm, 1)).ravel()))

    return counted(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width))))
