"""Keyed permutations of row numbers, as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: Rounds of the shuffle.
ROUNDS = 24


def round_key(key: int | str, round_: int, n: int) -> int:
    """The number of a round, below n."""
    return int(hashlib.md5(f"{key}|{round_}".encode()).hexdigest()[:15], 16) % n


def permuted(i: Column, n: int, key: int | str, inverse: bool = False) -> Column:
    """The place of row i of n (from 0) in the order of this key: a swap-or-not shuffle (Hoang, Morris, Rogaway 2012).

    Each round pairs every number with another and swaps the two or not, by a bit of a hash of the larger, so all
    numbers stay different and each row's place is an expression of its number alone: an order without a sort. The
    inverse, the row at a place, takes the rounds backwards.
    """
    if n < 1:
        raise ValueError("n must be positive")
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(round_key(key, r, n)).cast("long").alias("k")) for r in rounds])

    def step(at: Column, s: Column) -> Column:
        other = F.pmod(s["k"] - at, F.lit(n).cast("long"))
        bit = F.substring(F.md5(F.concat_ws("|", F.lit(str(key)), s["r"].cast("string"), F.greatest(at, other).cast("string")).cast("binary")), 1, 1)
        return F.when(bit < "8", other).otherwise(at)

    return F.aggregate(steps, i.cast("long"), step)
