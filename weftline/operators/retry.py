"""Second tries and dead letters: rows that fail are tried again another way, and parked with their errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from weftline.plans.lineage import materialise

#: From rows to the same rows with result and error; error is null where the result counts.
Attempt = Callable[[DataFrame], DataFrame]


def with_retries(rows: DataFrame, *attempts: Attempt) -> tuple[DataFrame, DataFrame]:
    """(done, parked): rows with result and the number of the attempt (from 1) that gave it, and the dead letters, rows
    that no attempt could read, with the error of each attempt in order.

    Each attempt sees only what those before it failed on, and its outcome is a table, so nothing is tried twice, even
    when executors are lost later. Attempts must keep all rows and columns. Rows may repeat; an empty table gives two.
    The columns result, error, attempt and errors are those of this function and must not be in rows.
    """
    if not attempts or {"result", "error", "attempt", "errors"} & set(rows.columns):
        raise ValueError("at least one attempt, and no columns called result, error, attempt or errors")
    left, done = rows.withColumn("errors", F.array().cast("array<string>")), None
    for n, attempt in enumerate(attempts, 1):
        tried = materialise(attempt(left).withColumn("attempt", F.lit(n)))
        good = tried.where("error is null").drop("error", "errors")
        done = good if done is None else done.unionByName(good)
        left = tried.where("error is not null").withColumn("errors", F.concat("errors", F.array("error"))).drop("result", "error", "attempt")
    return done, left
