"""New items of a stream by section: what was not seen before, flushed every few items and when a section ends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: New items of a section after which they are flushed, and milliseconds without any after which a section counts as ended.
EVERY, QUIET = 10, 600_000

FLUSHES = "section string, flush int, items array<string>, ended boolean"
STATE = "pending array<string>, flushes int"


def _flush(every: int, quiet: int | None):
    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, flushes = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out, ended = [], state.hasTimedOut
        rows = [] if state.hasTimedOut else [r for frame in frames for r in zip(frame["item"], frame["ended"], strict=True)]
        for item in sorted(item for item, end in rows if not end):
            pending.append(item)
            if len(pending) == every:
                flushes += 1
                out.append((key[0], flushes, pending, False))
                pending = []
        ended = ended or any(end for _, end in rows)
        if ended and pending:
            flushes += 1
            out.append((key[0], flushes, pending, True))
            pending = []
        state.update((pending, flushes))
        if pending and quiet:
            state.setTimeoutDuration(quiet)
        yield pd.DataFrame(out, columns=["section", "flush", "items", "ended"])

    return update


def flushed(stream: DataFrame, every: int = EVERY, quiet: int | None = QUIET) -> DataFrame:
    """Flushes (section, flush, items, ended) of a stream (section, item, run).

    A row without an item says that a run of the section has ended. Items that a section has had before are passed
    over; the state store holds one key for each of them, wherever they hash, and for a section only the items that
    wait for their flush and a count. A section that falls silent is flushed by a timer, unless quiet is None. A null section is one too.
    """
    named = stream.select(F.coalesce("section", F.lit("")).alias("section"), F.coalesce("item", F.concat(F.lit("end of "), "run")).alias("item"), F.col("item").isNull().alias("ended"))
    new = named.dropDuplicates(["section", "item", "ended"])
    return new.groupBy("section").applyInPandasWithState(_flush(every, quiet), FLUSHES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, folder: str, root: str, every: int = EVERY) -> DataFrame:
    """Everything that has come to the folder (Parquet: section, item, run) since the last call through flushed(), written
    and checkpointed below root, which is shared. All flushes so far. A run that ends when all is read has no timers:
    with them it would wait for their time."""
    stream = spark.readStream.schema("section string, item string, run string").parquet(folder)
    query = flushed(stream, every, None).writeStream.format("parquet").option("path", f"{root}/flushes").option("checkpointLocation", f"{root}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(FLUSHES).parquet(f"{root}/flushes")
