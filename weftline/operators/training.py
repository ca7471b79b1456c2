"""Training by gradients that partitions sum up, with versions of the weights in shared storage.

Examples are a table, laid out by batch. Each step reads one batch: every task works out the gradient of its rows with
the broadcast weights, and blocks of gradients are added up in two rounds, so that no task ever sees more than FAN
tasks' sums of one block. The driver holds a few vectors of the size of the model, which does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weftline.operators.network import Adam, at_rest

#: Weights in a block, blocks that one task adds up, and rows of examples that a task works on at a time.
BLOCK, FAN, ROWS = 1 << 16, 256, 256

#: Files of a batch for each core.
SPREAD = 4

SUMS = "part int, block int, loss double, n long, sums binary"
VERSION = "block int, weights binary, mean binary, square binary, steps int"
HISTORY = "epoch int, loss double, metric double, stopped boolean"


class Learner(Protocol):
    """A model whose weights are one vector. Tasks get it pickled."""

    def first(self) -> np.ndarray:
        """The weights to begin with."""

    def losses(self, weights: np.ndarray, frame: pa.RecordBatch, gradient: np.ndarray | None = None) -> tuple[float, int]:
        """The loss of the examples in total, and how many count; the gradient is added to the given one."""


def _add_up(table: pa.Table) -> pa.Table:
    """The sum of the rows of a block, in the order of their parts, so that a repeated step gives the same result."""
    order = np.argsort(np.asarray(table["part"]), kind="stable")
    total = np.zeros(len(table["sums"][0].as_py()) // 8)
    for k in order.tolist():
        total += np.frombuffer(table["sums"][k].as_py())
    loss = float(sum(table["loss"][k].as_py() for k in order.tolist()))
    columns = [[table["part"][int(order[0])].as_py()], [table["block"][0].as_py()], [loss], [sum(table["n"].to_pylist())], [total.tobytes()]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, table.schema, strict=True)], schema=table.schema)


def total_gradient(examples: DataFrame, learner: Learner, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """The gradient of the loss over all examples, the loss, and how many count. No examples give zeros."""
    shared = examples.sparkSession.sparkContext.broadcast(weights)

    def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, loss, n = np.zeros_like(shared.value), 0.0, 0
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                some, count = learner.losses(shared.value, frame.slice(at, ROWS), gradient)
                loss, n = loss + some, n + count
        if n:
            part, starts = TaskContext.get().partitionId(), range(0, len(gradient), BLOCK)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(starts), pa.int32()), "block": pa.array([s // BLOCK for s in starts], pa.int32()), "loss": [loss if s == 0 else 0.0 for s in starts],
                "n": [n if s == 0 else 0 for s in starts], "sums": [gradient[s : s + BLOCK].tobytes() for s in starts],
            })

    sums = examples.mapInArrow(work, SUMS)
    some = sums.groupBy("block", (F.col("part") % FAN).alias("__some")).applyInArrow(_add_up, SUMS)
    blocks = sorted(some.groupBy("block").applyInArrow(_add_up, SUMS).collect(), key=lambda r: r["block"])
    shared.destroy()
    gradient = np.concatenate([np.frombuffer(r["sums"]) for r in blocks]) if blocks else np.zeros_like(weights)
    return gradient, sum(r["loss"] for r in blocks), sum(r["n"] for r in blocks)


class Plan(NamedTuple):
    """Epochs, batches of an epoch, the learning rate, and after how many epochs to validate."""

    epochs: int
    batches: int = 4
    rate: float = 0.02
    every: int = 3


class Trained(NamedTuple):
    """The weights of the best validated epoch (the last one without validation), and the rows of the epochs."""

    weights: np.ndarray
    epoch: int
    history: list[tuple[int, float | None, float | None, bool]]


def due(epoch: int, plan: Plan) -> bool:
    """Whether the metric is worked out after this epoch, counted from 1: each `every`-th, the first and the last."""
    return (epoch - 1) % plan.every == 0 or epoch in (1, plan.epochs)


def no_longer_better(series: list[float]) -> bool:
    """Whether training stops: the last metric is at most 0.9 of the one before, or no better than the two before."""
    return len(series) > 1 and (series[-1] <= 0.9 * series[-2] or len(series) > 2 and series[-1] <= min(series[-2], series[-3]))


def best_epoch(history: list[tuple[int, float | None, float | None, bool]]) -> int:
    """The last epoch whose metric did not end the training; without any metric the last epoch."""
    validated = [epoch for epoch, _, metric, stopped in history if metric is not None and not stopped]
    return max(validated, default=max((h[0] for h in history), default=0))


def _save(spark: SparkSession, path: str, state: Adam) -> None:
    rows = [(s // BLOCK, *(bytearray(v[s : s + BLOCK].tobytes()) for v in state[:3]), state.steps) for s in range(0, len(state.weights), BLOCK)]
    spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("overwrite").parquet(path)


def _load(spark: SparkSession, path: str) -> Adam:
    rows = spark.read.schema(VERSION).parquet(path).orderBy("block").collect()
    return Adam(*[np.concatenate([np.frombuffer(r[name]) for r in rows]) for name in ("weights", "mean", "square")], rows[0]["steps"])


def history_of(spark: SparkSession, root: str) -> list[tuple[int, float | None, float | None, bool]]:
    """The finished epochs of the training below root, 0 being the weights it began with; none if there is none."""
    try:
        return [tuple(r) for r in spark.read.schema(HISTORY).parquet(f"{root}/history").orderBy("epoch").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def train(examples: DataFrame, key: str, learner: Learner, root: str, plan: Plan, validate: Callable[[np.ndarray], float] | None = None) -> Trained:
    """Trains below root, a folder that driver and executors share, or goes on with what is there.

    An epoch is a step of Adam for each batch. Its weights, with the state of Adam, are a version of their own; the row
    in the history that follows makes it count. A run that was killed anywhere begins again after the last epoch in
    the history and ends like one that was not. Validation follows due(), training ends early by no_longer_better(),
    and the weights before count, as those of the best epoch do. Versions that are neither the best nor the last are
    overwritten or left; they hold three vectors of the size of the model.
    """
    spark = examples.sparkSession
    history = history_of(spark, root)
    if not history:
        batch = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(plan.batches)).cast("int")
        even = SPREAD * spark.sparkContext.defaultParallelism  # a step takes as long as its largest task, and tasks are made of files
        examples.withColumn("__batch", batch).repartition(even).write.mode("overwrite").partitionBy("__batch").parquet(f"{root}/examples")
        _save(spark, f"{root}/weights/epoch=0", at_rest(learner.first()))
        spark.createDataFrame([(0, None, None, False)], HISTORY).coalesce(1).write.mode("append").parquet(f"{root}/history")
        history = history_of(spark, root)
    laid_out = spark.read.schema(T.StructType([*examples.schema, T.StructField("__batch", T.IntegerType())])).parquet(f"{root}/examples")
    state = _load(spark, f"{root}/weights/epoch={history[-1][0]}")
    for epoch in range(history[-1][0] + 1, plan.epochs + 1):
        if history[-1][3]:
            break
        loss, n = 0.0, 0
        for k in range(plan.batches):
            batch = laid_out.where(F.col("__batch") == k).drop("__batch")  # one folder
            gradient, some, count = total_gradient(batch, learner, state.weights)
            if count:
                state, loss, n = state.after(gradient / count, plan.rate), loss + some, n + count
        metric = validate(state.weights) if validate and due(epoch, plan) else None
        stopped = metric is not None and no_longer_better([m for _, _, m, _ in history if m is not None] + [metric])
        _save(spark, f"{root}/weights/epoch={epoch}", state)
        spark.createDataFrame([(epoch, loss / n if n else None, metric, stopped)], HISTORY).coalesce(1).write.mode("append").parquet(f"{root}/history")
        history = history_of(spark, root)
    best = best_epoch(history)
    return Trained(_load(spark, f"{root}/weights/epoch={best}").weights, best, history)
