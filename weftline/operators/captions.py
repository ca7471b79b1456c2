"""Texts conditioned on feature vectors: examples, training, losses of given texts, and a scorer for the decoders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.functions.text import END as END_WORD, START as START_WORD
from weftline.operators import network
from weftline.operators.network import END, FIRST, START, Shape
from weftline.operators.training import ROWS, Plan, Trained, train

#: Words of a vocabulary, which the driver and each worker hold, and words of an example.
MOST_WORDS, LENGTH = 5_000, 40


def vocabulary_of(texts: DataFrame, words: str, most: int, least: int = 1) -> tuple[list[str], list[int]]:
    """The `most` most frequent words of the lists, of equal ones the smaller first, and how often they occur."""
    if not 0 < most <= MOST_WORDS:
        raise ValueError(f"a vocabulary has 1 to {MOST_WORDS} words")
    counts = texts.select(F.explode_outer(words).alias("w")).where("w is not null").groupBy("w").count().where(F.col("count") >= least)
    rows = counts.orderBy(F.desc("count"), "w").limit(most).collect()
    return [r["w"] for r in rows], [r["count"] for r in rows]


def _grid(column: pa.Array, shape: Shape) -> np.ndarray:
    """Feature vectors as a matrix, or as grids. A null vector, a null number or one too few counts as 0."""
    width = shape.features * shape.positions
    out, lengths = np.zeros((len(column), width)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row, place = np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
    kept = (place < width) & np.isfinite(values)
    out[row[kept], place[kept]] = values[kept]
    return out.reshape(-1, shape.positions, shape.features) if shape.kind == "attention" else out


class Captioner(NamedTuple):
    """A model with its vocabulary. It is a Learner of examples (features, numbers)."""

    shape: Shape
    vocabulary: tuple[str, ...]
    counts: tuple[int, ...] = ()
    seed: int = 0

    def first(self) -> np.ndarray:
        counts = np.zeros(self.shape.vocabulary)
        counts[FIRST : FIRST + len(self.counts)] = self.counts
        counts[END] = max(1, sum(self.counts) // LENGTH)
        return network.first_weights(self.shape, self.seed, counts)

    def losses(self, weights: np.ndarray, frame: pa.RecordBatch, gradient: np.ndarray | None = None) -> tuple[float, int]:
        each, n = self.each(weights, frame, gradient)
        return float(each.sum()), int(n.sum())

    def each(self, weights: np.ndarray, frame: pa.RecordBatch, gradient: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        of = dict(zip(frame.schema.names, frame.columns, strict=True))
        return network.losses(weights, self.shape, _grid(of["features"], self.shape), network.padded(of["numbers"].to_pylist()), gradient)


def captioner(texts: DataFrame, words: str, kind: str, features: int, most: int = 1000, positions: int = 1, nodes: int = 32, embedding: int = 24, least: int = 1) -> Captioner:
    """A model for the words of the texts. features: numbers of a vector, or of one of the positions of a grid."""
    vocabulary, counts = vocabulary_of(texts, words, most, least)
    return Captioner(Shape(kind, FIRST + len(vocabulary), features, nodes, embedding, positions), tuple(vocabulary), tuple(counts))


def examples_of(texts: DataFrame, key: str, features: str, words: str, model: Captioner, length: int = LENGTH) -> DataFrame:
    """(key, window, features, numbers): the word numbers of each text between start and end, in windows of up to
    `length` predicted words; a window begins with the last word of the one before.

    Words that are not in the vocabulary are left out, as the encoding of texts does. Every text is read to its end; a
    text without words has one window, start and end. A null vector counts as zeros.
    """

    def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: FIRST + k for k, w in enumerate(model.vocabulary)}
        for frame in frames:
            rows, places, windows = [], [], []
            for k, text in enumerate(frame.column(2).to_pylist()):
                all_ = [START, *(number[w] for w in text or [] if w in number), END]
                for at in range(0, len(all_) - 1, length):
                    rows.append(k)
                    places.append(at // length)
                    windows.append(all_[at : at + length + 1])
            taken = frame.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(places, pa.int32()), taken.column(1), pa.array(windows, pa.list_(pa.int32()))], names=[key, "window", "features", "numbers"])

    rows = texts.select(key, F.col(features).cast("array<double>").alias("features"), words)
    return rows.mapInArrow(work, T.StructType([rows.schema[key], T.StructField("window", T.IntegerType()), rows.schema["features"], T.StructField("numbers", T.ArrayType(T.IntegerType()))]))


def known_words(texts: DataFrame, words: str, model: Captioner) -> DataFrame:
    """texts whose lists keep the words of the vocabulary alone."""
    return texts.withColumn(words, F.filter(words, lambda w: w.isin(*model.vocabulary)))  # a set, not a list that is gone through for each word


def train_captioner(texts: DataFrame, key: str, features: str, words: str, model: Captioner, root: str, plan: Plan, validate=None) -> Trained:
    return train(examples_of(texts, key, features, words, model), key, model, root, plan, validate)


def text_losses(texts: DataFrame, key: str, features: str, words: str, model: Captioner, weights: np.ndarray) -> DataFrame:
    """(key, loss, n): -log of the probability of each text's words and end, given its features, and how many they are."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    examples = examples_of(texts, key, features, words, model)

    def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part = frame.slice(at, ROWS)
                loss, n = model.each(shared.value, part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(loss), pa.array(n, pa.int64())], names=[key, "loss", "n"])

    each = examples.mapInArrow(work, T.StructType([examples.schema[key], T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType())]))
    return each.groupBy(key).agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


class Conditioned:
    """A scorer for the decoders: the likeliest next words of a row by its features and all words before.

    Rows carry the column `features`. Words that the vocabulary lacks say nothing.
    """

    def __init__(self, model: Captioner, weights: np.ndarray, df: DataFrame) -> None:
        self.model, self.columns, self.shared = model, ["features"], df.sparkSession.sparkContext.broadcast(weights)

    def __call__(self, live: DataFrame, width: int) -> DataFrame:
        """live (features, last, words, ...) with next, prob and r: a row for each of the width likeliest next words."""
        model, shared = self.model, self.shared

        def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {w: FIRST + k for k, w in enumerate(model.vocabulary)} | {START_WORD: START, END_WORD: END}
            word = [None, START_WORD, END_WORD, *model.vocabulary]
            for frame in frames:
                for at in range(0, frame.num_rows, ROWS):
                    part = frame.slice(at, ROWS)
                    of = dict(zip(part.schema.names, part.columns, strict=True))
                    prefixes = [[START, *(number[w] for w in p if w in number and w != START_WORD)] for p in of["__prefix"].to_pylist()]
                    found = list(network.next_words(shared.value, model.shape, _grid(of["features"], model.shape), prefixes, width))
                    rows = [k for k, (best, _) in enumerate(found) for _ in best]
                    new = [
                        pa.array([word[b] for best, _ in found for b in best.tolist()], pa.string()), pa.array([p for _, logs in found for p in np.exp(logs).tolist()]),
                        pa.array([r + 1 for best, _ in found for r in range(len(best))], pa.int32()),
                    ]
                    taken = part.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *new], names=[*taken.schema.names, "next", "prob", "r"])

        rows = live.withColumn("__prefix", F.concat(F.array("begun"), "words"))
        fields = [T.StructField("next", T.StringType()), T.StructField("prob", T.DoubleType()), T.StructField("r", T.IntegerType())]
        return rows.mapInArrow(work, T.StructType([*rows.schema, *fields])).drop("__prefix")


def attention_weights(texts: DataFrame, key: str, features: str, words: str, model: Captioner, weights: np.ndarray) -> DataFrame:
    """(key, place, word, seen): for each word of a text that the vocabulary has, and its end, how the model weighs the
    positions of the text's grid before it. The weights of a word sum to 1; place counts these words from 0."""
    if model.shape.kind != "attention":
        raise ValueError("only models of the kind attention weigh positions")
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    examples = examples_of(texts, key, features, words, model)

    def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = [None, START_WORD, END_WORD, *model.vocabulary]
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part = frame.slice(at, ROWS)
                of = dict(zip(part.schema.names, part.columns, strict=True))
                numbers = of["numbers"].to_pylist()
                seen = network.positions_seen(shared.value, model.shape, _grid(of["features"], model.shape), network.padded(numbers))
                rows = [k for k, n in enumerate(numbers) for _ in n[1:]]
                columns = [
                    part.column(0).take(pa.array(rows, pa.int64())), pa.array([w * LENGTH + t for w, n in zip(of["window"].to_pylist(), numbers, strict=True) for t in range(len(n) - 1)], pa.int32()),
                    pa.array([word[x] for n in numbers for x in n[1:]], pa.string()), pa.array([seen[k, t].tolist() for k, n in enumerate(numbers) for t in range(len(n) - 1)], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "place", "word", "seen"])

    fields = [T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("seen", T.ArrayType(T.DoubleType()))]
    return examples.mapInArrow(work, T.StructType([examples.schema[key], *fields]))
