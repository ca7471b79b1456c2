"""A text classifier by convolution over embedded words: windows of three words, the largest answer of each filter over
the whole text, a dense layer, and a softmax over the labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.operators.captions import vocabulary_of
from weftline.operators.training import ROWS, Plan, Trained, train

#: Words of a window, labels that a model may have, and windows whose answers are in memory at a time.
WIDTH, MOST_LABELS, WINDOWS = 3, 10_000, 1 << 14


class TextConvolution(NamedTuple):
    """A Learner of examples (numbers, label). Number 0 stands for padding and for words that the vocabulary lacks."""

    vocabulary: tuple[str, ...]
    labels: tuple[str, ...]
    filters: int = 32
    embedding: int = 16
    nodes: int = 50
    seed: int = 0

    def parts(self) -> dict[str, tuple[int, ...]]:
        v, e, f, n, k = len(self.vocabulary) + 1, self.embedding, self.filters, self.nodes, len(self.labels)
        return {"words": (v, e), "window": (WIDTH, e, f), "window_bias": (f,), "dense": (f, n), "dense_bias": (n,), "out": (n, k), "out_bias": (k,)}

    def views(self, packed: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            out[name] = packed[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        return out

    def first(self) -> np.ndarray:
        r, packed = np.random.default_rng(self.seed), np.zeros(sum(int(np.prod(s)) for s in self.parts().values()))
        for name, view in self.views(packed).items():
            if not name.endswith("bias"):
                view[...] = r.normal(0, 1 / np.sqrt(np.prod(view.shape[:-1]) if name != "words" else 1), view.shape)
        return packed

    def _pooled(self, w: dict[str, np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' words one after the other, the largest answer of each filter in each text, and the first word of
        the first window that gives it."""
        texts = [np.pad(t, (0, max(0, WIDTH - len(t)))) for t in texts]
        words, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        first = np.r_[0, np.cumsum(sizes)]
        text = np.repeat(np.arange(len(texts)), sizes)
        starts = np.flatnonzero(text[: len(words) - WIDTH + 1] == text[WIDTH - 1 :])
        best, where = np.full((len(texts), self.filters), -np.inf), np.zeros((len(texts), self.filters), np.int64)
        for at in range(0, len(starts), WINDOWS):
            some = starts[at : at + WINDOWS]
            answers = sum(w["words"][words[some + k]] @ w["window"][k] for k in range(WIDTH)) + w["window_bias"]
            of, begins = np.unique(text[some], return_index=True)
            top = np.maximum.reduceat(answers, begins)
            rows, cols = np.nonzero(answers == np.repeat(top, np.diff(np.r_[begins, len(some)]), 0))
            place = np.zeros_like(top, dtype=np.int64)
            place[np.searchsorted(of, text[some[rows[::-1]]]), cols[::-1]] = some[rows[::-1]]  # the first one is written last
            better = top > best[of]
            best[of], where[of] = np.where(better, top, best[of]), np.where(better, place, where[of])
        assert (where >= first[:-1, None]).all()
        return words, best, where

    def logs(self, packed: np.ndarray, texts: list[np.ndarray], gradient: np.ndarray | None = None, labels: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of the labels (texts x labels). With a gradient, that of the loss on the given labels is added."""
        w = self.views(packed)
        words, best, where = self._pooled(w, texts)
        pooled = np.maximum(best, 0)
        dense = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        x = dense @ w["out"] + w["out_bias"]
        x = x - x.max(1, keepdims=True)
        logs = x - np.log(np.exp(x).sum(1, keepdims=True))
        if gradient is not None:
            g, d = self.views(gradient), np.exp(logs)
            d[np.arange(len(d)), labels] -= 1
            g["out"] += dense.T @ d
            g["out_bias"] += d.sum(0)
            d = (d @ w["out"].T) * (dense > 0)
            g["dense"] += pooled.T @ d
            g["dense_bias"] += d.sum(0)
            d = (d @ w["dense"].T) * (best > 0)
            g["window_bias"] += d.sum(0)
            for k in range(WIDTH):  # of each filter only the words of its best window
                at = words[where + k]
                g["window"][k] += np.einsum("tfe,tf->ef", w["words"][at], d)
                np.add.at(g["words"], at, d[:, :, None] * w["window"][k].T)
        return logs

    def numbers(self, frame: pa.RecordBatch) -> list[np.ndarray]:
        return [np.array(x or [], np.int64) for x in frame.column(frame.schema.get_field_index("numbers")).to_pylist()]

    def losses(self, weights: np.ndarray, frame: pa.RecordBatch, gradient: np.ndarray | None = None) -> tuple[float, int]:
        labels = np.asarray(frame.column(frame.schema.get_field_index("label")), np.int64)
        logs = self.logs(weights, self.numbers(frame), gradient, labels)
        return float(-logs[np.arange(len(logs)), labels].sum()), len(labels)


def text_convolution(texts: DataFrame, words: str, label: str, most: int = 2000, **sizes: int) -> TextConvolution:
    """A model for the words and labels of the texts; rows without a label are passed over."""
    known = texts.where(F.col(label).isNotNull())
    labels = [r[0] for r in known.select(F.col(label).cast("string")).distinct().limit(MOST_LABELS + 1).collect()]
    if not 0 < len(labels) <= MOST_LABELS:
        raise ValueError(f"between 1 and {MOST_LABELS} labels are needed")
    return TextConvolution(tuple(vocabulary_of(known, words, most)[0]), tuple(sorted(labels)), **sizes)


def encoded(texts: DataFrame, key: str, words: str, model: TextConvolution, label: str | None = None) -> DataFrame:
    """(key, numbers) of every text, whole; with a label column also its number, rows without a known label left out."""
    columns = [key, words, *([label] if label else [])]
    rows = texts.select(*columns)

    def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place = {w: k + 1 for k, w in enumerate(model.vocabulary)}, {x: k for k, x in enumerate(model.labels)}
        for frame in frames:
            numbers = [[number.get(w, 0) for w in text or []] for text in frame.column(1).to_pylist()]
            out = [frame.column(0), pa.array(numbers, pa.list_(pa.int32()))]
            if label:
                out.append(pa.array([place.get(x) for x in frame.column(2).cast(pa.string()).to_pylist()], pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=[key, "numbers", "label"][: len(out)])

    fields = [rows.schema[key], T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("label", T.IntegerType())]
    out = rows.mapInArrow(work, T.StructType(fields[: len(columns)]))
    return out.where("label is not null") if label else out


def train_classifier(texts: DataFrame, key: str, words: str, label: str, model: TextConvolution, root: str, plan: Plan) -> Trained:
    return train(encoded(texts, key, words, model, label), key, model, root, plan)


def classify(texts: DataFrame, key: str, words: str, model: TextConvolution, weights: np.ndarray) -> DataFrame:
    """(key, predicted, score) of every text: the likeliest label, of equal ones the first by name, and its probability.

    Repeated rows give repeated rows, null and empty lists are texts of padding, an empty table gives none.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    rows = encoded(texts, key, words, model)

    def work(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part = frame.slice(at, ROWS)
                logs = model.logs(shared.value, model.numbers(part))
                best = logs.argmax(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.labels[k] for k in best.tolist()]), pa.array(np.exp(logs.max(1)))], names=[key, "predicted", "score"])

    return rows.mapInArrow(work, T.StructType([rows.schema[key], T.StructField("predicted", T.StringType()), T.StructField("score", T.DoubleType())]))
