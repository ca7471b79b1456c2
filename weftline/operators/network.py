"""Next-word models on feature vectors, in numpy: forward, backward, and steps of Adam on one packed vector of weights.

Three architectures of the same parts, words embedded and read by an LSTM:
merge      the features, through a dense layer, are added to the LSTM's output, which a dense layer then mixes;
parinject  the features, through a dense layer, stand beside each word at the LSTM's input;
attention  the features are a grid of vectors. Its mean sets the LSTM's first state, and before each word an additive
           attention (Bahdanau et al. 2015) weighs the grid's positions by that state; their sum stands beside the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Numbers of the words that are not in a vocabulary: padding, start and end of a text. Others begin at FIRST.
PAD, START, END, FIRST = 0, 1, 2, 3

#: Words whose outputs are worked out at a time, so that they stay in a core's cache.
WORDS = 256

KINDS = ("merge", "parinject", "attention")


class Shape(NamedTuple):
    """Sizes of a model. features: numbers of a feature vector, with attention those of one of its `positions`."""

    kind: str
    vocabulary: int
    features: int
    nodes: int = 32
    embedding: int = 24
    positions: int = 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of the weights, in the order in which they are packed."""
        v, f, h, e = self.vocabulary, self.features, self.nodes, self.embedding
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        beside = {"merge": 0, "parinject": h, "attention": f}[self.kind]
        own = {
            "merge": {"feature": (f, h), "feature_bias": (h,), "mix": (h, h), "mix_bias": (h,)},
            "parinject": {"feature": (f, h), "feature_bias": (h,), "mix": (h, h), "mix_bias": (h,)},
            "attention": {"grid": (f, f), "grid_bias": (f,), "first_h": (f, h), "first_c": (f, h), "query": (h, h), "keys": (f, h), "score": (h,)},
        }[self.kind]
        return {"words": (v, e), "x": (e + beside, 4 * h), "h": (h, 4 * h), "bias": (4 * h,), **own, "out": (h, v), "out_bias": (v,)}

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())


def views(packed: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """The weights by name, as views of the packed vector."""
    out, at = {}, 0
    for name, s in shape.parts().items():
        out[name] = packed[at : at + int(np.prod(s))].reshape(s)
        at += int(np.prod(s))
    return out


def first_weights(shape: Shape, seed: int = 0, counts: np.ndarray | None = None) -> np.ndarray:
    """Small random weights; with the words' counts the outputs begin at their frequencies."""
    r, packed = np.random.default_rng(seed), np.zeros(shape.size())
    w = views(packed, shape)
    for name, s in shape.parts().items():
        if not name.endswith("bias"):
            w[name][...] = r.normal(0, 1 / np.sqrt(s[0] if len(s) > 1 else 1), s) * (0.5 if name in ("words", "out") else 1)
    w["bias"][shape.nodes : 2 * shape.nodes] = 1  # the LSTM begins by keeping what it has
    if counts is not None:
        p = counts + 1.0
        p[[PAD, START]] = 1e-3
        w["out_bias"][...] = np.log(p / p.sum())
    return packed


_kept: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int) -> np.ndarray:
    """An array to be written, in memory that is kept for the next of that name, whose call ends this one: a worker goes
    through many batches, and fresh pages for each cost a fifth of the time."""
    size = int(np.prod(shape))
    if name not in _kept or _kept[name].size < size:
        _kept[name] = np.empty(size)
    return _kept[name][:size].reshape(shape)


def _picked(name: str, x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """x[:, places] of an array by gate."""
    out = _room(name, len(x), len(places), x.shape[2])
    for k in range(len(x)):
        np.take(x[k], places, axis=0, out=out[k], mode="clip")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; by exp, which is several times as fast as numpy's tanh of doubles."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _by_gate(x: np.ndarray, h: int) -> np.ndarray:
    """rows x 4 nodes as 4 x rows x nodes."""
    return np.ascontiguousarray(x.reshape(len(x), 4, h).transpose(1, 0, 2))


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """4 x rows x nodes as rows x 4 nodes."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


class Pass:
    """A forward pass over a batch: inputs (rows x steps) of word numbers, of which each row has the first `lengths`, and
    features (rows x numbers, or x positions x numbers).

    Longer rows go first and a step works on the rows that have a word there, so that padding costs nothing. Arrays over
    words hold those of the first step, then those of the second, and so on: `row` and `step` tell the place of each in
    inputs. Gates are 4 x words x nodes: input, forget, output, new.
    """

    def __init__(self, w: dict[str, np.ndarray], shape: Shape, features: np.ndarray, inputs: np.ndarray, lengths: np.ndarray) -> None:
        self.w, self.shape, h, e = w, shape, shape.nodes, shape.embedding
        order = np.argsort(-lengths, kind="stable")
        self.live = (lengths[:, None] > np.arange(lengths.max(initial=0))).sum(0).tolist()
        self.places = [slice(end - n, end) for n, end in zip(self.live, np.cumsum(self.live).tolist(), strict=True)]
        self.row, self.step = np.concatenate([order[:0], *(order[:n] for n in self.live)]), np.repeat(np.arange(len(self.live)), self.live)
        self.read, self.features = inputs[self.row, self.step], features[order]
        state, cell = np.zeros((len(order), h)), np.zeros((len(order), h))
        by_state, beside = _by_gate(w["h"], h), _by_gate(w["x"][e:], h)
        if shape.kind == "attention":
            self.mean = self.features.mean(1)
            self.grid = np.maximum(self.features @ w["grid"] + w["grid_bias"], 0)
            self.keys = self.grid @ w["keys"]
            state, cell = self.mean @ w["first_h"], self.mean @ w["first_c"]
        else:
            self.dense = np.maximum(self.features @ w["feature"] + w["feature_bias"], 0)
        own = np.matmul(self.dense, beside) if shape.kind == "parinject" else None  # the same at each step of a row
        self.gates = _picked("gates", _by_gate(w["words"] @ w["x"][:e] + w["bias"], h), self.read)  # worked out once for each word of the vocabulary
        self.state_before, self.cell_before, self.state, self.bent_cell = _room("cells", 4, len(self.read), h)
        self.weights, self.bent = [], []
        for n, at in zip(self.live, self.places, strict=True):
            state, cell, gates = state[:n], cell[:n], self.gates[:, at]
            self.state_before[at], self.cell_before[at] = state, cell
            if shape.kind == "parinject":
                gates += own[:, :n]
            if shape.kind == "attention":
                bent = _tanh(self.keys[:n] + (state @ w["query"])[:, None])
                scores = bent @ w["score"]
                scores = np.exp(scores - scores.max(1, keepdims=True))
                weights = scores / scores.sum(1, keepdims=True)
                self.bent.append(bent)
                self.weights.append(weights)
                gates += np.matmul(np.einsum("np,npf->nf", weights, self.grid[:n]), beside)
            gates += np.matmul(state, by_state)
            _sigmoid(gates[:3])
            _tanh(gates[3])
            i, f, o, new = gates
            cell = f * cell
            cell += i * new
            self.bent_cell[at] = cell
            state = o * _tanh(self.bent_cell[at])
            self.state[at] = state

    def hidden(self) -> np.ndarray:
        """What the output layer sees: words x nodes."""
        if self.shape.kind == "attention":
            return self.state
        self.merged = self.state
        if self.shape.kind == "merge":
            self.merged = np.concatenate([self.state[at] + self.dense[:n] for n, at in zip(self.live, self.places, strict=True)])
        self.mix = np.maximum(self.merged @ self.w["mix"] + self.w["mix_bias"], 0)
        return self.mix

    def back(self, d: np.ndarray, g: dict[str, np.ndarray]) -> None:
        """Adds the gradients, given that of hidden(), to g."""
        w, shape, h, e = self.w, self.shape, self.shape.nodes, self.shape.embedding
        by_state, beside = _by_gate(w["h"], h).transpose(0, 2, 1), _by_gate(w["x"][e:], h).transpose(0, 2, 1)
        if shape.kind != "attention":
            d = d * (self.mix > 0)
            g["mix"] += self.merged.T @ d
            g["mix_bias"] += d.sum(0)
            d = d @ w["mix"].T
        else:
            d_grid, d_keys = np.zeros_like(self.grid), np.zeros_like(self.keys)
        rows = len(self.features)
        d_gates, d_states, d_cells = _room("d_gates", *self.gates.shape), np.zeros((rows, h)), np.zeros((rows, h))
        d_dense, d_own = np.zeros((rows, h)), np.zeros((4, rows, h))
        for t in range(len(self.live) - 1, -1, -1):
            n, at = self.live[t], self.places[t]
            (i, f, o, new), c, d_state, d_cell = self.gates[:, at], self.bent_cell[at], d_states[:n], d_cells[:n]
            d_state += d[at]
            d_cell += d_state * o * (1 - c * c)
            here = d_gates[:, at]
            here[0] = d_cell * new * i * (1 - i)
            here[1] = d_cell * self.cell_before[at] * f * (1 - f)
            here[2] = d_state * c * o * (1 - o)
            here[3] = d_cell * i * (1 - new * new)
            d_cell *= f
            d_state[...] = np.matmul(here, by_state).sum(0)
            if shape.kind == "merge":
                d_dense[:n] += d[at]
            if shape.kind == "parinject":
                d_own[:, :n] += here
            if shape.kind == "attention":
                weights, bent, d_sum, grid = self.weights[t], self.bent[t], np.matmul(here, beside).sum(0), self.grid[:n]
                g["x"][e:] += np.einsum("np,npf->nf", weights, grid).T @ _side_by_side(here)
                d_grid[:n] += weights[:, :, None] * d_sum[:, None]
                d_weights = np.einsum("npf,nf->np", grid, d_sum)
                d_scores = weights * (d_weights - (weights * d_weights).sum(1, keepdims=True))
                g["score"] += np.einsum("np,nph->h", d_scores, bent)
                d_bent = d_scores[:, :, None] * w["score"] * (1 - bent * bent)
                d_keys[:n] += d_bent
                d_query = d_bent.sum(1)
                g["query"] += self.state_before[at].T @ d_query
                d_state += d_query @ w["query"].T
        for k in range(4):
            g["h"][:, k * h : (k + 1) * h] += self.state_before.T @ d_gates[k]
        order, by_word = np.argsort(self.read, kind="stable"), np.zeros((4, shape.vocabulary, h))
        words, starts = np.unique(self.read[order], return_index=True)
        d_gates = _picked("by_word", d_gates, order)
        for word, begin, end in zip(words.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            by_word[:, word] = d_gates[:, begin:end].sum(1)
        by_word = _side_by_side(by_word)
        g["words"] += by_word @ w["x"][:e].T
        g["x"][:e] += w["words"].T @ by_word
        g["bias"] += by_word.sum(0)
        if shape.kind == "attention":
            g["first_h"] += self.mean.T @ d_states
            g["first_c"] += self.mean.T @ d_cells
            f = shape.features
            g["keys"] += self.grid.reshape(-1, f).T @ d_keys.reshape(-1, h)
            d_grid = (d_grid + d_keys @ w["keys"].T) * (self.grid > 0)
            g["grid"] += self.features.reshape(-1, f).T @ d_grid.reshape(-1, f)
            g["grid_bias"] += d_grid.sum((0, 1))
        else:
            if shape.kind == "parinject":
                g["x"][e:] += self.dense.T @ _side_by_side(d_own)
                d_dense = np.matmul(d_own, beside).sum(0)
            d_dense = d_dense * (self.dense > 0)
            g["feature"] += self.features.T @ d_dense
            g["feature_bias"] += d_dense.sum(0)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def padded(rows: list[list[int]]) -> np.ndarray:
    """Lists of word numbers as a matrix, padded on the right."""
    out = np.full((len(rows), max(map(len, rows), default=1) or 1), PAD, np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def losses(packed: np.ndarray, shape: Shape, features: np.ndarray, words: np.ndarray, gradient: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of word numbers, padded on the right: the sum of -log p(word | features, words before) over all words
    but the first, and how many these are. With gradient, that of the total is added to it."""
    w, inputs, targets = views(packed, shape), words[:, :-1], words[:, 1:]
    if not targets.size:
        return np.zeros(len(words)), np.zeros(len(words), np.int64)
    n = (targets != PAD).sum(1)
    run = Pass(w, shape, features, inputs, n)
    hidden, wanted = run.hidden(), targets[run.row, run.step]
    each, d_hidden, ones, g = np.empty(len(wanted)), _room("d_hidden", *hidden.shape), np.ones_like(w["out_bias"]), None if gradient is None else views(gradient, shape)
    for at in range(0, len(wanted), WORDS):
        some, target = hidden[at : at + WORDS], wanted[at : at + WORDS]
        own = np.arange(len(some)), target
        x = np.matmul(some, w["out"], out=_room("logits", len(some), shape.vocabulary))
        x += w["out_bias"]
        x -= x.max(1, keepdims=True)
        given = x[own]
        np.exp(x, out=x)
        total = x @ ones
        each[at : at + WORDS] = np.log(total) - given
        if g is not None:  # x is the gradient times total, which is divided out of the narrow results
            x[own] -= total
            by = 1 / total
            g["out"] += (some * by[:, None]).T @ x
            g["out_bias"] += by @ x
            d_hidden[at : at + WORDS] = (x @ w["out"].T) * by[:, None]
    if g is not None:
        run.back(d_hidden, g)
    return np.bincount(run.row, each, len(words)), n


def next_words(packed: np.ndarray, shape: Shape, features: np.ndarray, prefixes: list[list[int]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each prefix: its `most` likeliest next words, the likelier first and of equal ones the smaller number first,
    and their log probabilities."""
    w, words = views(packed, shape), padded(prefixes)
    lengths = np.array([len(p) for p in prefixes])
    run = Pass(w, shape, features, words, lengths)
    last = np.flatnonzero(run.step == lengths[run.row] - 1)
    last = last[np.argsort(run.row[last])]
    logs = _log_softmax(run.hidden()[last] @ w["out"] + w["out_bias"])
    logs[:, [PAD, START]] = -np.inf
    for k, row in enumerate(np.round(logs, 9)):
        best = np.lexsort((np.arange(len(row)), -row))[: min(most, shape.vocabulary - 2)]
        yield best, row[best]


def positions_seen(packed: np.ndarray, shape: Shape, features: np.ndarray, words: np.ndarray) -> np.ndarray:
    """rows x steps x positions: how an attention model weighs the grid's positions before each word but the first; zeros
    where a row has ended."""
    out = np.zeros((len(words), words.shape[1] - 1, shape.positions))
    run = Pass(views(packed, shape), shape, features, words[:, :-1], (words[:, 1:] != PAD).sum(1))
    out[run.row, run.step] = np.concatenate(run.weights)
    return out


class Adam(NamedTuple):
    """Weights with the moments of their gradients (Kingma, Ba 2015)."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: int = 0

    def after(self, gradient: np.ndarray, rate: float) -> Adam:
        t = self.steps + 1
        mean, square = 0.9 * self.mean + 0.1 * gradient, 0.999 * self.square + 0.001 * gradient**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        return Adam(self.weights - step, mean, square, t)


def at_rest(weights: np.ndarray) -> Adam:
    return Adam(weights, np.zeros_like(weights), np.zeros_like(weights))
