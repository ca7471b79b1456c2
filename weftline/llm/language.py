"""Language identification: a bidirectional gated recurrent network over the bytes of whole texts, trained in numpy.

A text is read as its UTF-8 bytes in lower case, blanks, digits and marks included, in windows of STRIDE bytes with
CONTEXT bytes before and after, over which the network's states warm up. It labels every byte; the log probabilities
of all bytes of a text, each from the window that it belongs to, are averaged into the document's probabilities. Reading
needs no softmax for that: a byte's log probabilities are linear in its states but for a constant that its languages
share, and which the document's own softmax takes out, so the states are averaged and labelled once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, id_crc, table

#: Documents of each language to learn from, in expectation, and windows of each; chosen by hashes. Languages at most;
#: with more, the most frequent ones.
SAMPLE, WINDOWS, LANGUAGES = 600, 12, 500

#: Documents to learn from in all languages together, in expectation: it bounds what reaches the driver, some 60 MB.
MOST_SAMPLE = 20_000

#: Bytes that a window labels, and bytes on either side that it reads besides; width of a direction's state.
STRIDE, CONTEXT, WIDTH = 96, 8, 8

#: Windows that the network reads at a time.
BATCH = 2048

BORDER, PAD = 256, 257


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of the categories L*; number signs are none."""
    return bool(text) and any(map(str.isalpha, text))


def encoded(text: str) -> np.ndarray:
    """The symbols of a text: its bytes in lower case between two borders."""
    flat = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.full(len(flat) + 2, BORDER, np.int16)
    out[1:-1] = flat
    return out


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (window x position, padded) of all windows of the texts, in order, and the number of windows of each."""
    width = STRIDE + 2 * CONTEXT
    symbols = [encoded(text) for text in texts]
    counts = np.array([-(-len(s) // STRIDE) for s in symbols], np.int64)
    sizes = counts * STRIDE + 2 * CONTEXT
    begins = np.cumsum(sizes) - sizes
    padded = np.full(max(width, sizes.sum()), PAD, np.int16)
    for s, at in zip(symbols, begins + CONTEXT):
        padded[at : at + len(s)] = s
    starts = np.repeat(begins - STRIDE * (np.cumsum(counts) - counts), counts) + STRIDE * np.arange(counts.sum())
    return np.lib.stride_tricks.sliding_window_view(padded, width)[starts], counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Gru:
    """One direction: state h' = (1 - z) h + z tanh(e_c + U_c (r h)), gates z and r from e and U h, e by symbol."""

    def __init__(self, width: int, random: np.random.Generator) -> None:
        self.h = width
        self.p = {
            "e": (random.normal(size=(258, 3 * width)) * 0.3).astype(np.float32),
            "u": (random.normal(size=(width, 2 * width)) / np.sqrt(width)).astype(np.float32),
            "c": (random.normal(size=(width, width)) / np.sqrt(width)).astype(np.float32),
        }

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of all positions of x (position x window); the state stays 0 before the first live position and as it
        is over others that are padding."""
        n, w = x.shape[1], self.h
        out, tape = np.empty((*x.shape, w), self.p["u"].dtype), []
        h = np.zeros((n, w), out.dtype)
        for t in range(len(x)):
            e = np.take(self.p["e"], x[t], axis=0)
            gates = h @ self.p["u"]
            gates += e[:, : 2 * w]
            gates = _sigmoid(gates)
            z, r = gates[:, :w], gates[:, w:]
            c = (r * h) @ self.p["c"]
            c += e[:, 2 * w :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c))
            new = c - h
            new *= z
            if not live[t].all():
                new *= live[t][:, None]
            new += h
            h = out[t] = new
        return out, tape

    def backward(self, x: np.ndarray, live: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        w = self.h
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros(d_out.shape[1:], d_out.dtype)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = tape[t]
            m = live[t][:, None]
            d = dh + d_out[t]
            dz, dc = d * m * (c - h) * z * (1 - z), d * m * z * (1 - c * c)
            drh = dc @ self.p["c"].T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            dh = d * (1 - m * z) + drh * r + dzr @ self.p["u"].T
            g["u"] += h.T @ dzr
            g["c"] += (r * h).T @ dc
            de = np.concatenate([dzr, dc], 1)
            order = np.argsort(x[t], kind="stable")
            symbols, first = np.unique(x[t][order], return_index=True)
            g["e"][symbols] += np.add.reduceat(de[order], first)
        return g


class Network:
    """Both directions and a softmax over languages at every position."""

    def __init__(self, langs: list[str], width: int = WIDTH, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.langs, self.fore, self.back = langs, Gru(width, random), Gru(width, random)
        self.out = {"w": (random.normal(size=(2 * width, len(langs))) * 0.1).astype(np.float32), "b": np.zeros(len(langs), np.float32)}

    def parameters(self) -> list[np.ndarray]:
        return [*self.fore.p.values(), *self.back.p.values(), *self.out.values()]

    def labels(self, x: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Log probabilities of the languages at every position of x (position x window)."""
        a, tape_a = self.fore.forward(x, live, keep)
        b, tape_b = self.back.forward(x[::-1], live[::-1], keep)
        states = np.concatenate([a, b[::-1]], 2)
        score = (states.reshape(-1, states.shape[2]) @ self.out["w"] + self.out["b"]).reshape(*x.shape, -1)
        score -= score.max(2, keepdims=True)
        return score - np.log(np.exp(score).sum(2, keepdims=True)), (states, tape_a, tape_b)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients by backpropagation through time; every live position is to carry its window's language."""
        live = (x != PAD).astype(self.out["w"].dtype)
        logp, (states, tape_a, tape_b) = self.labels(x, live, True)
        total = live.sum()
        d = np.exp(logp)
        d[:, np.arange(len(y)), y] -= 1
        d *= (live / total)[:, :, None]
        loss = -float((logp[:, np.arange(len(y)), y] * live).sum() / total)
        gw = states.reshape(-1, states.shape[2]).T @ d.reshape(-1, d.shape[2])
        ds = d @ self.out["w"].T
        w = self.fore.h
        ga = self.fore.backward(x, live, tape_a, ds[:, :, :w])
        gb = self.back.backward(x[::-1], live[::-1], tape_b, ds[::-1, :, w:])
        return loss, [*ga.values(), *gb.values(), gw, d.sum((0, 1))]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Network:
        """Adam over steps random batches of the windows x (window x position) with languages y."""
        random = np.random.default_rng(seed)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, steps + 1):
            rows = random.integers(0, len(y), min(batch, max(1, len(y))))
            _, grads = self.step(x[rows].T.astype(np.int64), y[rows])
            now = rate * (1 - 0.95 * k / steps)
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for p, g, m, v in zip(params, grads, first, second):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return self

    def states(self, x: np.ndarray) -> np.ndarray:
        """For each window of x (window x position) the sum of both directions' states over its own live positions.

        The same recurrence as Gru.forward in fewer passes over memory: the directions go side by side, each gate is an
        array of its own, and no state is stored. z and r are 1 / (1 + exp(-a)), tanh a is 2 / (1 + exp(-2 a)) - 1, with
        the factors in the tables. Padding has z = 0, so a state stays as it is. Both directions are over with the
        last own position after CONTEXT + STRIDE steps.
        """
        w, sides = self.fore.h, (self.fore.p, self.back.p)
        e = [np.concatenate([p["e"][:, k * w : (k + 1) * w] for p in sides]) * factor for k, factor in enumerate((-1, -1, -2))]
        e[0][[PAD, len(self.fore.p["e"]) + PAD]] = np.inf
        u = np.stack([np.stack([-p["u"][:, k * w : (k + 1) * w] for p in sides]) for k in (0, 1)])
        uc = np.stack([p["c"] * -2 for p in sides])
        symbols = np.empty((CONTEXT + STRIDE, 2, len(x)), np.intp)
        symbols[:, 0] = x[:, : CONTEXT + STRIDE].T
        symbols[:, 1] = x[:, CONTEXT:][:, ::-1].T
        symbols[:, 1] += len(self.fore.p["e"])
        h = np.zeros((2, len(x), w), uc.dtype)
        total, c, gates, of = np.zeros_like(h), np.empty_like(h), np.empty((2, *h.shape), h.dtype), np.empty((3, *h.shape), h.dtype)
        z, r = gates
        with np.errstate(over="ignore"):  # a gate is shut, then
            for t, now in enumerate(symbols):
                for k in range(3):
                    np.take(e[k], now, axis=0, out=of[k], mode="clip")
                np.matmul(h, u, out=gates)
                gates += of[:2]
                np.exp(gates, out=gates)
                gates += 1
                np.divide(h, r, out=r)
                np.matmul(r, uc, out=c)
                c += of[2]
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                c -= h
                c /= z
                h += c
                if t >= CONTEXT:
                    total += h
        total[0] -= (x[:, CONTEXT : CONTEXT + STRIDE] == PAD).sum(1, dtype=h.dtype)[:, None] * h[0]  # its last state, once more for each
        return np.concatenate(list(total), 1)

    def pooled(self, texts: list[str]) -> np.ndarray:
        """For each text the logarithms of its probabilities: the mean over all its positions of their log probabilities,
        less the logarithm of the sum of the exponentials of these means."""
        x, counts = windows(texts)
        if not len(counts):
            return np.empty((0, len(self.langs)))
        sums = np.concatenate([self.states(part) for part in np.array_split(x, -(-len(x) // BATCH))]).astype(np.float64)
        live = (x[:, CONTEXT : CONTEXT + STRIDE] != PAD).sum(1)
        begin = np.cumsum(counts) - counts
        score = np.add.reduceat(sums, begin) / np.add.reduceat(live, begin)[:, None] @ self.out["w"] + self.out["b"]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text; und without a letter."""
        out = [("und", 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        at = 0
        while at < len(rows):  # as many texts at a time as make a few batches, or one long one
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(texts[rows[end]]) <= 2 * BATCH * STRIDE):
                size += len(texts[rows[end]])
                end += 1
            for i, mean in zip(rows[at:end], self.pooled([texts[i] for i in rows[at:end]])):
                p = np.exp(mean - mean.max())
                out[i] = (self.langs[int(p.argmax())], round(float(p.max() / p.sum()), 6))
            at = end
        return out


def _sample_windows(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, lang, seed): rows (window, lang), at most WINDOWS windows anywhere in each text."""
    for frame in frames:
        window, lang = [], []
        for text, of, seed in zip(*(c.to_pylist() for c in frame.columns)):
            if has_letter(text):
                found, _ = windows([text])
                random = np.random.default_rng(seed & 0xFFFFFFFF)
                for i in sorted(random.choice(len(found), min(len(found), WINDOWS), replace=False)):
                    window.append(found[i].tobytes())
                    lang.append(of)
        yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), pa.array(lang, pa.string())], names=["window", "lang"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from the text and lang of documents whose crc32(doc_id) mod 4 is not 2; None if no row has both.

    Learns from about sample documents of each language, fewer where there are so many languages that they would be
    over MOST_SAMPLE together, chosen by a hash of doc_id, and WINDOWS random windows of
    each; those are all that reaches the driver. Rows with a null text, lang or doc_id, or no letter, teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (id_crc() % 4 != 2))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = cut(sizes, "languages")
    sample = min(sample, MOST_SAMPLE // max(1, sizes.count()))
    sizes = sizes.select(F.col("lang").alias("__lang"), (F.least(F.lit(1.0), sample / F.col("n")) * (1 << 30)).alias("__most"))
    ids = known.select(F.col("doc_id").alias("__id"), "lang").join(F.broadcast(sizes), F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64(F.lit("language"), "__id"), F.lit(1 << 30)) < F.col("__most"))
    ids = cut(ids.select("__id").distinct(), "sample")
    chosen = known.join(ids, F.col("doc_id") == F.col("__id"), "left_semi").select("text", "lang", F.xxhash64("doc_id").alias("seed"))
    rows = [(r["window"], r["lang"]) for r in chosen.mapInArrow(_sample_windows, "window binary, lang string").collect()]
    if not rows:
        return None
    rows.sort()
    langs = sorted({lang for _, lang in rows})
    of = {lang: i for i, lang in enumerate(langs)}
    x = np.frombuffer(b"".join(w for w, _ in rows), np.int16).reshape(len(rows), -1)
    return Network(langs).fit(x, np.array([of[lang] for _, lang in rows]))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs, from its whole text alone.

    lang_pred is a language that the network has learned, or und with score 0 for a null text, one without letters
    (characters of the categories L*), or without a network. Repeated rows give repeated rows, an empty table none;
    other columns are ignored. A text is read in windows, whatever its length; a very long one takes memory in
    proportion to it, a few times its own size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        net = shared.value
        for frame in frames:
            for at in range(0, frame.num_rows, 500):
                part = frame.slice(at, 500)
                texts = part.column(1).to_pylist()
                found = net.read(texts) if net else [("und", 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")
