"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression, all in numpy."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import batches, cut, id_crc, table, text_of

#: Labelled documents to learn from, in expectation; with more, those with the smallest hashes of doc_id.
SAMPLE = 20_000

#: Words of a lexicon at most, those with the highest odds: it bounds what the model knows, not what it is learned from.
#: A word needs LEAST toxic documents, and to be RATIO times as frequent among toxic documents as among others.
WORDS, LEAST, RATIO = 2_000, 8, 4.0

#: Parts of the sample: a document's features, and its score for the calibration, are learned from the other ones.
FOLDS = 4

#: Log odds from which a word of the lexicon counts as strong.
STRONG = 3.0

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú usted ustedes ti vosotros".split())

#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})

WINDOW = 50
NEAR = 5

#: Word forms that a worker keeps, and the length from which one is worked out anew each time.
CACHE, LONG = 60_000, 64

_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_REPEAT = re.compile(r"(.)\1{2,}")
_STARRED = re.compile(r"^[^\W\d_]{1,20}\*+[^\W\d_]{1,20}$")
_INNER = re.compile(r"[^\W\d_][\d@$!|+*#.\-_]+[^\W\d_]")

NAMES = (
    "log_words", "mean_length", "strong_hits", "strong_density", "hits", "density", "weight_density", "distinct_hits", "window_hits", "hidden_density",
    "second_person", "near_second_person", "second_person_distance", "capital_words", "capital_hits", "exclamations", "questions", "symbols",
    "obfuscated", "elongated", "digits",
)


def plain(word: str) -> str:
    """A word in lower case without the marks around it."""
    return _EDGES.sub("", word).lower()


def unmasked(word: str) -> str:
    """A word with digits and signs read as letters, other signs and repeated letters removed."""
    return _REPEAT.sub(r"\1", re.sub(r"[\W\d_]", "", word.translate(LEET)))


class Words(dict):
    """Of each word form: bits for second person, capitals, obfuscation, elongation, hidden hit; lexicon place above."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, form: str) -> int:
        word = plain(form)
        place, code = self.lexicon.get(word, 0), 0
        masked = bool(_INNER.search(word))
        if not place and (masked or _REPEAT.search(word) or not word.isalpha()):
            hidden = unmasked(form.lower())
            if place := self.lexicon.get(hidden, 0):
                code |= 32
                word = hidden
            elif _STARRED.search(word):  # letters behind asterisks: the strongest word that fits
                fits = re.compile(re.sub(r"\\\*+", r"\\w+", re.escape(word)))
                if fit := next((w for w in self.lexicon if fits.fullmatch(w)), None):
                    word, place, code = fit, self.lexicon[fit], code | 32
        code |= (word in SECOND_PERSON) << 1 | (len(word) > 2 and form.isupper()) << 2 | masked << 3 | bool(_REPEAT.search(word)) << 4
        code |= place << 6
        if len(form) < LONG:
            self[form] = code
        return code


def features(text: str, words: Words, weights: np.ndarray) -> list[float]:
    """The dense features of a text, in the order of NAMES; an empty one has the same as one without words."""
    if len(words) > CACHE:
        words.clear()
    forms = text.split()
    n = len(forms)
    codes = np.fromiter(map(words.__getitem__, forms), np.int64, n)
    base, length = max(n, 1), max(len(text), 1)
    place = codes >> 6
    hit = np.flatnonzero(place)
    you = np.flatnonzero(codes & 2)
    strong = int((weights[place] >= STRONG).sum())
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(you[np.maximum(at - 1, 0)] - hit))
        near, distance = float((gap <= NEAR).sum()), float(gap.min())
    else:
        near, distance = 0.0, 1000.0
    most = float((np.searchsorted(hit, hit + WINDOW) - np.arange(len(hit))).max()) if len(hit) else 0.0
    return [
        math.log1p(n), length / base, strong, strong / base, len(hit), len(hit) / base, float(weights[place].sum()) / base, float(len(np.unique(place[hit]))), most,
        int((codes & 32).sum() >> 5) / base, len(you) / base, near, min(distance, 1000.0), int((codes & 4).sum() >> 2) / base, int((codes[hit] & 4).sum() >> 2),
        text.count("!") / length, text.count("?") / length, sum(map(text.count, "*#$%&@|")) / length,
        int((codes & 8).sum() >> 3) / base, int((codes & 16).sum() >> 4) / base, sum(map(text.count, "0123456789")) / length,
    ]


class Trees:
    """Gradient-boosted trees for the logistic loss: histograms of quantile bins, all nodes of a depth at once."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, ridge: float = 2.0, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = math.log(p / (1 - p))
        score, self.trees = np.full(n, self.start), []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                k = 1 << level
                gains = np.full((d, k, self.bins), -np.inf)
                for j in range(d):
                    key = node * self.bins + binned[j]
                    gs = np.bincount(key, g, k * self.bins).reshape(k, -1).cumsum(1)
                    hs = np.bincount(key, h, k * self.bins).reshape(k, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gains[j] = np.where((hs >= self.least) & (ht - hs >= self.least), gain, -np.inf)
                flat = gains.transpose(1, 0, 2).reshape(k, -1)
                best = flat.argmax(1)
                feature, border = best // self.bins, best % self.bins
                border = np.where(flat.max(1) > 1e-9, border, self.bins)  # no split: all rows go left
                splits.append((feature, border))
                node = node * 2 + (binned[feature[node], np.arange(n)] > border[node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + self.ridge)
            self.trees.append((splits, leaf))
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        score, rows = np.full(n, self.start), np.arange(n)
        for splits, leaf in self.trees:
            node = np.zeros(n, np.int64)
            for feature, border in splits:
                node = node * 2 + (binned[feature[node], rows] > border[node])
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: steps (place, value) of the non-decreasing fit of y on x, ties in x pooled first."""
    places, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []
    for i in range(len(places)):
        blocks.append([mean[i], weight[i], places[i], places[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, hi
    b = np.array(blocks)
    return b[:, 2:4].ravel(), np.repeat(b[:, 0], 2)


@dataclass
class Model:
    lexicon: dict[str, int]
    weights: np.ndarray
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities: steps of equal ones, joined by straight lines where the trees' score lies between two."""
        if self.trees is None:
            return np.full(len(x), float(self.steps[1][0]))
        return np.clip(np.interp(self.trees.raw(x), *self.steps), 0.0, 1.0)


def _lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, int], np.ndarray]:
    """Words with their places from 1, and the log odds of each place, from (word, toxic documents, clean documents)."""
    odds = {w: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1)) for w, t, c in rows}
    best = sorted(odds, key=lambda w: (-odds[w], w))
    return {w: i + 1 for i, w in enumerate(best)}, np.array([0.0, *(odds[w] for w in best)])


def _count_words(frame: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    found: Counter = Counter()
    for text, fold, y in zip(*(c.to_pylist() for c in frame.columns)):
        found.update((w, fold, y) for w in {plain(f) for f in set((text or "").split())} if w)
    if found:
        word, fold, y = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(found.values(), pa.int64())], names=["word", "fold", "y", "n"])


def _lexicons(chosen: DataFrame, sizes: dict[tuple[int, int], int]) -> dict[frozenset[int], tuple[dict[str, int], np.ndarray]]:
    """Lexicons by the folds that are left out of them, none, one or two: words are selected and weighed in the others."""
    words = chosen.select("text", "fold", "y").mapInArrow(batches(_count_words), "word string, fold int, y int, n long")
    pick = lambda k, y: F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{k}{y}")
    counts = words.groupBy("word").agg(*[pick(k, y) for k in range(FOLDS) for y in (0, 1)])
    out = {}
    counts = cut(counts.where(" + ".join(f"n{k}1" for k in range(FOLDS)) + f" >= {LEAST}"), "words")
    for left_out in {frozenset(), *(frozenset((j, k)) for j in range(FOLDS) for k in range(FOLDS))}:
        folds = [k for k in range(FOLDS) if k not in left_out]
        t, c = (sum((F.col(f"n{k}{y}") for k in folds), F.lit(0)) for y in (1, 0))
        n_toxic, n_clean = (sum(sizes.get((k, y), 0) for k in folds) for y in (1, 0))
        ratio = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
        rows = counts.where((t >= LEAST) & (ratio >= RATIO)).select("word", t.alias("t"), c.alias("c"), ratio.alias("r")).orderBy(F.desc("r"), "word").limit(WORDS)
        out[left_out] = _lexicon([(r["word"], r["t"], r["c"]) for r in rows.collect()], n_toxic, n_clean)
    return out


def _with_features(chosen: DataFrame, lexicons: dict[frozenset[int], tuple[dict[str, int], np.ndarray]]) -> DataFrame:
    """(doc_id, fold, y, x) for each row of chosen (text, fold, y, doc_id): for each fold k the features of the text by
    the lexicon that leaves out k and the row's own fold, one after the other as bytes of float64."""
    shared = chosen.sparkSession.sparkContext.broadcast(lexicons)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words = {left_out: Words(lexicon) for left_out, (lexicon, _) in shared.value.items()}
        for frame in frames:
            x = []
            for text, fold in zip(frame.column(3).to_pylist(), frame.column(1).to_pylist(), strict=True):
                by = [frozenset((fold, k)) for k in range(FOLDS)]
                x.append(np.array([features(text or "", words[k], shared.value[k][1]) for k in by], float).tobytes())
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(x, pa.binary())], names=["doc_id", "fold", "y", "x"])

    rows = chosen.select("doc_id", "fold", "y", "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("x", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, toxic) of documents whose crc32(doc_id) mod 5 is not 0.

    At most sample labelled documents in expectation are used, chosen by a hash of doc_id; a document with several
    labels counts as toxic if one says so, rows without a label or a document are left out. The driver receives the
    lexicons (at most WORDS words each) and one row of features for each document of the sample.

    The sample is cut into FOLDS parts by a hash of doc_id. The words of the lexicon that a sample document's features
    use are selected and weighed in the other parts alone. The calibration uses scores that have not seen the document:
    for each part, of trees fitted to the other parts, whose features come from lexicons that leave out both the part
    and their own.
    Without documents of both classes the score is the only class; a part whose complement lacks a class scores 0 odds.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_crc() % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    known = known.where(place < min(1.0, sample / max(n, 1)) * (1 << 30)).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    chosen = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(F.broadcast(known), "doc_id")
    chosen = cut(chosen.select(text_of().alias("text"), "fold", "y", "doc_id"), "labelled")
    sizes = {(r["fold"], r["y"]): r["count"] for r in chosen.groupBy("fold", "y").count().collect()}
    n_toxic, n_clean = (sum(n for (_, y), n in sizes.items() if y == want) for want in (1, 0))
    if not n_toxic or not n_clean:
        return Model(*_lexicon([], 1, 1), None, (np.array([0.0]), np.array([1.0 if n_toxic else 0.0])))
    lexicons = _lexicons(chosen, sizes)
    rows = _with_features(chosen, lexicons).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.frombuffer(b"".join(r["x"] for r in rows)).reshape(len(rows), FOLDS, -1)  # by row and fold left out
    y, fold = np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and 0 < y[fold != k].sum() < (fold != k).sum():
            raw[fold == k] = Trees().fit(x[fold != k, k], y[fold != k]).raw(x[fold == k, k])
    return Model(*lexicons[frozenset()], Trees().fit(x[np.arange(len(y)), fold], y), isotonic(raw, y))


def score_column(spark: SparkSession, model: Model, text: str | Column = "text") -> Column:
    """The score of a text. Only the text goes to Python and only the score comes back; the rest of a row stays."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(shared.value.lexicon)
        for some in texts:
            out = [np.empty(0)]
            for at in range(0, len(some), 1000):
                x = [features(t.as_py() or "", words, shared.value.weights) for t in some.slice(at, 1000)]
                out.append(shared.value.score(np.array(x)))
            yield pa.array(np.concatenate(out))

    return score(text)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs, from its whole text alone; null is the empty text, which gets a score too.

    Equal texts get equal scores. An empty table gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", score_column(docs.sparkSession, model).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns; no rows are moved."""
    return docs.where(score_column(docs.sparkSession, model) < threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
