"""Metrics of generated texts and of classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.functions.stem import stem
from weftline.functions.text import ngrams
from weftline.plans.lineage import materialise

ORDERS = (1, 2, 3, 4)

#: Words whose stems a worker keeps.
STEMS = 200_000

#: Pairs whose n-grams a task counts at a time.
PAIRS = 500


def _by_repetition(pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pairs whose key no other row has, and the rest. Keys alone move, and those that stand more than once."""
    twice = materialise(pairs.groupBy(F.col(key).alias("__twice")).count().where("count > 1").select("__twice"))
    met = F.col(key).eqNullSafe(F.col("__twice"))
    return pairs.join(twice, met, "left_anti"), pairs.join(twice, met, "left_semi")


def _counted(words: list[str | None] | None, n: int) -> Counter:
    """The n-grams of a token list, as ngrams() has them, and how often each stands in it."""
    if n == 1 and None not in (words or []):
        return Counter(words)
    grams = zip(*[(words or [])[k:] for k in range(n)])
    return Counter(" ".join(g) if None not in g else " ".join(w for w in g if w is not None) for g in grams)


def _within_rows(pairs: DataFrame, key: str, reference: str, prediction: str, orders: tuple[int, ...], columns: tuple[str, ...], rows_of: Callable[[int, Counter, Counter], Iterable[tuple]]) -> DataFrame:
    """(key, *columns): rows_of(n, predicted, wanted) for each pair and order, worked out where the pair is read."""
    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, PAIRS):
                part = frame.slice(at, PAIRS)
                places, rows = [], []
                for k, (ref, pred) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for n in orders:
                        found = list(rows_of(n, _counted(pred, n), _counted(ref, n)))
                        places += [k] * len(found)
                        rows += found
                values = zip(*rows) if rows else [[] for _ in columns]
                arrays = [pa.array(list(v), pa.string() if c == "g" else pa.int32() if c == "n" else pa.int64()) for c, v in zip(columns, values)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places, pa.int64())), *arrays], names=[key, *columns])

    rows = pairs.select(key, reference, prediction)
    kinds = {"g": T.StringType(), "n": T.IntegerType()}
    return rows.mapInArrow(work, T.StructType([rows.schema[key], *[T.StructField(c, kinds.get(c, T.LongType())) for c in columns]]))


def _shuffled_counts(pairs: DataFrame, key: str, reference: str, prediction: str, orders: tuple[int, ...]) -> DataFrame:
    """What ngram_counts() gives, for keys of any number of rows."""
    def grams(words: str, is_pred: int) -> Column:
        one = lambda n: F.transform(ngrams(F.col(words), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(is_pred).alias("p")))
        return F.concat(*[one(n) for n in orders])

    # both sides in one pass over the pairs; the outer form keeps Spark from working the lists out twice for a filter
    both = pairs.select(key, F.explode_outer(F.concat(grams(reference, 0), grams(prediction, 1))).alias("x")).where("x is not null").select(key, "x.n", "x.g", "x.p")
    return both.groupBy(key, "n", "g").agg(F.sum("p").alias("hyp"), F.sum(1 - F.col("p")).alias("ref"))


def ngram_counts(pairs: DataFrame, key: str, reference: str, prediction: str, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(key, n, g, hyp, ref): how often each n-gram stands in the prediction and in the reference of each pair.

    Pairs of the same key count together: their n-grams are shuffled, those of all other pairs are counted in place.
    """
    once, twice = _by_repetition(pairs, key)
    rows_of = lambda n, pred, ref: ((n, g, pred[g], ref[g]) for g in pred.keys() | ref.keys())
    return _within_rows(once, key, reference, prediction, orders, ("n", "g", "hyp", "ref"), rows_of).unionByName(_shuffled_counts(twice, key, reference, prediction, orders))


def ngram_overlap(pairs: DataFrame, key: str, reference: str, prediction: str, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(key, n, clip, pred_total, ref_total) of pairs of token lists, for each n; a pair without n-grams has no row."""
    once, twice = _by_repetition(pairs, key)
    rows_of = lambda n, pred, ref: [(n, (pred & ref).total(), pred.total(), ref.total())] if pred or ref else []
    within = _within_rows(once, key, reference, prediction, orders, ("n", "clip", "pred_total", "ref_total"), rows_of)
    per_gram = _shuffled_counts(twice, key, reference, prediction, orders)
    return within.unionByName(per_gram.groupBy(key, "n").agg(F.sum(F.least("hyp", "ref")).alias("clip"), F.sum("hyp").alias("pred_total"), F.sum("ref").alias("ref_total")))


def bleu_components(pairs: DataFrame, key: str, reference: str, prediction: str) -> DataFrame:
    """(n, clip, total) over all pairs, with clipped counts against the one reference."""
    return ngram_overlap(pairs, key, reference, prediction).groupBy("n").agg(F.sum("clip").alias("clip"), F.sum("pred_total").alias("total"))


def bleu(pairs: DataFrame, key: str, reference: str, prediction: str) -> DataFrame:
    """One row bleu_1 to bleu_4: corpus BLEU (Papineni et al., 2002) with uniform weights and no smoothing.

    An order without a match makes its BLEU and those above 0; no smoothing is applied.
    """
    parts = bleu_components(pairs, key, reference, prediction)
    clip = [F.coalesce(F.sum(F.when(F.col("n") == n, F.col("clip"))), F.lit(0)) for n in ORDERS]
    total = [F.coalesce(F.sum(F.when(F.col("n") == n, F.col("total"))), F.lit(0)) for n in ORDERS]
    row = parts.agg(*[c.alias(f"c{n}") for n, c in zip(ORDERS, clip)], *[t.alias(f"t{n}") for n, t in zip(ORDERS, total)])
    sizes = pairs.agg(F.sum(F.size(reference)).alias("r"), F.sum(F.size(prediction)).alias("c"))
    row = row.join(sizes, F.lit(True))  # one row each
    brevity = F.when(F.col("c") > F.col("r"), 1.0).when(F.col("c") > 0, F.exp(1 - F.col("r") / F.col("c"))).otherwise(0.0)

    def score(upto: int) -> Column:
        some = F.lit(True)
        logs = F.lit(0.0)
        for n in range(1, upto + 1):
            some = some & (F.col(f"c{n}") > 0)
            logs = logs + F.when(F.col(f"c{n}") > 0, F.ln(F.col(f"c{n}") / F.col(f"t{n}"))).otherwise(0.0)
        return F.when(some, brevity * F.exp(logs / upto)).otherwise(0.0)

    return row.select(*[score(n).alias(f"bleu_{n}") for n in ORDERS])


#: Standard deviation, in words, of the penalty for a length that differs from the reference's in CIDEr-D.
SIGMA = 6.0


def cider(pairs: DataFrame, key: str, item: str, reference: str, prediction: str) -> DataFrame:
    """(item, cider, cider_d): the consensus of an item's prediction with its references (Vedantam et al. 2015).

    pairs has a row (unique key) for each reference of an item, with the item's prediction beside it. n-grams weigh
    ln(items / items whose references hold them); an n-gram in none weighs as one in one. CIDEr is ten times the mean
    over orders and references of the cosines of the weighted counts. CIDEr-D counts an n-gram of the prediction no
    more often than its reference and shrinks with the squared difference of lengths. An order without weight on a
    side has cosine 0, so an item without words scores 0. Document frequencies are a table that the n-grams join, of
    any size; nothing but sums for each pair and order is gathered.
    """
    rows = materialise(pairs.select(F.col(key).alias("__key"), F.col(item).alias("__item"), F.col(reference).alias("__ref"), F.col(prediction).alias("__pred")))
    grams = materialise(ngram_counts(rows, "__key", "__ref", "__pred"))
    items = rows.agg(F.countDistinct(F.coalesce(F.col("__item").cast("string"), F.lit("\0")))).first()[0]
    held = grams.where("ref > 0")
    if item != key:  # else each row of grams is an item's own
        held = held.join(rows.select("__key", "__item"), "__key").select("n", "g", "__item").distinct()
    known = held.groupBy("n", "g").agg(F.count("*").alias("df"))
    weighed = grams.join(known, ["n", "g"], "left").withColumn("w", F.pow(F.ln(F.lit(float(items)) / F.coalesce("df", F.lit(1))), 2))
    hyp, ref, w = F.col("hyp"), F.col("ref"), F.col("w")
    sums = weighed.groupBy("__key", "n").agg(
        F.sum(hyp * ref * w).alias("dot"), F.sum(F.least(hyp, ref) * ref * w).alias("clip"), F.sqrt(F.sum(hyp * hyp * w)).alias("h"), F.sqrt(F.sum(ref * ref * w)).alias("r"),
    )
    norm = F.col("h") * F.col("r")
    over = lambda top: F.coalesce(F.sum(F.when(norm > 0, F.col(top) / norm)), F.lit(0.0)) * 10 / len(ORDERS)
    scores = sums.groupBy("__key").agg(over("dot").alias("c"), over("clip").alias("d"))
    penalty = F.exp(-F.pow(F.size("__pred") - F.size("__ref"), 2) / (2 * SIGMA**2))
    each = rows.join(scores, "__key", "left").select("__item", F.coalesce("c", F.lit(0.0)).alias("c"), (F.coalesce("d", F.lit(0.0)) * penalty).alias("d"))
    return each.groupBy(F.col("__item").alias(item)).agg(F.avg("c").alias("cider"), F.avg("d").alias("cider_d"))


def f_score(p: Column, r: Column, alpha: float = 0.5) -> Column:
    below = (1 - alpha) * p + alpha * r
    return F.when(below > 0, p * r / below).otherwise(0.0)


def rouge_n(pairs: DataFrame, key: str, reference: str, prediction: str, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(n, p, r, f): ROUGE-N (Lin, 2004) averaged over all pairs; a pair without n-grams on a side counts with 0."""
    n_pairs = pairs.agg(F.count("*").alias("pairs"))
    p = F.when(F.col("pred_total") > 0, F.col("clip") / F.col("pred_total")).otherwise(0.0)
    r = F.when(F.col("ref_total") > 0, F.col("clip") / F.col("ref_total")).otherwise(0.0)
    sums = ngram_overlap(pairs, key, reference, prediction, orders).groupBy("n").agg(F.sum(p).alias("p"), F.sum(r).alias("r"), F.sum(f_score(p, r)).alias("f"))
    return sums.join(n_pairs, F.lit(True)).select("n", *[(F.col(c) / F.col("pairs")).alias(c) for c in "prf"])


def _lcs(a: list[str], b: list[str], weight: float) -> float:
    """Length of the longest common subsequence; with a weight above 1, consecutive matches of length k count k ** weight."""
    if weight == 1:  # a bit for each word of a, all of them at once for each word of b (Hyyrö 2004)
        at: dict[str, int] = {}
        for i, x in enumerate(a):
            at[x] = at.get(x, 0) | 1 << i
        row = whole = (1 << len(a)) - 1
        for y in b:
            met = row & at.get(y, 0)
            row = (row + met | row - met) & whole
        return float(len(a) - row.bit_count())
    best, run = [0.0] * (len(b) + 1), [0] * (len(b) + 1)
    for x in a:
        corner_best, corner_run = 0.0, 0
        for j, y in enumerate(b, 1):
            above_best, above_run = best[j], run[j]
            if x == y:
                best[j], run[j] = corner_best + (corner_run + 1) ** weight - corner_run**weight, corner_run + 1
            else:
                best[j], run[j] = max(above_best, best[j - 1]), 0
            corner_best, corner_run = above_best, above_run
    return best[-1]


def rouge_lcs(pairs: DataFrame, key: str, reference: str, prediction: str, weight: float = 1.0, stemmed: bool = True) -> DataFrame:
    """(key, p, r, f): ROUGE-L, or with a weight above 1 ROUGE-W, of each pair; words are stemmed first if asked for."""
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stems: dict[str, str] = {}
        for frame in frames:
            rows = []
            for k, ref, pred in zip(frame.iloc[:, 0], frame.iloc[:, 1], frame.iloc[:, 2]):
                if stemmed:
                    if len(stems) > STEMS:
                        stems.clear()
                    ref, pred = ([stems.get(w) or stems.setdefault(w, stem(w)) for w in x] for x in (ref, pred))
                both = _lcs(list(ref), list(pred), weight)
                p = (both / len(pred) ** weight) ** (1 / weight) if len(pred) else 0.0
                r = (both / len(ref) ** weight) ** (1 / weight) if len(ref) else 0.0
                rows.append((k, p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pd.DataFrame(rows, columns=[key, "p", "r", "f"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, reference, prediction).mapInPandas(score, f"{key} {kind}, p double, r double, f double")


def stemmed(words: Column) -> Column:
    """The stems of a list of words, in place."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for some in lists:
            if len(known) > STEMS:
                known.clear()
            flat = [known.get(w) or known.setdefault(w, stem(w)) for w in some.flatten().to_pylist()]
            sizes = pc.fill_null(pc.list_value_length(some), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.string()))

    return run(words)


def rouge_scores(pairs: DataFrame, key: str, reference: str, prediction: str, weight: float = 1.2, lcs: bool = True) -> DataFrame:
    """(key, metric, p, r, f) of each pair for rouge-1 to rouge-4, and with lcs for rouge-l and rouge-w; 0 where nothing matches."""
    share = lambda total: F.when(F.col(total) > 0, F.col("clip") / F.col(total)).otherwise(0.0)
    found = ngram_overlap(pairs, key, reference, prediction).select(F.col(key).alias("__k"), "n", share("pred_total").alias("p"), share("ref_total").alias("r"))
    every = pairs.select(key, F.explode(F.array(*map(F.lit, ORDERS))).alias("__n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = every.join(found, (F.col(key) == F.col("__k")) & (F.col("__n") == F.col("n")), "left").select(key, F.concat(F.lit("rouge-"), F.col("__n").cast("string")).alias("metric"), zero("p"), zero("r"))
    out = out.withColumn("f", f_score(F.col("p"), F.col("r")))
    for name, w in (("rouge-l", 1.0), ("rouge-w", weight)) if lcs else ():
        out = out.unionByName(rouge_lcs(pairs, key, reference, prediction, w, False).withColumn("metric", F.lit(name)))
    return out


def rouge_report(scores: DataFrame, item: str) -> DataFrame:
    """(metric, aggregator, p, r, f) from scores (item, metric, p, r, f) of an item's prediction with each of its references.

    Avg takes the mean over an item's references, Best the reference with the highest f (then r, then p); both then the
    mean over items.
    """
    best = F.max(F.struct("f", "r", "p"))
    each = scores.groupBy(item, "metric").agg(*[F.avg(c).alias(f"a_{c}") for c in "prf"], best.alias("b"))
    sides = F.array(F.struct(F.lit("Avg").alias("aggregator"), *[F.col(f"a_{c}").alias(c) for c in "prf"]), F.struct(F.lit("Best").alias("aggregator"), *[F.col(f"b.{c}").alias(c) for c in "prf"]))
    rows = each.select("metric", F.inline(sides))
    return rows.groupBy("metric", "aggregator").agg(*[F.avg(c).alias(c) for c in "prf"])


def novelty(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """One row: the share of predictions (text) that no known text equals, copies counted each time.

    Texts meet by a 128-bit hash, so that whole texts are not join keys; a null text equals none.
    """
    key = F.md5(F.col("text").cast("binary"))
    seen = known.select(key.alias("__known")).distinct()
    joined = predictions.select(key.alias("__k")).join(seen, F.col("__k") == F.col("__known"), "left")
    return joined.agg(F.count("*").alias("n"), F.sum(F.col("__known").isNull().cast("long")).alias("n_new"), F.avg(F.col("__known").isNull().cast("double")).alias("novelty"))


def distinctness(rows: DataFrame, item: str, caption: str) -> DataFrame:
    """One row: captions in exactly one item, copies of captions in several, copies within items, and shares.

    nr_distinct counts captions of one item only; nr_duplicate_total sums, for captions of several items, the number
    of those items; within_item_duplicates sums all copies of captions that an item has more than once.
    """
    cells = rows.groupBy(item, caption).agg(F.count("*").alias("k"))
    within = cells.groupBy(caption).agg(F.count("*").alias("items"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("w"), F.sum("k").alias("rows"))
    out = within.agg(
        F.sum((F.col("items") == 1).cast("long")).alias("nr_distinct"),
        F.sum(F.when(F.col("items") > 1, F.col("items")).otherwise(0)).alias("nr_duplicate_total"),
        F.sum("w").alias("within_item_duplicates"), F.sum("rows").alias("n"),
    )
    return out.select(
        "nr_distinct", "nr_duplicate_total", "within_item_duplicates",
        (F.col("nr_distinct") / F.nullif(F.col("nr_distinct") + F.col("nr_duplicate_total"), F.lit(0))).alias("fraction_distinct"),
        (F.col("within_item_duplicates") / F.nullif("n", F.lit(0))).alias("fraction_within_duplicates"),
    )


def vocabulary_size(rows: DataFrame, words: str) -> DataFrame:
    return rows.select(F.explode_outer(words).alias("w")).agg(F.countDistinct("w").alias("size"))


def diversity(pairs: DataFrame, train: DataFrame, reference: str, prediction: str) -> DataFrame:
    """One row of eleven measures of predictions: novelty against the train texts, distinctness within and across items
    (those with one reference text), and vocabulary sizes of train, references and predictions with their ratios.

    pairs has ref_text and pred_text and token lists under the given names, train has text and words. A share without a
    denominator is null.
    """
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    new = novelty(pairs.select(F.col("pred_text").alias("text")), train).select(F.col("novelty").alias("novelty_score"))
    out = new.join(distinctness(pairs.select(digest("ref_text").alias("i"), digest("pred_text").alias("c")), "i", "c"), F.lit(True))
    out = out.join(vocabulary_size(train, "words").withColumnRenamed("size", "vocab_size_ref"), F.lit(True))
    out = out.join(vocabulary_size(pairs, prediction).withColumnRenamed("size", "vocab_size_predictions"), F.lit(True))
    out = out.join(vocabulary_size(pairs, reference).withColumnRenamed("size", "__r"), F.lit(True))  # one row each
    return out.select(
        "novelty_score", "fraction_distinct", "nr_distinct", "nr_duplicate_total", "within_item_duplicates", "fraction_within_duplicates", "vocab_size_ref", "vocab_size_predictions",
        (F.col("vocab_size_predictions") / F.nullif("vocab_size_ref", F.lit(0))).alias("vocab_perc_intrain"),
        (F.col("vocab_size_predictions") / F.nullif("__r", F.lit(0))).alias("vocab_perc_inref"),
        (F.col("vocab_size_ref") / F.nullif("__r", F.lit(0))).alias("vocab_per_test_train"),
    )


def accuracy(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count("*").alias("n"))


def style_error(rows: DataFrame, label: str, of_reference: str, of_prediction: str) -> DataFrame:
    """One row: accuracies on references and predictions, and the share where only the reference was recognised."""
    right, wrong = F.col(label) == F.col(of_reference), F.col(label) != F.col(of_prediction)
    return rows.agg(
        F.avg(right.cast("double")).alias("accuracy_reference"), F.avg((~wrong).cast("double")).alias("accuracy_prediction"),
        F.avg((right & wrong).cast("double")).alias("style_error"),
    )


def masked_cross_entropy(rows: DataFrame, true: str, probability: str) -> DataFrame:
    """One row: the mean of -ln(probability of the true class) over rows whose true class is not 0."""
    live = F.col(true) != 0
    return rows.agg((F.sum(F.when(live, -F.ln(probability)).otherwise(0.0)) / F.nullif(F.sum(live.cast("long")), F.lit(0))).alias("loss"))
