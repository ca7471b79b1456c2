"""Runs of periodic words, by a suffix tree of each document and smaller-half leaf lists (Stoye, Gusfield 2002).

The tree is that of sorted suffixes: a node is an interval of suffixes whose neighbours share at least its depth, its
children are the pieces between the places that share exactly that. At a node of depth q each leaf outside of the
largest child asks whether the suffixes q words on and q words back are in another child; if so, two copies of q words
stand side by side, and the next word breaks the period. Such a branching repeat is rotated to the left as far as words
repeat, which makes it a maximal run; repeats that end in the same run merge, and the least period stays.

Trees of many documents are built at once, in numpy: words of different documents count as different. Words are told
apart by 64-bit hashes; that two of a document with a million words share one has a probability of 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import batches, id_crc, sha256_text, table, text_of
from .words import Words, mixed, word_hashes, words_in

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3

#: Words of the documents whose trees are built at a time; a longer document is alone.
TOGETHER = 1 << 18

#: Leaves that are looked at together.
LEAVES = 1 << 20


class Suffixes(NamedTuple):
    """Suffixes in order, the place of each in it, and the words that each shares with the one before."""

    order: np.ndarray
    place: np.ndarray
    shared: np.ndarray


def sort_suffixes(words: np.ndarray, end: np.ndarray) -> Suffixes:
    """Suffixes by prefix doubling; end: where the text of each word ends. Equal words of different texts must differ."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    begins = np.r_[True, words[order[1:]] != words[order[:-1]]]
    rank = np.full(n + 1, -1, np.int64)  # of a suffix: the first place of those that are equal to it so far
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank[order] = first
    shared = np.zeros(n + 1, np.int32)
    levels, width = [rank.copy()], 1
    while True:
        open_ = np.flatnonzero(~(begins & np.r_[begins[1:], True]))  # places of suffixes that are not alone
        if not len(open_):
            break
        at = order[open_]
        after = at + width
        key = rank[at] * (n + 1) + np.where(after < end[at], rank[np.minimum(after, n)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.r_[True, key[1:] != key[:-1]]
        split = np.flatnonzero(new & ~begins[open_])  # a new border between a suffix and the one before it
        left, right, length = at[split - 1], at[split], np.full(len(split), width, np.int64)
        for level in range(len(levels) - 2, -1, -1):  # not of the width itself: so many words more are not equal
            same = levels[level][left + length] == levels[level][right + length]
            length += same << level
        shared[open_[split]] = length
        begins[open_[split]] = True
        first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        rank[at] = first[open_]
        levels.append(rank.copy())
        width *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return Suffixes(order, place, shared)


class Nodes(NamedTuple):
    """Children of inner nodes, but for the largest of each: places of the child, of its node, and the node's depth."""

    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray


def _nearest(value: np.ndarray, step: int, strict_from: np.ndarray | None = None) -> np.ndarray:
    """For each place with a value, the nearest on one side whose value is not greater or, from there on, is less.
    Pointers jump over pointers; all between a place and where it points are greater (or not less)."""
    inner = np.flatnonzero(value > 0)
    to = np.arange(len(value)) + step if strict_from is None else strict_from.copy()
    while len(inner):
        passed = value[to[inner]] > value[inner] if strict_from is None else value[to[inner]] >= value[inner]
        inner = inner[passed]
        to[inner] = to[to[inner]]
    return to


def small_children(shared: np.ndarray) -> Nodes:
    """The children of all inner nodes but the root, without the largest of each node."""
    before, after = _nearest(shared, -1), _nearest(shared, 1)
    low, high = _nearest(shared, -1, before), _nearest(shared, 1, after)
    inner = np.flatnonzero(shared > 0)
    first = inner[shared[before[inner]] < shared[inner]]
    head = np.arange(len(shared))
    rest = inner[shared[before[inner]] == shared[inner]]
    head[rest] = before[rest]
    while len(rest := rest[head[head[rest]] != head[rest]]):
        head[rest] = head[head[rest]]
    # to the right of each border one child, to the left of a node's first border another
    of, start, stop = np.r_[inner, first], np.r_[inner, low[first]], np.r_[after[inner], first]
    node, size = head[of], stop - start
    largest = np.zeros(len(shared), np.int64)
    key = size * (2 * len(shared)) + np.arange(len(size))
    np.maximum.at(largest, node, key)
    small = key != largest[node]
    of = of[small]
    return Nodes(start[small], stop[small], low[of], high[of], shared[of].astype(np.int64))


def branching(s: Suffixes, nodes: Nodes, begin: np.ndarray, end: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths q of pairs of equal neighbours of q words whose next word is another one than q before.
    Lengths that a run of that many times would not fit into its document are left out."""
    of = s.order[nodes.low]
    fits = nodes.depth * times <= end[of] - begin[of]
    nodes = Nodes(*[x[fits] for x in nodes])
    size = nodes.stop - nodes.start
    before = np.r_[0, np.cumsum(size)]
    starts, lengths, done = [], [], 0
    while done < len(size):
        to = max(done + 1, int(np.searchsorted(before, before[done] + LEAVES, "right")) - 1)
        k = np.repeat(np.arange(done, to), size[done:to])
        leaf = np.arange(len(k)) - (before[k] - before[done]) + nodes.start[k]
        i, q = s.order[leaf], nodes.depth[k]
        for other, inside, left in ((i + q, i + q < end[i], i), (i - q, i - q >= begin[i], i - q)):
            there = s.place[np.where(inside, other, 0)]
            hit = inside & (there >= nodes.low[k]) & (there < nodes.high[k]) & ((there < nodes.start[k]) | (there >= nodes.stop[k]))
            starts.append(left[hit])
            lengths.append(q[hit])
        done = to
    found = np.unique(np.stack([np.concatenate(lengths or [np.empty(0, np.int64)]), np.concatenate(starts or [np.empty(0, np.int64)])], 1), axis=0)
    return found[:, 1], found[:, 0]


def rotate(words: np.ndarray, at: int, q: int, begin: int) -> int:
    """The first word of the run of period q that holds the words at to at + 2 q."""
    size = 32
    while at > begin:
        low = max(begin, at - size)
        other = np.flatnonzero(words[low:at] != words[low + q : at + q])
        if len(other):
            return low + int(other[-1]) + 1
        at, size = low, size * 2
    return at


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and period. words: a number for each word of some texts, equal for
    equal words of one text, different for different texts; first: where each text begins, and the end of the last."""
    if not len(words):
        return []
    sizes = np.diff(first)
    begin, end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    s = sort_suffixes(words, end)
    at, period = branching(s, small_children(s.shared), begin, end, times)
    # what a run of the least length must hold, looked at first
    begin, stop = begin[at], at + 2 * period
    low = stop - np.maximum(least, times * period)
    able = low >= begin
    at, period, begin, stop, low = (x[able] for x in (at, period, begin, stop, low))
    able = words[low] == words[low + period]
    for back in (1, 2, 4):
        x = np.maximum(at - back, low)
        able &= words[x] == words[x + period]
    found: dict[tuple[int, int], int] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, q, b, e, x in zip(*(v[able].tolist() for v in (at, period, begin, stop, low)), strict=True):  # by period
        if any(q % p == 0 and start <= i for start, p in ends.get(e, ())):
            continue  # merges into a run of a period that divides its own
        start = rotate(words, i, q, b)
        if start <= x:
            found.setdefault((start, e), q)
            ends.setdefault(e, []).append((start, q))
    return sorted(((a, e, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _groups(first: np.ndarray) -> Iterable[tuple[int, int]]:
    """Ranges of texts that have up to TOGETHER words, or of one."""
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[at] + TOGETHER, "right")) - 1)
        yield at, to
        at = to


def find_in(texts: pa.Array, least: int = LEAST, times: int = TIMES) -> tuple[Words, list[tuple[int, int, int]]]:
    """The words of a batch of texts, and all their runs by words counted over the batch."""
    words, found = words_in(texts), []
    h = word_hashes(words)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    with np.errstate(over="ignore"):
        h = mixed(h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    for a, b in _groups(words.first):
        low = int(words.first[a])
        found += [(s + low, e + low, q) for s, e, q in runs_of(h[low : words.first[b]], words.first[a : b + 1] - low, least, times)]
    return words, found


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs (needs doc_id and text).

    A run is a stretch of words [^\\x20\\x09-\\x0D]+ with least period q, of at least `least` words and `times` q, that
    no word beside it extends. runs is an array of struct<start, length, period> by start, then period; words are
    numbered from 0. collapsed has the words left when of each run all after the first q go, joined by one space. A
    null text is the empty one: no words, no runs, an empty text. Repeated rows give repeated rows, an empty table
    none; a null id stays; other columns are ignored, whatever their names. A text is read as a whole: its tree takes
    about 450 bytes for each of its words, in its own task.
    """

    def find(frame: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = frame.column(1)
        words, found = find_in(texts, least, times)
        first = words.first
        gone = np.zeros(int(first[-1]) + 1, np.int64)
        for s, e, q in found:
            gone[s + q] += 1
            gone[e] -= 1
        stays = np.cumsum(gone)[:-1] == 0
        starts = np.array([s for s, _, _ in found], np.int64)
        borders = np.searchsorted(starts, first)
        runs, kept = [], []
        for i, data in enumerate(texts.cast(pa.binary())):
            a, b = int(first[i]), int(first[i + 1])
            runs.append([(s - a, e - s, q) for s, e, q in found[borders[i] : borders[i + 1]]])
            split = data.as_py().split()
            kept.append(b" ".join(split if stays[a:b].all() else compress(split, stays[a:b].tolist())))
        columns = [frame.column(0), pa.array(np.diff(first), pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    docs = docs.select("doc_id", text_of().alias("text"))
    return docs.mapInArrow(batches(find), T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]))


def planted(docs: DataFrame) -> DataFrame:
    """docs with a period put into the words of every tenth text, by a hash of doc_id, and one space between the words
    of those: with h = crc32(doc_id), g = h / 10 and n words, word i >= a = g mod n becomes word a + (i - a) mod p, where
    p = 1 + (n - a) / (3 + g mod 8)."""
    h = id_crc()
    words = F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_of().alias("text"), F.when(h % 10 == 0, words).alias("w"), F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 10").alias("g"))
    rows = rows.select("*", F.size("w").alias("n"))
    rows = rows.select("*", F.expr("if(n > 0, g % n, 0)").alias("a"))
    rows = rows.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    edited = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, cast(a + (i - a) % p as int))]), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNotNull() & (F.col("n") > 0), edited).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, by exact comparison; of equal ones that which comes first."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("*", strongest(F.col("runs")).alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), sha256_text(lines).alias("runs_sha256"), sha256_text(F.col("collapsed")).alias("collapsed_sha256"),
    )
