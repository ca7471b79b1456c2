"""Removal of word passages that occur more than once: windows of words counted exactly in super-k-mer buckets.

Every run of consecutive windows of a document that share their minimiser (the m words with the smallest hash) is one
super-k-mer. It travels once, as one packed string, to the bucket that its minimiser names; equal windows have equal
minimisers and so meet in one bucket. There windows are sorted by a hash of their words, and those with equal hashes
are compared word by word. A task sends equal super-k-mers once. Where it met one more than once, it knows already that all
windows of it are repeated and gives their places out itself, so that a passage with very many copies reaches its bucket
as one string of each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import BLANK_CLASS, cut, table

#: Words of a window and of a minimiser.
WINDOW, MINIMISER = 35, 4

#: Bytes of packed strings that a task gathers before it sends them off, bytes wanted in a bucket, and buckets of a task.
GATHER, BUCKET, PER_TASK = 24 << 20, 10 << 20, 2

#: Super-k-mers of a cell of minimisers from which, at four times as many or of the mean, it counts as hot; cells at most,
#: which bounds the hot ones that are broadcast to a quarter, 8 MB. Text of over 3.4 TB has more buckets than cells for them.
LEAST_HOT, MOST_CELLS = 500, 1 << 22

#: Distinct words whose hashes a worker keeps.
CACHE = 100_000

_SPLIT = re.compile(BLANK_CLASS + "+")
_OTHER = re.compile(r"[^\S\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str) -> list[str]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, unchanged."""
    if text.isascii():  # str.split also cuts at four control characters
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    elif not _OTHER.search(text):
        return text.split()
    return [w for w in _SPLIT.split(text) if w]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, from the words' hashes: a polynomial over 2^64, by doubling."""
    n = len(h) - k + 1
    out, done, power, have = None, 0, _ODD, h
    width = 1
    while width <= k:
        if k & width:
            out = have[done : done + n].copy() if out is None else out * power + have[done : done + n]
            done += width
        if width * 2 > k:
            break
        have = have[: len(have) - width] * power + have[width:]
        power = power * power
        width *= 2
    return _mix(out)


def super_kmers(h: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer of a document with these word hashes: first window, windows, hash of the minimiser, and
    whether the minimiser is in it once only, so that no two of its windows are equal."""
    with np.errstate(over="ignore"):
        keys = _mix(run_hashes(h, m) ^ _ODD)
    span = window - m + 1
    low, width = keys, 1  # sliding minimum by doubling
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(h) - window + 1
    low = np.minimum(low[:n], low[span - width : span - width + n])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n, low = np.diff(np.append(first, n)), low[first]
    size = n + span - 1
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(first - begin, size)
    once = np.add.reduceat((keys[at] == np.repeat(low, size)).view(np.int8), begin, dtype=np.int64) == 1
    return first, n, low, once


def _cells(n_cells: int, window: int, m: int):
    """Of Arrow batches (doc_key, text): rows (cell, n), the super-k-mers of each cell of minimisers."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = Hashes(), []

        def give() -> Iterator[pa.RecordBatch]:
            cell, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])
            found.clear()

        for frame in frames:
            for text in frame.column(1):
                words = words_of(text.as_py() or "")
                if len(words) >= window:
                    with np.errstate(over="ignore"):
                        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                        found.append(_cell(super_kmers(h, window, m)[2], n_cells))
            if sum(map(len, found)) > 4_000_000:
                yield from give()
        if found:
            yield from give()

    return run


def _cell(low: np.ndarray, n_cells: int) -> np.ndarray:
    return (low >> np.uint64(24)) % np.uint64(n_cells)


def _places(n_parts: int, n_cells: int, hot: Broadcast, window: int, m: int):
    """Of Arrow batches (doc_key, text): rows (part, blob), blob a packed and compressed share of a bucket.

    Super-k-mers of hot cells are taken apart into windows, which go to buckets by the hash of all their words.
    """

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = Hashes(), zstandard.ZstdCompressor(level=3)
        found: dict[str, list[int]] = {}  # of each string its bucket, first place, part of the minimiser, kind, further places
        size, hot_cells = 0, hot.value

        turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            rows: list[tuple[int, bytes]] = []
            known: list[int] = []

            def give() -> Iterator[pa.RecordBatch]:
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["part", "blob"])
                    rows.clear()

            def known_shares(least: int) -> Iterator[pa.RecordBatch]:
                nonlocal known, turn
                while len(known) > least:  # dealt out in turn, however common a passage is
                    share, known = known[:30_000], known[30_000:]
                    rows.append((turn % n_parts, packed(np.array([0, len(share) // 3], np.int64), np.array(share, np.int64))))
                    turn += 7
                    if len(rows) >= 64:
                        yield from give()

            strings, values = list(found), list(found.values())
            found.clear()
            bucket = np.array([v[0] for v in values], np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
            held = 0
            for group in np.split(order, edges[1:]) if len(order) else []:
                some = [values[i] for i in group]
                at = np.array([x for v in some for x in v[1:3]], np.int64)
                key = np.array([v[3] for v in some], np.uint32)
                kind = np.array([1 + v[4] if len(v) == 5 else 0 for v in some], np.uint8)
                blob = packed(np.array([len(some), 0], np.int64), at, key, kind, "\n".join([strings[i] for i in group]))
                rows.append((some[0][0], blob))
                held += len(blob)
                for i, v in zip(group, some):
                    if len(v) > 5:
                        n = strings[i].count(" ") + 2 - window
                        known += (v[1], v[2], n)
                        known += [x for j in range(5, len(v), 2) for x in (v[j], v[j + 1], n)]
                yield from known_shares(30_000)
                if len(rows) >= 4096 or held > 4 << 20:
                    yield from give()
                    held = 0
            yield from known_shares(0)
            yield from give()

        def packed(*items: np.ndarray | str) -> bytes:
            return packer.compress(b"".join(x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x.tobytes() for x in items))

        for frame in frames:
            for key, text in zip(frame.column(0), frame.column(1)):
                words = words_of(text.as_py() or "")
                if len(words) < window:
                    continue
                with np.errstate(over="ignore"):
                    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    first, n, low, once = super_kmers(h, window, m)
                    if len(hot_cells):
                        apart = np.isin(_cell(low, n_cells), hot_cells)
                        if apart.any():
                            names = run_hashes(h, window)
                            single = np.arange(int(n[apart].sum())) + np.repeat(first[apart] - (np.cumsum(n[apart]) - n[apart]), n[apart])
                            first, n = np.concatenate([first[~apart], single]), np.concatenate([n[~apart], np.ones_like(single)])
                            low, once = np.concatenate([low[~apart], names[single]]), np.concatenate([once[~apart], np.ones(len(single), bool)])
                key = key.as_py()
                turn = turn or key % n_parts
                parts, short = (low % np.uint64(n_parts)).tolist(), (low >> np.uint64(32)).tolist()
                for a, b, i, k, o in zip(first.tolist(), (first + n + window - 1).tolist(), parts, short, once.tolist()):
                    string = " ".join(words[a:b])
                    if (at := found.get(string)) is None:
                        found[string] = [i, key, a, k, o]
                        size += 2 * len(string) + 200
                    else:
                        at += (key, a)
                        size += 80
                if size > 4 * GATHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def repeated_windows(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, windows) of the runs of windows in strings with one place that occur more than once in a bucket.

    A blob is a task's share, unpacked: the number of strings, of each its first place, a part of its minimiser's
    hash, its kind (0: met more than once by the task, its places are known already; 2: no two of its windows are
    equal; 1: else), then the strings. A string of kind 2 whose minimiser no other string has is done with unread.
    """
    shares, keys, kinds, at = [], [], [], []
    for raw in blobs:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at.append(np.frombuffer(raw, np.int64, 2 * n, 16))
        keys.append(np.frombuffer(raw, np.uint32, n, 16 + 16 * n))
        kinds.append(np.frombuffer(raw, np.uint8, n, 16 + 20 * n))
        shares.append(n)
    at, kind, key = np.concatenate(at).reshape(-1, 2), np.concatenate(kinds), np.concatenate(keys)
    _, number_of, times = np.unique(key, return_inverse=True, return_counts=True)
    read = (kind != 2) | (times[number_of] > 1)
    strings: list[str] = []
    begin = 0
    for raw, n in zip(blobs, shares):
        some = read[begin : begin + n]
        begin += n
        if some.any():
            strings += compress(raw[16 + 21 * n :].decode("utf-8", "surrogatepass").split("\n"), some.tolist())
    if not strings:
        return (np.empty(0, np.int64),) * 3
    at, lone = at[read], (kind[read] > 0).astype(np.int64)
    # a string's number stands for its text from here on; equal strings of several tasks are one
    number: dict[str, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    many = np.bincount(which, 2 - lone, len(number))
    hashes, ids = Hashes(), {}
    texts = list(number)
    split = [s.split(" ") for s in texts]
    length = np.array([len(w) for w in split], np.int64)
    with np.errstate(over="ignore"):
        h = np.fromiter((hashes[w] for words in split for w in words), np.uint64, int(length.sum()))
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        all_runs = run_hashes(h, window)
    n_windows = length - window + 1
    owner = np.repeat(np.arange(len(texts)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    place = start[owner] + offset
    runs = all_runs[place]
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    twice = np.repeat(many > 1, n_windows)  # in a string with several places every window is
    flagged = np.zeros(len(owner), bool)
    if same.any():
        member = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        rows = order[member]
        group = np.concatenate([[0], np.cumsum(runs[rows][1:] != runs[rows][:-1])])
        # equal hashes: words are compared with those of the group's first, as exact numbers
        word_id = np.fromiter((ids.setdefault(w, len(ids)) for words in split for w in words), np.int64, len(h))
        head = rows[np.searchsorted(group, group)]
        equal = np.ones(len(rows), bool)
        for k in range(window):
            equal &= word_id[place[rows] + k] == word_id[place[head] + k]
        size = np.bincount(group[equal], minlength=int(group[-1]) + 1)
        flagged[rows[equal & (size[group] > 1)]] = True
        odd = np.flatnonzero(~equal)
        if len(odd):  # windows with equal hashes and different words: by their words
            seen: dict[tuple[int, ...], list[int]] = {}
            for i in odd:
                seen.setdefault(tuple(word_id[place[rows[i]] : place[rows[i]] + window]), []).append(int(rows[i]))
            for group_rows in seen.values():
                if len(group_rows) > 1:
                    flagged[group_rows] = True
    flagged |= twice
    # runs of flagged windows of each text, given to every string that has this text and one place
    edge = np.flatnonzero(flagged & ~np.concatenate([[False], flagged[:-1] & (owner[1:] == owner[:-1])]))
    last = np.flatnonzero(flagged & ~np.concatenate([flagged[1:] & (owner[1:] == owner[:-1]), [False]]))
    of, a, n = owner[edge], offset[edge], last - edge + 1
    low, high = np.searchsorted(of, which, "left"), np.searchsorted(of, which, "right")
    times = (high - low) * lone
    string = np.repeat(np.arange(len(strings)), times)
    run = low[string] + np.arange(len(string)) - np.repeat(np.cumsum(times) - times, times)
    return at[string, 0], at[string, 1] + a[run], n[run]


def _buckets(window: int):
    """Of Arrow batches (part, blob), sorted by part: rows (doc_key, first, n)."""

    def rows(key: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 200_000):
            end = at + 200_000
            yield pa.RecordBatch.from_arrays([pa.array(key[at:end]), pa.array(first[at:end].astype(np.int32)), pa.array(n[at:end].astype(np.int32))], names=["doc_key", "first", "n"])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        part, blobs = None, []
        for frame in frames:
            for p, blob in zip(frame.column(0).to_pylist(), frame.column(1)):
                if p != part and blobs:
                    yield from rows(*repeated_windows(blobs, window))
                    blobs = []
                part, raw = p, opener.decompress(blob.as_py())
                strings, known = np.frombuffer(raw, np.int64, 2)
                if strings:
                    blobs.append(raw)
                else:
                    yield from rows(*np.frombuffer(raw, np.int64, 3 * known, 16).reshape(-1, 3).T)
        if blobs:
            yield from rows(*repeated_windows(blobs, window))

    return run


def find_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(doc_key, first, n): runs of windows of docs (doc_key, text) whose words also start elsewhere.

    Windows from first to first + n - 1 (word numbers from 0) each occur at least twice, in any documents or in one.
    The number of buckets follows the bytes of text. A task that makes strings holds GATHER of them whatever that number
    is; one that reads gets PER_TASK buckets or more, sorted, and holds one at a time. However common a passage is, it
    adds one string for each task that met it. A minimiser with very many different surroundings, found by a count
    over all super-k-mers, does not name a bucket: windows around it go by their own hashes.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = int(max(8, 3.2 * total / BUCKET))
    docs = docs.select("doc_key", "text")
    # minimisers that very many super-k-mers share, by the cells of their hashes; most cells hold like numbers
    n_cells = 4 * min(n_parts, MOST_CELLS // 4)
    cells = docs.mapInArrow(_cells(n_cells, window, m), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = cut(cells, "cells")
    mean = (cells.agg(F.sum("n")).first()[0] or 0) / n_cells
    hot = [r["cell"] for r in cells.where(F.col("n") > 4 * max(mean, LEAST_HOT)).select("cell").collect()]  # fewer than a quarter of the cells
    hot = docs.sparkSession.sparkContext.broadcast(np.array(sorted(hot), np.uint64))
    sent = docs.mapInArrow(_places(n_parts, n_cells, hot, window, m), "part long, blob binary")
    # tasks by cores, not by the size of the table: a larger one puts more buckets, sorted, into each
    conf, cores = docs.sparkSession.conf, docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(8, min(n_parts // PER_TASK, max(4 * cores, int(conf.get("spark.sql.shuffle.partitions")))))
    dealt = sent.repartition(tasks, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_buckets(window), "doc_key long, first int, n int")


def _cover(runs: list[dict] | None, n_words: int, window: int) -> np.ndarray:
    """Which words of a text are in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for r in runs or ():
        edge[r["first"]] += 1
        edge[r["first"] + r["n"] + window - 1] -= 1
    return edge.cumsum()[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): kept is the text of the words that stay.

    Words are [^\\x20\\x09-\\x0D]+, kept ones are joined by one space. A word goes if any window of `window` words
    around it also starts elsewhere; windows are judged on the input. Null is the empty text; texts shorter than a
    window keep all words. Rows are told apart by position in the input table, so that repeated rows and ids count
    as separate occurrences. An empty table gives no rows; other columns are ignored.
    """
    twice = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() > 0
    if twice or docs.schema["doc_id"].dataType != T.LongType():
        docs = cut(docs.select(F.monotonically_increasing_id().alias("doc_key"), "doc_id", "text"), "keyed")
    else:
        docs = docs.select(F.col("doc_id").alias("doc_key"), "doc_id", "text")
    runs = find_repeats(docs, window, m)
    hit = runs.groupBy("doc_key").agg(F.collect_list(F.struct("first", "n")).alias("runs")).withColumnRenamed("doc_key", "__key")
    joined = docs.join(hit, F.col("doc_key") == F.col("__key"), "left").select("doc_id", "text", "runs")

    def clean(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 1000):
                part = frame.slice(at, 1000)
                n_words, n_removed, kept = [], [], []
                for text, found in zip(part.column(1), part.column(2)):
                    words = words_of(text.as_py() or "")
                    gone = 0
                    total = len(words)
                    if found.is_valid:
                        cover = _cover(found.as_py(), total, window)
                        gone = int(cover.sum())
                        words = [w for w, c in zip(words, cover.tolist()) if not c]
                    n_words.append(total)
                    n_removed.append(gone)
                    kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(clean, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
