"""Fingerprints of documents: one-permutation MinHash with optimal densification, packed to a few bits a bin.

Each shingle is hashed once; the hash's first bits name a bin, and a bin keeps its least hash (Li, Owen, Zhang 2012).
An empty bin looks at the other bins in a random order of its own, the same for all documents, and takes over the first
that is not empty (Shrivastava 2017). Of each bin only the low-order bits are stored (Li, König 2010); bins of different
content agree by chance once in 2^bits, which likeness() takes out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import sha256_text, table, text_of
from .substrings import run_hashes
from .words import mixed, word_hashes, words_in

#: Words of a shingle, bins of a fingerprint (a power of two) and bits stored of each.
SHINGLE, BINS, BITS = 5, 1024, 4

#: Bins that are not empty, up to which an empty one looks for the first of them instead of looking around.
FEW = 16

#: Texts whose bins are in memory at a time.
ROWS = 128

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _order(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin that each bin looks at first, second and so on (a row for each step), and the step at which it sees each."""
    if bins not in _orders:
        seen = np.random.default_rng(12).permuted(np.tile(np.arange(bins, dtype=np.int16), (bins, 1)), axis=1)
        _orders[bins] = np.ascontiguousarray(seen.T), np.argsort(seen, axis=1).astype(np.int16)
    return _orders[bins]


def bin_minima(texts: pa.Array, bins: int = BINS, k: int = SHINGLE) -> np.ndarray:
    """The least hash of the k-word shingles in each bin, a row for each text. A text of fewer words is one shingle,
    one without words none."""
    words = words_in(texts)
    h, first = word_hashes(words), words.first
    counts = np.diff(first)
    shift = np.uint64(64 - bins.bit_length() + 1)
    low = np.full(len(counts) * bins, _EMPTY)
    with np.errstate(over="ignore"):
        found = run_hashes(h, k) if len(h) >= k else h[:0]
        of = np.repeat(np.arange(len(counts)), counts)
        whole = of[: len(found)] == of[k - 1 :]  # shingles that end in the text where they begin
        found, of = found[whole], of[: len(found)][whole]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            found, of = np.append(found, run_hashes(h[first[i] : first[i + 1]], int(counts[i]))), np.append(of, i)
        found = mixed(found)
    np.minimum.at(low, of * bins + (found >> shift).astype(np.intp), found)
    return low.reshape(-1, bins)


def densify(low: np.ndarray) -> np.ndarray:
    """low with each empty bin of a row filled from the first bin in its order that is not empty, if there is one."""
    n, bins = low.shape
    order, place = _order(bins)
    full = low != _EMPTY
    counts = full.sum(1)
    for i in np.flatnonzero((counts > 0) & (counts <= FEW)):  # each would look at many bins: rather the first of those few
        have = np.flatnonzero(full[i])
        low[i] = low[i, np.where(full[i], np.arange(bins), have[place[:, have].argmin(1)])]
    row, bin_ = np.nonzero(~full & (counts > FEW)[:, None])
    flat, full = low.reshape(-1), full.reshape(-1)
    for looks in order:
        if not len(row):
            break
        other = row * bins + looks[bin_]
        hit = full[other]
        flat[(row * bins + bin_)[hit]] = flat[other[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return low


def pack(low: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Of each row the low-order bits of each bin, the first bin's in a byte's highest. The bin's number is mixed in
    before, so that bins that took over the same hash don't agree by chance together. No bytes where all are empty."""
    n, bins = low.shape
    with np.errstate(over="ignore"):
        x = mixed(low ^ (np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    x = (x & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(n, bins * bits // 8, 8 // bits)
    packed = np.bitwise_or.reduce(x << np.arange(8 - bits, -1, -bits, dtype=np.uint8), axis=2)
    return [row.tobytes() if some else b"" for row, some in zip(packed, low[:, 0] != _EMPTY, strict=True)]


def fingerprints_of(texts: pa.Array, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> list[bytes]:
    """The fingerprint of each text; a null counts as empty."""
    texts = texts.fill_null("")
    out = []
    for at in range(0, len(texts), ROWS):
        out += pack(densify(bin_minima(texts.slice(at, ROWS), bins, k)), bits)
    return out


def likeness(left: list[bytes], right: list[bytes], bits: int = BITS) -> np.ndarray:
    """The estimated Jaccard similarity of the sets of shingles of pairs of documents, free of the bias of agreement by
    chance. Two documents without shingles are alike, one without and one with some are not."""
    out = np.array([float(a == b) for a, b in zip(left, right, strict=True)])
    some = [i for i, (a, b) in enumerate(zip(left, right, strict=True)) if a and b]
    if some:
        differ = np.frombuffer(b"".join(left[i] for i in some), np.uint8) ^ np.frombuffer(b"".join(right[i] for i in some), np.uint8)
        differ = differ.reshape(len(some), -1)
        mask, chance = np.uint8((1 << bits) - 1), 0.5**bits
        unequal = sum(((differ >> np.uint8(s)) & mask != 0).sum(1) for s in range(0, 8, bits)) / (differ.shape[1] * 8 // bits)
        out[some] = np.clip((1 - unequal - chance) / (1 - chance), 0, 1)
    return out


@F.arrow_udf(T.BinaryType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text, packed; a null text counts as empty. Equal sets of shingles have equal ones."""
    return pa.array(fingerprints_of(texts), pa.binary())


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs: the packed bytes, empty where a text has no word.

    Shingles are five words [^\\x20\\x09-\\x0D]+, unchanged; a text of one to four words is one shingle. Null is the
    empty text. Repeated rows give repeated rows, an empty table none; other columns are ignored, whatever their names.
    Very long texts take time and memory in proportion to their words, in their own task alone.
    """
    return docs.select("doc_id", fingerprints(text_of()).alias("fingerprint"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _buckets(keys: pa.Array, borders: pa.Array) -> pa.Array:
    """The bucket of each key; where the key begins a bucket, also the one before, that of the last key for the first."""
    edges = np.asarray(borders[0].as_py() if len(borders) else [], np.int64)
    found = np.searchsorted(edges, np.asarray(keys, np.int64), "right") - 1
    begins = edges[found] == np.asarray(keys, np.int64) if len(edges) else []
    return pa.array([[b, (b - 1) % len(edges)] if s else [b] for b, s in zip(found.tolist(), begins, strict=True)], pa.list_(pa.int32()))


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows (doc_id, text, *columns), dealt out and sorted so that the next document of each follows it in its partition.

    The order is that of doc_id, a null one first, then of a hash of the text for rows that share an id; after the last
    comes the first. Partitions are ranges of ids between approximate quantiles, one for each shuffle partition. The
    row that begins a range is sent to the end of the range before as well (true in __tail). Whole texts move once.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    shares = F.array(*[F.lit(i / partitions) for i in range(partitions)])
    found = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, F.lit(max(10_000, 10 * partitions))).alias("q"), F.min("k").alias("low")).first()
    borders = sorted({*(found["q"] or []), found["low"]} - {None})
    rows = docs.select("doc_id", text_of().alias("text"), *[c.alias(n) for n, c in columns.items()], key.alias("__k"), F.xxhash64(text_of()).alias("__h"))
    edges = F.lit(borders).cast("array<long>") if borders else F.array().cast("array<long>")
    rows = rows.select("*", F.posexplode(_buckets("__k", edges)).alias("__copy", "__bucket"))
    rows = rows.withColumn("__tail", F.col("__copy") == 1).drop("__copy")
    return rows.repartitionById(max(1, len(borders)), F.col("__bucket")).sortWithinPartitions("__bucket", "__tail", "__k", "__h")


EDITED = pa.schema([("text", pa.string()), ("edited", pa.string()), ("n_chars", pa.int64()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by with_next(): each with its edited text. Holds one document, and the ids of its repeats."""
    ids, held = [], None
    for frame in frames:
        of = {name: frame.column(i) for i, name in enumerate(frame.schema.names)}
        out: list[tuple] = []
        for i in range(frame.num_rows):
            name = tuple(of[c][i].as_py() for c in ("__bucket", "__tail", "__k", "__h"))
            if held and name == held[0]:
                if ids:  # a tail has none
                    ids.append(of["doc_id"][i].as_py())
                continue
            text, own = of["text"][i].as_py(), of["fingerprint"][i].as_py()
            if ids and name[0] == held[0][0]:
                _, before, print_ = held
                cut = len(before) // 4
                out.append((ids, before, before[: len(before) - cut] + text[:cut], print_, own))
            held, ids = (name, text, own), [] if name[1] else [of["doc_id"][i].as_py()]  # a tail is only looked at
        if out:
            edited = pa.array([x[2] for x in out], pa.string())
            own, after = [x[3] for x in out], [x[4] for x in out]
            new = fingerprints_of(edited)
            columns = {
                "text": pa.array([x[1] for x in out], pa.string()), "edited": edited, "n_chars": pa.array([len(x[1]) for x in out], pa.int64()),
                "fingerprint": pa.array(own, pa.binary()), "edited_fingerprint": pa.array(new, pa.binary()), "near_edited": pa.array(likeness(own, new)), "near_next": pa.array(likeness(own, after)),
            }
            found = pa.RecordBatch.from_pydict(columns, EDITED).take(pa.array(np.repeat(np.arange(len(out)), [len(x[0]) for x in out])))
            yield pa.RecordBatch.from_arrays([pa.array([i for x in out for i in x[0]], of["doc_id"].type), *found.columns], names=["doc_id", *EDITED.names])


def edit_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, n_chars, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text is the text whose last quarter of code points, rounded down, is replaced by the first as many, or
    all, of the next document's. The next document is that with the next larger doc_id, after the last the first; a
    single document is its own next. A null doc_id comes first. Rows that share an id are in the order of a hash of
    their texts; of those that share the text too, all have the same next document, which is another one. Null is the
    empty text, whose edited text is empty. An empty table gives no rows; other columns are ignored.
    """
    rows = with_next(docs, {"fingerprint": fingerprints(text_of())})
    kinds = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType(), pa.float64(): T.DoubleType()}
    return rows.mapInArrow(_edit, T.StructType([rows.schema["doc_id"], *[T.StructField(f.name, kinds[f.type]) for f in EDITED]]))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = edit_documents(table(spark, sf_dir, "documents"))
    return edited.select(
        "doc_id", "n_chars", sha256_text(F.col("edited")).alias("edited_sha256"), F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
