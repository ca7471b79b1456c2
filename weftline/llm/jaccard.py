"""N-gram Jaccard join: a MinHash LSH forest over word shingles, then exact verification.

Each tree of the forest is a prefix trie of signatures, held as a table sorted by tree and signature: a node of depth d
is a run of documents that share their first d hashes. Matching begins with the longest prefixes and shortens them by
one hash at a time. After each length the pairs found so far, by bands of similarity, say how many pairs are still to
be expected, band by band, so that a large group of close copies says nothing about pairs at the threshold; matching
ends as soon as every band has the target recall. Each pair is verified once, at the first length and in the first
tree in which it meets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import components, cut, row_key, small, table, text_of
from .substrings import Hashes, run_hashes, words_of

#: Words of a shingle and least similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8

#: Trees, hashes of a signature, and the recall to reach in each band of similarity.
TREES, DEPTH, RECALL = 20, 7, 0.9999

#: Width of a band of similarity, and the number of pairs of a band that may be expected lost before the target recall.
BAND, LOSS = 0.02, 0.02

#: Shingles and documents of a block; a node's blocks are compared two at a time.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 1024

#: Cells of a matrix block in the comparison.
CELLS = 4 << 20

_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def found_with(similarity: np.ndarray | float, length: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that two documents of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def band_edges(threshold: float) -> np.ndarray:
    """The least similarity of each band from the threshold to 1."""
    return np.arange(threshold, 1 + 1e-9, BAND)


def is_settled(found: np.ndarray, length: int, threshold: float, recall: float = RECALL) -> bool:
    """Whether matching may end after prefixes of this length, given the pairs found in each band.

    At the lower edge of its band a pair is found with probability p, so (found + 1) (1 - p) / p pairs of the band are
    expected to be lost, one unseen pair allowed for. A band is done with at p >= recall, or with fewer than LOSS.
    """
    p = found_with(band_edges(threshold), length)
    return bool(((p >= recall) | ((found + 1) * (1 - p) / p < LOSS)).all())


def last_length(threshold: float, recall: float = RECALL) -> int:
    """The length at which matching ends at the latest."""
    return next((d for d in range(DEPTH, 1, -1) if found_with(threshold, d) >= recall), 1)


def shingles(text: str, hashes: Hashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        return np.unique(run_hashes(h, min(k, len(words))))


def class_key(found: np.ndarray) -> bytes:
    """Names a set of shingles."""
    return xxhash.xxh3_128_digest(found.tobytes())


def signature(found: np.ndarray) -> np.ndarray:
    """(trees x depth) 16-bit minhashes of a set of shingles."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (_A[:, None] * x[None, at : at + 1024] + _B[:, None]).min(1))
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype(">u2").reshape(TREES, DEPTH)


def _sign(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for frame in frames:
        for at in range(0, frame.num_rows, 1000):
            part = frame.slice(at, 1000)
            n, ck, sig = [], [], []
            with np.errstate(over="ignore"):
                for text in part.column(1):
                    found = shingles(text.as_py() or "", hashes)
                    n.append(len(found))
                    ck.append(class_key(found) if len(found) else None)
                    sig.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(ck, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "ck", "sig"])


def _sets(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for frame in frames:
        for at in range(0, frame.num_rows, 500):
            found = [shingles(t.as_py() or "", hashes) for t in frame.column(0).slice(at, 500)]
            found = [x for x in found if len(x)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([class_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["ck", "sh"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, from products of 0/1 matrices in column blocks."""
    sizes = np.array([len(x) for x in [*a, *b]])
    values, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1  # a shingle of one set is in no intersection
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, width = int(often.sum()), max(1, CELLS // len(sizes))
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, n, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sizes), min(width, n - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.round().astype(np.int64)


LINKS = "ck binary, root binary, links long, band int, pairs long"


def _verify(threshold: Fraction, length: int, first: bool):
    """Of rows (node, tree, i, j, b, ck, copies, sig, sh), those of a block pair together: rows LINKS.

    (ck, root, links) is a class, a class that it is connected to, and the rows it links to; (band, pairs) counts the
    linked pairs of classes in a band of similarity.
    """
    edges = band_edges(float(threshold))

    def prefixes(rows: list[tuple], d: int) -> np.ndarray:
        """Names of the trie nodes of depth d that the rows are in, a column for each tree."""
        sig = np.frombuffer(b"".join(r[3] for r in rows), ">u2").reshape(len(rows), TREES, DEPTH).astype(np.uint64)
        out = np.zeros((len(rows), TREES), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(d):
                out = (out ^ sig[:, :, k] ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def compare(tree: int, i: int, j: int, rows: list[tuple]) -> pa.RecordBatch | None:
        left = [r for r in rows if r[0] == i]
        right = [r for r in rows if r[0] == j] if i != j else left
        if not left or not right or i == j and len(left) < 2:
            return None
        # a pair is compared where it meets first: at the longest prefix, in the first of the trees
        fresh = np.ones((len(left), len(right)), bool)
        if i == j:
            fresh &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        for d, trees in ((length, tree), (length + 1, 0 if first else TREES)):
            if trees:
                a, b = prefixes(left, d), prefixes(right, d)
                for t in range(trees):
                    fresh &= a[:, t][:, None] != b[:, t][None, :]
        rows_on, columns_on = np.flatnonzero(fresh.any(1)), np.flatnonzero(fresh.any(0))
        if not len(rows_on):
            return None
        a, b = [left[k] for k in rows_on], [right[k] for k in columns_on]
        sets = [[np.frombuffer(r[4], np.uint64) for r in x] for x in (a, b)]
        both = overlaps(*sets)
        union = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]])[None, :] - both
        linked = fresh[np.ix_(rows_on, columns_on)] & (both * threshold.denominator >= union * threshold.numerator)
        p, q = np.nonzero(linked)
        if not len(p):
            return None
        names = sorted({r[1] for r in a} | {r[1] for r in b})
        place = {x: k for k, x in enumerate(names)}
        pa_, qa_ = np.array([place[r[1]] for r in a])[p], np.array([place[r[1]] for r in b])[q]
        copies_a, copies_b = np.array([r[2] for r in a]), np.array([r[2] for r in b])
        links = np.bincount(pa_, copies_b[q], len(names)) + np.bincount(qa_, copies_a[p], len(names))
        low = _lowest(pa_, qa_, len(names))
        hit = np.flatnonzero(links)
        band = np.clip(np.searchsorted(edges, both[p, q] / union[p, q] + 1e-12, side="right") - 1, 0, len(edges) - 1)
        bands, pairs = np.unique(band, return_counts=True)
        none = [None] * len(bands)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(names[k] for k in hit), *none], pa.binary()), pa.array([*(names[low[k]] for k in hit), *none], pa.binary()),
                pa.array([*links[hit].astype(np.int64).tolist(), *none], pa.int64()),
                pa.array([*[None] * len(hit), *bands.tolist()], pa.int32()), pa.array([*[None] * len(hit), *pairs.tolist()], pa.int64()),
            ],
            names=["ck", "root", "links", "band", "pairs"],
        )

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for frame in frames:
            for start in range(0, frame.num_rows, 256):  # one block pair is held at a time, not the frame's sets
                for node, tree, i, j, *row in zip(*(c.to_pylist() for c in frame.slice(start, 256).columns)):
                    if (node, tree, i, j) != at:
                        if len(rows) > 1 and (out := compare(*at[1:], rows)) is not None:
                            yield out
                        at, rows = (node, tree, i, j), []
                    rows.append(tuple(row))
        if len(rows) > 1 and (out := compare(*at[1:], rows)) is not None:
            yield out

    return run


def _lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place connected to it by the pairs (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        np.minimum.at(low, before, low.copy())
        low = low[low]
        if (low == before).all():
            return low


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for each row of docs (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of five-word shingles is at least the threshold.
    Words are [^\\x20\\x09-\\x0D]+, unchanged; a text of fewer words is one shingle. Documents with equal sets are one
    class that is joined once, whatever its size. class_id is the smallest doc_id that links reach, n_links the
    number of other rows linked directly, kept whether doc_id = class_id.

    Only classes that share a trie node with another reach the verification, and their sets of hashes travel to the
    nodes; nodes with equal members are compared once, large ones in pairs of blocks of bounded size, by matrix
    products that emit counts and a spanning forest instead of pairs.

    Empty and null texts link with nothing, not even with each other; rows with a null doc_id neither (class_id is
    null, kept true). Rows that repeat a doc_id with an equal text link to each other. An empty table gives no rows;
    other columns are ignored.
    """
    return _near_classes(docs, threshold, recall).select("doc_id", "class_id", "n_links", "kept")


def _matched(forest: DataFrame, sets: DataFrame, seen: DataFrame | None, exact: Fraction, length: int, first: bool) -> tuple[DataFrame, DataFrame | None]:
    """Nodes at this length that no longer one had the members of, and what _verify() says of their pairs."""
    spark = forest.sparkSession
    member = forest.select("ck", "n", "tree", F.substring("sig", 1, 2 * length).alias("node"))
    print_of = [F.bit_xor(F.xxhash64("ck")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "ck")).alias("f2"), F.count("*").alias("c")]
    node = member.groupBy("tree", "node").agg(*print_of, F.sum("n").alias("w")).where("c > 1")
    node = node.groupBy("f1", "f2", "c").agg(F.min(F.struct("tree", "node")).alias("at"), F.first("w").alias("w"))
    if seen is not None:
        node = node.join(seen, ["f1", "f2", "c"], "left_anti")
    node = cut(node, "nodes")
    if node.isEmpty():
        return node, None
    blocks = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_DOCS)).cast("int")
    node_blocks = node.select(F.col("at.tree").alias("tree"), F.col("at.node").alias("node"), blocks.alias("blocks"))
    work = member.join(node_blocks, ["tree", "node"]).withColumn("b", F.pmod(F.xxhash64(F.lit(2), "ck"), F.col("blocks")).cast("int"))
    work = work.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumns({"i": F.least("b", "x"), "j": F.greatest("b", "x")})
    # the block pairs of a node go to partitions one after the other, from a place by its hash
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nth = F.col("i").cast("long") * F.col("blocks") - F.expr("cast(i as bigint) * (i - 1) div 2") + F.col("j") - F.col("i")
    slot = F.pmod(F.xxhash64("tree", "node") + nth, F.lit(tasks)).cast("int")
    work = work.select(F.col("ck").alias("ck2"), "node", "tree", "i", "j", "b", slot.alias("slot"))
    joined = work.join(sets, F.col("ck2") == F.col("ck")).select("node", "tree", "i", "j", "b", "ck", "copies", "sig", "sh", "slot")
    dealt = joined.repartitionById(tasks, "slot").drop("slot").sortWithinPartitions("node", "tree", "i", "j")
    return node, cut(dealt.mapInArrow(_verify(exact, length, first), LINKS), "links")


def _near_classes(docs: DataFrame, threshold: float, recall: float = RECALL, least: int = 1) -> DataFrame:
    """The columns of near_copies, ck, the class key of the row's text, and part, the ck that names its component.

    least: the length at which matching ends at the latest, for tests of single lengths.
    """
    exact = Fraction(str(threshold))
    last = max(least, last_length(threshold, recall))
    new = [T.StructField("n", T.IntegerType()), T.StructField("ck", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *new])
    signed = cut(docs.select("doc_id", text_of().alias("text")).mapInArrow(_sign, schema), "signed")
    classes = signed.where("ck is not null and doc_id is not null").groupBy("ck")
    classes = cut(classes.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    # classes that share a node with another, however short prefixes may get
    trees = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH))))
    nodes = classes.select("ck", trees.alias("tree", "sig")).select("ck", F.xxhash64("tree", F.substring("sig", 1, 2 * last)).alias("node"))
    shared = nodes.groupBy("node").count().where("count > 1").select("node")
    met = cut(nodes.join(shared, "node", "left_semi").select("ck").distinct(), "met")
    survivors = cut(classes.join(met, "ck", "left_semi"), "survivors")

    rows = docs.select("doc_id", text_of().alias("text"))
    ids = small(survivors.select(F.col("first_id").alias("__id")))
    chosen = rows.join(ids, F.col("doc_id") == F.col("__id"), "left_semi").select("text")
    sets = chosen.mapInArrow(_sets, "ck binary, sh binary")
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        sets = sets.dropDuplicates(["ck"])
    packed = survivors.select(F.col("ck").alias("ck2"), "copies", "sig")
    sets = cut(sets.join(packed, F.col("ck") == F.col("ck2")).drop("ck2"), "sets")

    # the forest: a trie for each tree, as a table sorted by signature
    forest = survivors.select("ck", "n", trees.alias("tree", "sig"))
    forest = cut(forest.repartitionByRange("tree", "sig").sortWithinPartitions("tree", "sig"), "forest")
    links, seen = None, None
    pairs = np.zeros(len(band_edges(threshold)), np.int64)
    for length in range(DEPTH, last - 1, -1):
        matched, found = _matched(forest, sets, seen, exact, length, length == DEPTH)
        seen = matched.select("f1", "f2", "c") if seen is None else seen.unionByName(matched.select("f1", "f2", "c"))
        if found is not None:
            for r in found.where("ck is null").groupBy("band").agg(F.sum("pairs").alias("pairs")).collect():  # a row for each band
                pairs[r["band"]] += r["pairs"]
            found = found.where("ck is not null").select("ck", "root", "links")
            links = found if links is None else links.unionByName(found)
        if is_settled(pairs, length, threshold, recall):
            break
    every = signed.select("doc_id", "ck")
    of_class = classes.select("ck", "first_id", "copies")
    if links is not None:
        parts = components(links.select(F.col("ck").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "ck2")
        sums = links.groupBy("ck").agg(F.sum("links").alias("links")).withColumnRenamed("ck", "ck3")
        of_class = of_class.join(parts, F.col("ck") == F.col("ck2"), "left").join(sums, F.col("ck") == F.col("ck3"), "left")
        of_class = cut(of_class.select("ck", "first_id", F.coalesce("component", "ck").alias("part"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "parts")
        heads = cut(of_class.groupBy("part").agg(F.min("first_id").alias("class_id")), "heads")
        of_class = of_class.join(heads, "part").select(F.col("ck").alias("__ck"), "part", "class_id", "n_links")
    else:
        of_class = of_class.select(F.col("ck").alias("__ck"), F.col("ck").alias("part"), F.col("first_id").alias("class_id"), (F.col("copies") - 1).alias("n_links"))
    joined = every.join(of_class, (F.col("ck") == F.col("__ck")) & F.col("doc_id").isNotNull(), "left")
    head = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", "ck", "part", head.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(head).alias("kept"))


def _with_key(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for frame in frames:
        sets = (shingles(t.as_py() or "", hashes) for t in frame.column(frame.schema.get_field_index("text")))
        keys = [class_key(found) if len(found) else None for found in sets]
        yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(keys, pa.binary())], names=[*frame.schema.names, "__key"])


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of linked ones, that with the smallest doc_id; all columns kept.

    Where ids repeat, each text stays or goes with its own group, and of rows with the smallest doc_id of a group that
    with the smallest hash of all its columns stays, of fully identical rows one. Rows that link with nothing (empty
    and null texts, null ids) all stay. Columns that start with two underscores are reserved.
    """
    found = cut(_near_classes(docs, threshold), "near")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        gone = found.where("NOT kept").select(F.col("doc_id").alias("__id"))
        return docs.join(small(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    of = found.where("part is not null").select(F.col("doc_id").alias("__id"), F.col("ck").alias("__ck"), F.col("part").alias("__part"), F.col("kept").alias("__kept")).distinct()
    keyed = docs.withColumn("__row", row_key(docs))
    keyed = keyed.mapInArrow(_with_key, T.StructType([*keyed.schema, T.StructField("__key", T.BinaryType())]))
    keyed = cut(keyed.join(of, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__ck")), "left"), "keyed")
    heads = keyed.where("__kept").groupBy("__part").agg(F.min(F.struct("doc_id", "__row")).alias("__first"))
    heads = heads.select(F.col("__part").alias("__p"), F.col("__first.__row").alias("__r"))
    kept = keyed.where("__kept").join(heads, (F.col("__part") == F.col("__p")) & (F.col("__row") == F.col("__r")), "left_semi").dropDuplicates(["__part"])
    return keyed.where("__part is null").unionByName(kept).select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
