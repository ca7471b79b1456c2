"""Near-duplicates among embeddings: all pairs by cosine, in tiles, leading principal components first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import batches, components, cut, table

#: Vectors of a tile, bytes of vectors of a group of tiles at most, and groups that smaller tables are cut into so that
#: there is work for all cores. Two groups meet in a task, one of them held as a whole; a vector is sent once for each group.
TILE, GROUP_BYTES, LEAST_GROUPS = 2048, 64 << 20, 8

#: Rows of a tile that are compared at a time: their bounds stay in a core's own cache.
ROWS = 128

#: Components of the first and second pass, and of a tile's box.
LEAD, MORE, BOX = 24, 48, 8

#: Groups whose boxes are broadcast, some 10 MB of numbers.
MOST_GROUPS = 1 << 16

#: Slack of the bounds, which are summed in single precision: 48 terms of at most 1 are off by less than 1e-5.
SLACK = 1e-5


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles, shorter ones filled with zeros."""
    length = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (length == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(length), width))
    out[np.arange(width)[None, :] < length[:, None]] = values
    return out


def _links(v: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; first by their largest component, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _basis(members: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the unit vectors v, by falling variance, from sums of outer products over all of them."""

    def sums(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((width, width)), False
        for frame in frames:
            for at in range(0, frame.num_rows, TILE):
                unit = _unit(_matrix(frame.column(0).slice(at, TILE), width))
                total += unit.T @ unit
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = members.select("v").mapInArrow(sums, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("row")).select("i", F.col("row.x"))
    total = np.zeros((width, width))
    for i, row in rows.collect():  # width rows of width numbers, whatever the number of vectors
        total[i] = row
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


class Tile:
    """Classes of a tile: identities, copies, vectors as they came, leading components and what is left of the norm."""

    def __init__(self, ids: bytes, copies: bytes, x: bytes, kind: str, width: int, basis: np.ndarray) -> None:
        self.ids, self.copies = np.frombuffer(ids, "V16"), np.frombuffer(copies, np.int64)
        self.x = np.frombuffer(x, kind).reshape(-1, width)
        z = _unit(self.x) @ basis
        self.low, self.high = z[:, :BOX].min(0), z[:, :BOX].max(0)
        rest = [np.sqrt(np.maximum(0, (z[:, k:] ** 2).sum(1, keepdims=True))) for k in (LEAD, MORE)]
        self.lead = np.hstack([z[:, :LEAD], rest[0]]).astype(np.float32)
        self.lead_t = np.ascontiguousarray(self.lead.T)
        self.more = np.hstack([z[:, LEAD:MORE], rest[1]]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.ids)


def _pair_links(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of two tiles, or of one with itself (each pair once)."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if (np.maximum(0, np.maximum(a.low - b.high, b.low - a.high)) ** 2).sum() > 2 - 2 * threshold + 1e-9:
        return found[0]  # unit vectors with cosine c are sqrt(2 - 2c) apart
    width = -(-len(b) // 8) * 8
    bound, over = np.empty((ROWS, len(b)), np.float32), np.zeros((ROWS, width), bool)
    for at in range(0, len(a), ROWS):
        n = min(ROWS, len(a) - at)
        # the last column adds the product of what is left of both norms, the most that the other components can give
        np.matmul(a.lead[at : at + n], b.lead_t, out=bound[:n])
        np.greater_equal(bound[:n], np.float32(threshold - SLACK), out=over[:n, : len(b)])
        eights = np.flatnonzero(over[:n].view(np.uint64).ravel() != 0)  # few pairs are left: look at eight at a time
        if not len(eights):
            continue
        which, k = np.nonzero(over[:n].reshape(-1, 8)[eights])
        i, j = np.divmod(eights[which] * 8 + k, width)
        i += at
        if a is b:
            on = i < j
            i, j = i[on], j[on]
        for k in range(0, len(i), 1 << 16):  # pairs that are left, with more components, then in full
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            so_far = np.einsum("ij,ij->i", a.lead[p, :LEAD], b.lead[q, :LEAD]) + np.einsum("ij,ij->i", a.more[p], b.more[q])
            on = so_far >= threshold - SLACK
            p, q = p[on], q[on]
            for n in range(0, len(p), 4096):
                u, v = p[n : n + 4096], q[n : n + 4096]
                linked = np.einsum("ij,ij->i", _unit(a.x[u]), _unit(b.x[v])) >= threshold
                found.append((u[linked], v[linked]))
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place connected to it by the pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        np.minimum.at(low, before, low.copy())
        low = low[low]
        if (low == before).all():
            return low


def _reach(tiles: DataFrame, n_groups: int, most: float) -> Column:
    """The groups that a tile (g, low, high) has to meet: its own, and those whose boxes are within the square root of
    most of its own box. With more than MOST_GROUPS, whose boxes would not be broadcast, all of them."""
    if n_groups > MOST_GROUPS:
        return F.sequence(F.lit(0), F.lit(n_groups - 1))
    places = range(min(BOX, len(tiles.select("low").first()[0])))
    ends = [F.min(F.get("low", F.lit(k))).alias(f"low{k}") for k in places] + [F.max(F.get("high", F.lit(k))).alias(f"high{k}") for k in places]
    rows = {r["g"]: r for r in tiles.groupBy("g").agg(*ends).collect()}  # at most MOST_GROUPS rows of 2 BOX numbers
    known = np.array(sorted(rows), np.int32)
    low, high = (np.array([[rows[g][f"{end}{k}"] for k in places] for g in known.tolist()]) for end in ("low", "high"))
    boxes = tiles.sparkSession.sparkContext.broadcast((known, low, high))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def near(g: pa.Array, tile_low: pa.Array, tile_high: pa.Array) -> pa.Array:
        groups, low, high = boxes.value
        out = []
        for own, a, b in zip(g.to_pylist(), tile_low.to_pylist(), tile_high.to_pylist(), strict=True):
            gap = np.maximum(0, np.maximum(low - np.array(b), np.array(a) - high))
            out.append(groups[((gap**2).sum(1) <= most) | (groups == own)].tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return near("g", "low", "high")


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors link when their cosine, in double precision, is at least the threshold (which must be above 0). Equal
    vectors, told by a 128-bit hash, are one class with a count, so that copies cost nothing. Classes are turned to
    principal components, ordered by cells of the leading ones and cut into tiles of TILE; consecutive tiles of
    GROUP_BYTES are a group. Two groups meet in one task, one held, the other read tile by tile; a tile is only sent to
    meet groups whose box around their leading components is near enough to its own. Tiles whose boxes are too far apart
    are passed over; of others LEAD components are summed, and pairs
    dropped whose remaining norms cannot make up the rest; what is left goes on with MORE, then with the vectors as
    they came. A comparison gives a count for each vector and a spanning forest of the links, never the pairs.

    Null and zero vectors and those with null or non-finite components link with nothing, not even with each other;
    a shorter vector counts as filled with zeros. n_links counts the other rows linked directly. Rows that
    repeat a vec_id have links and a component of their own where their vectors differ; a null vec_id links
    with nothing. component_id is the smallest vec_id reachable. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    number = "f4" if kind == "float" else "f8"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select("vec_id", v.alias("v"), _links(v).alias("ok"))
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    width = rows.where("ok").agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return rows.select("vec_id", *alone)
    # zeros at the end do not change a vector, and -0.0 equals 0.0
    zero = F.lit(0).cast(kind)
    filled = F.transform(F.concat("v", F.array_repeat(zero, F.lit(width) - F.size("v"))), lambda x: x + zero)
    members = rows.where("ok").select("vec_id", filled.alias("v"))
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(k), "v")), 16, "0") for k in range(3)]
    members = members.withColumn("h", F.unhex(F.substring(F.sha2(F.concat(*hashes).cast("binary"), 256), 1, 32)))
    basis = spark.sparkContext.broadcast(_basis(members, width))
    classes = members.groupBy("h").agg(F.count("*").alias("copies"), F.first("v").alias("v"))
    far = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def place(frame: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        z = _unit(_matrix(frame.column(2), width)) @ basis.value
        lead = np.clip(np.floor(z[:, :4] / far) + 8, 0, 15).astype(np.int64)
        lead = np.hstack([lead, np.zeros((len(lead), 4 - lead.shape[1]), np.int64)])
        key = ((lead[:, 0] * 16 + lead[:, 1]) * 16 + lead[:, 2]) * 16 + lead[:, 3]
        key = key.astype(np.float64) + (z[:, 0] - np.floor(z[:, 0] / far) * far) / (far * 1.0001)
        yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(key)], names=["h", "copies", "v", "key"])

    keyed = classes.mapInArrow(batches(place), f"h binary, copies long, v array<{kind}>, key double")
    ranged = keyed.repartitionByRange("key", "h").sortWithinPartitions("key", "h")

    def tiles(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, seq = TaskContext.get().partitionId(), 0

        def give(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            rows = rows.combine_chunks().to_batches()[0]
            x = _matrix(rows.column(2), width).astype(number)
            lead = _unit(x) @ basis.value[:, :BOX]
            values = [[part], [seq], [rows.num_rows], [b"".join(rows.column(0).to_pylist())], [rows.column(1).to_numpy().astype(np.int64).tobytes()], [x.tobytes()], [lead.min(0)], [lead.max(0)]]
            seq += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(values, [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())])],
                names=["part", "seq", "n", "ids", "copies", "x", "low", "high"],
            )

        for frame in frames:
            for at in range(0, frame.num_rows, TILE):
                held.append(frame.slice(at, TILE))
                if sum(f.num_rows for f in held) >= 2 * TILE:
                    rows = pa.Table.from_batches(held)
                    yield from give(rows.slice(0, TILE))
                    held = rows.slice(TILE).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            for at in range(0, rows.num_rows, TILE):
                yield from give(rows.slice(at, TILE))

    made = cut(ranged.mapInArrow(tiles, "part int, seq int, n int, ids binary, copies binary, x binary, low array<double>, high array<double>"), "tiles")
    # consecutive tiles become groups: a running sum over the partitions' sizes, a row for each partition of the table
    sizes = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.sum("n").alias("n")).collect())
    most = max(TILE, GROUP_BYTES // (width * np.dtype(number).itemsize))
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    cores = spark.sparkContext.defaultParallelism
    n_groups = max(1, -(-total // most), min(LEAST_GROUPS, int((4 * cores) ** 0.5), total // (2 * TILE)))
    per_group = -(-total // n_groups)
    starts = spark.createDataFrame(starts, "__part int, start long")
    before = F.col("start") + F.col("seq").cast("long") * TILE
    grouped = made.join(F.broadcast(starts), F.col("part") == F.col("__part")).withColumn("g", F.least(F.floor(before / per_group), F.lit(n_groups - 1)).cast("int"))
    # each tile goes to the tasks of its group's pairs: (i, j) with i <= j, its own rows held (side 0) where its group is i
    sent = grouped.select("*", F.explode(_reach(grouped, n_groups, 2 - 2 * threshold + 1e-9)).alias("other"))
    sent = sent.withColumns({"i": F.least("g", "other"), "j": F.greatest("g", "other"), "side": (F.col("g") > F.col("other")).cast("int")})
    tasks = n_groups * (n_groups + 1) // 2
    slot = F.col("i").cast("long") * n_groups - F.expr("cast(i as bigint) * (i - 1) div 2") + F.col("j") - F.col("i")
    n_parts = int(min(tasks, 1 << 16))
    sent = sent.withColumn("slot", (F.pmod(slot, F.lit(n_parts))).cast("int"))
    dealt = sent.select("i", "j", "side", "ids", "copies", "x", "slot").repartitionById(n_parts, "slot").drop("slot").sortWithinPartitions("i", "j", "side")

    def compare(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting = None, [], []
        axes = basis.value

        def meet(a: Tile, b: Tile) -> Iterator[pa.RecordBatch]:
            i, j = _pair_links(a, b, threshold)
            if not len(i):
                return
            ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
            copies = a.copies if a is b else np.concatenate([a.copies, b.copies])
            if a is not b:
                j = j + len(a)
            links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            low = _forest(i, j, len(ids))
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k].tobytes() for k in hit], pa.binary()), pa.array([ids[low[k]].tobytes() for k in hit], pa.binary()), pa.array(links[hit].astype(np.int64))], names=["h", "root", "links"])

        def merged(some: list[tuple]) -> Tile:
            return Tile(*(b"".join(parts) for parts in zip(*some)), number, width, axes)

        def rows_of(some: list[tuple]) -> int:
            return sum(len(ids) for ids, _, _ in some) // 16

        def flush(side: int, i: int, j: int) -> Iterator[pa.RecordBatch]:
            """The waiting tiles as one: held if of side 0, else compared with all that are held."""
            nonlocal waiting
            if waiting:
                tile = merged(waiting)
                waiting = []
                if side == 0 and i == j:
                    for other in held:
                        yield from meet(other, tile)
                    yield from meet(tile, tile)
                if side == 0:
                    held.append(tile)
                else:
                    for other in held:
                        yield from meet(other, tile)

        for frame in frames:
            for r in range(frame.num_rows):
                i, j, side, *data = (c[r].as_py() for c in frame.columns)
                if (i, j, side) != at:
                    if at:
                        yield from flush(at[2], *at[:2])
                        if (i, j) != at[:2]:
                            held.clear()
                    at = (i, j, side)
                waiting.append(tuple(data))
                if rows_of(waiting) >= TILE:
                    yield from flush(side, i, j)
        if at:
            yield from flush(at[2], *at[:2])

    found = cut(dealt.mapInArrow(compare, "h binary, root binary, links long"), "links")
    parts = components(found.select(F.col("h").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("h").agg(F.sum("links").alias("links")).select(F.col("h").alias("h2"), "links")
    sized = members.groupBy("h").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    named = sized.join(parts, F.col("h") == F.col("node"), "left").join(sums, F.col("h") == F.col("h2"), "left")
    named = cut(named.select("h", "first_id", F.coalesce("component", "h").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    heads = cut(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "heads")  # a plain table, so that a hot component can be split
    of_class = named.join(heads, "component").select(F.col("h").alias("h1"), "n_links", "component_id")
    linked = members.select("vec_id", "h").join(of_class, F.col("h") == F.col("h1")).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(rows.where("NOT ok").select("vec_id", *alone))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
