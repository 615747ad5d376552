"""Centroid clustering over blocks of vectors in the order of a Hilbert curve, with zone maps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import stored

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Vectors of a block, and bits of the curve for each component.
BLOCK_ROWS = 256
BITS = 4
#: Largest whole component: squared distances then fit into 64 bits. Below the second bound
#: sums of products are exact in doubles.
LARGEST = 1 << 27
EXACT_DOUBLE = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row of cell numbers on the Hilbert curve, as bytes that sort alike.

    The transposed form of the curve: exchange or invert the low bits of the first axis by the
    bits of each axis, from the highest bit down, then undo the excess of the Gray code.
    """
    x = np.ascontiguousarray(cells.T.astype(np.uint16))
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint16(1 << level), np.uint16((1 << level) - 1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint16)
            x[0] ^= np.where(on, low, swap).astype(np.uint16)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint16)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[n - 1] & np.uint16(1 << level), np.uint16((1 << level) - 1), np.uint16(0))
    x ^= flips
    levels = np.arange(bits - 1, -1, -1, dtype=np.uint16)
    in_order = (x[None, :, :] >> levels[:, None, None]) & np.uint16(1)
    packed = np.packbits(in_order.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def whole(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """floor(SCALE * x) of the vectors of a batch, as doubles that hold whole numbers."""
    values = batch.column(column)
    return np.floor(SCALE * np.asarray(values.flatten(), np.float64)).reshape(len(values), -1)


def _ranges(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and largest whole number of each component; None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = whole(batch, "embedding")
                low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
                high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["i", "low", "high"])

    got = (
        vectors.select("embedding").mapInArrow(run, "i bigint, low double, high double")
        .groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    )
    return (np.array([r["low"] for r in got]), np.array([r["high"] for r in got])) if got else None


def _kind(low: np.ndarray, high: np.ndarray) -> str:
    """Smallest whole-number type that holds all components."""
    largest = max(-low.min(), high.max())
    if largest > LARGEST:
        raise ValueError(f"a component over {LARGEST // SCALE} makes squared distances pass 64 bits")
    return "i1" if largest < 1 << 7 else "i2" if largest < 1 << 15 else "i4"


def zone_maps(vectors: DataFrame, low: np.ndarray, high: np.ndarray, kind: str) -> DataFrame:
    """(block, vec_id, v, box): the vectors along the curve, in blocks of BLOCK_ROWS.

    The first row of a block carries its box, the least and largest value of each component.
    Rows are dealt by ranges of (place on the curve, hash of vec_id, salt), so that equal
    vectors and equal ids spread over tasks like others. The table is stored; each round
    reads it.
    """
    step = np.where(high > low, high - low + 1, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = whole(batch, "embedding")
                keys = hilbert_keys(((v - low) * (1 << BITS) // step).astype(np.uint16))
                rows = v.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(keys, pa.binary())],
                    ["vec_id", "v", "place"],
                )

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal first
            v = np.frombuffer(b"".join(rows["v"].to_pylist()), kind).reshape(len(rows), -1)
            box = np.stack([v.min(axis=0), v.max(axis=0)]).tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), first)), rows["vec_id"].combine_chunks(), rows["v"].combine_chunks(),
                    pa.array([box] + [None] * (len(rows) - 1), pa.binary()),
                ],
                ["block", "vec_id", "v", "box"],
            )
            first += 1
            return out

        waiting: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch.select(["vec_id", "v"])])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            while len(waiting) >= BLOCK_ROWS:
                yield block(waiting.slice(0, BLOCK_ROWS))
                waiting = waiting.slice(BLOCK_ROWS)
        if waiting is not None and len(waiting):
            yield block(waiting)

    salt = F.hash("vec_id", F.monotonically_increasing_id())
    placed = vectors.select("vec_id", "embedding").mapInArrow(keyed, "vec_id bigint, v binary, place binary")
    ordered = placed.withColumn("salt", salt).repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return stored(ordered.drop("salt").mapInArrow(boxed, "block bigint, vec_id bigint, v binary, box binary"))


class Nearest:
    """Nearest centroid of the vectors of a block, by the block's candidates only."""

    def __init__(self, centroids: np.ndarray, largest: int):
        self.centroids = centroids
        self.kind = np.float64 if largest < EXACT_DOUBLE else np.int64
        self.c = centroids.astype(self.kind)
        self.norms = (self.c * self.c).sum(axis=1)

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Centroids that may be nearest to a vector of the box, in ascending order.

        One whose least distance to the box is above another's largest is nearest to none; at
        an equal distance it stays.
        """
        c, low, high = self.c, low.astype(self.kind), high.astype(self.kind)
        near = np.maximum(np.maximum(low - c, c - high), 0)
        far = np.maximum(np.abs(c - low), np.abs(c - high))
        return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())

    def of(self, v: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector; ties go to the smaller number."""
        some = self.candidates(*box)
        v = v.astype(self.kind)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ self.c[some].T) + self.norms[some]
        best = d.argmin(axis=1)
        return some[best], d[np.arange(len(v)), best].astype(np.int64)


def _blocks(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, vectors, box) of each block of a batch; a block cut by a batch gets a box of its part."""
    if not batch.num_rows:
        return
    v = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(batch.num_rows, -1)
    ids, boxes = batch.column("block").to_numpy(), batch.column("box")
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    for a, b in zip(cuts, cuts[1:]):
        box = boxes[a].as_py()
        rows = v[a:b]
        yield slice(a, b), rows, np.stack([rows.min(axis=0), rows.max(axis=0)]) if box is None else np.frombuffer(box, kind).reshape(2, -1)


def _sums(blocks: DataFrame, nearest: Nearest, kind: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(count, component sums, inertia) of each cluster, added up in the tasks first."""
    k, size = nearest.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # components, then the count, then the inertia
        total = np.zeros((k, size + 2), np.int64)
        for batch in batches:
            for _, v, box in _blocks(batch, kind):
                cluster, distance = nearest.of(v, box)
                for c in np.unique(cluster):
                    mine = cluster == c
                    total[c, :size] += v[mine].sum(axis=0, dtype=np.int64)
                    total[c, size:] += (mine.sum(), distance[mine].sum())
        at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(total.ravel())], ["c", "i", "x"])

    out = np.zeros((k, size + 2), object)
    rows = (
        blocks.mapInArrow(run, "c bigint, i bigint, x bigint").groupBy("c", "i")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    )
    for r in rows:
        out[r["c"], r["i"]] = int(r["x"])
    return out[:, size], out[:, :size], out[:, size + 1].tolist()


def centroid_clusters(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE
) -> DataFrame:
    """Per usable vector of ``embeddings`` (vec_id, embedding): cluster, distance and sums of it.

    Usable are vectors of ``size`` components, none null or not finite; x stands for
    floor(64 x). The vectors whose ``seed:vec_id`` has the smallest SHA-256 start as centroids;
    each round assigns all vectors to the nearest centroid (squared distance, ties to the
    smaller number) and moves each centroid that has vectors to floor(sum / count). Then all
    are assigned once more. All arithmetic is in whole numbers.

    One shuffle lays the vectors along the curve; each round is one pass over the stored blocks
    that returns (clusters x components) sums. A block compares its vectors with the centroids
    its box cannot rule out.

    Fewer vectors than clusters: that many clusters. A null vec_id seeds after all others, and
    repeated ids seed by their vectors; both are clustered row by row. Other columns are
    ignored. No usable vector, no rows. A component over 2^21 is an error, as distances would
    not fit into 64 bits.
    """
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) == size) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")).filter(F.coalesce(fine, F.lit(False)))
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    found = _ranges(vectors)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    kind = _kind(*found)
    largest = int(max(-found[0].min(), found[1].max()))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("h", digest).orderBy(F.asc_nulls_last("h"), "embedding").limit(clusters).collect()
    centroids = np.floor(SCALE * np.array([r["embedding"] for r in first])).astype(np.int64)
    blocks = zone_maps(vectors, *found, kind)
    for _ in range(rounds):
        counts, sums, _ = _sums(blocks, Nearest(centroids, largest), kind)
        moved = [[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids, strict=True)]
        centroids = np.array(moved, np.int64)
    nearest = Nearest(centroids, largest)
    inertia = _sums(blocks, nearest, kind)[2]
    if sum(inertia) >= 1 << 63:
        raise ValueError("the sum of squared distances passes 64 bits")
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each, total = np.array(inertia, np.int64), sum(inertia)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, v, box in _blocks(batch, kind):
                cluster[rows], distance[rows] = nearest.of(v, box)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(each[cluster]),
                    pa.array(np.full(len(cluster), total)), pa.array([shas[c] for c in cluster], pa.string()),
                ],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.mapInArrow(assigned, schema)
