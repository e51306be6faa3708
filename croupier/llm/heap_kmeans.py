"""Centroid clustering (Lloyd rounds) with heap-ordered bounds.

Every vector lies in a block of at most ``BLOCK`` vectors, written once. A second, small table holds
the state of each block: the cluster of every vector and one heap per cluster. A heap entry is
``lower - upper + shift[c]``: the gap between the distances to the second nearest and to the own
centroid when the vector was last scanned, plus the drift that its cluster had accumulated by
then. In each round the centroids move; ``shift[c]`` grows by the drift of c and the largest drift of
another centroid. While the smallest entry of a heap exceeds ``shift[c]``, none of its vectors can
have changed cluster and they are not looked at; the others are popped, measured against all
centroids in whole numbers and pushed into the heap of their new cluster. Ties (gap 0) always expire.

A block also answers with the change of its cluster sums, caused only by vectors that moved.
Tasks add these up, Spark sums them, and ``clusters * (size + 1)`` numbers reach the driver.
Blocks and state are bucketed by block, so a round shuffles neither; state is written each round,
so a lost executor repeats its own blocks only.

Cases: vectors that are NULL, of another length, or with a NULL or non-finite component are left
out; so are vectors with a component beyond ``2**26 / 64`` (one million), whose squared distances would not
fit a long. NULL vec_ids count as empty text in the order of the first centroids; vectors with equal
vec_ids are ordered by their components and each keeps its own row. Fewer vectors than clusters:
as many clusters as vectors. An empty table gives no rows. Equal distances: the smaller number.
Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import bucketed, written

SCALE = 64
SIZE = 64
CLUSTERS = 16
ROUNDS = 3
BLOCK = 4096
_ROUNDING = 1e-12  # relative; far above what the few float operations on a bound can lose


def largest(size: int) -> int:
    """Largest component so that a squared distance of ``size`` components stays below 2**62."""
    return 1 << ((62 - size.bit_length()) // 2 - 1)


def quantised(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, each component as integer floor(64 * x)."""
    bound = float(largest(size))
    scaled = F.transform(F.col("embedding"), lambda x: F.lit(float(SCALE)) * x.cast("double"))
    fits = F.forall(scaled, lambda x: F.coalesce((x >= -bound) & (x <= bound), F.lit(False)))  # NaN is above every number
    return (vectors.filter((F.size("embedding") == size) & fits)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v")))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64)


def _blocks(kept: DataFrame, size: int, buckets: int, most: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                matrix = part.column("v").flatten().to_numpy().astype("<i4").reshape(-1, size)
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "ids": pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                                       "matrix": pa.array([matrix.tobytes()], pa.binary())})
                block += 1

    return bucketed(kept.mapInArrow(task, "block long, ids array<long>, matrix binary"), "kmeans_blocks", buckets)


def squared(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (vectors, centroids)."""
    out = np.empty((len(matrix), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        d = matrix - centroid
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


@dataclass
class State:
    """Clusters of the vectors of a block and, per cluster, a heap of (entry, place in the block)."""

    cluster: np.ndarray
    heaps: list[list[tuple[float, int]]]

    @classmethod
    def new(cls, n: int, clusters: int) -> State:
        return cls(np.full(n, -1, np.int32), [[] for _ in range(clusters)])

    @classmethod
    def load(cls, cluster: bytes, keys: bytes, places: bytes, sizes: bytes) -> State:
        pairs = list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(places, "<i4").tolist()))
        ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
        return cls(np.frombuffer(cluster, "<i4").copy(), [pairs[lo:hi] for lo, hi in zip([0, *ends], ends)])

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        pairs = [p for heap in self.heaps for p in heap]
        return (self.cluster.astype("<i4").tobytes(), np.array([k for k, _ in pairs], "<f8").tobytes(),
                np.array([i for _, i in pairs], "<i4").tobytes(), np.array([len(h) for h in self.heaps], "<i4").tobytes())

    def expired(self, shift: np.ndarray) -> list[int]:
        """Places whose gap no longer covers the drift of their cluster; they leave their heaps."""
        out = []
        for heap, now in zip(self.heaps, shift.tolist()):
            while heap and heap[0][0] <= now:
                out.append(heapq.heappop(heap)[1])
        return out

    def scan(self, places: list[int], matrix: np.ndarray, centroids: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Measure the vectors at ``places`` and push them again; the change of (sums, counts) per cluster."""
        change = np.zeros((len(centroids), matrix.shape[1] + 1), np.int64)
        if not places:
            return change
        at = np.array(sorted(places))
        far = squared(matrix[at], centroids)
        best = far.argmin(axis=1)  # the first of equal distances
        rows = np.arange(len(at))
        upper = np.sqrt(far[rows, best].astype(np.float64))
        far[rows, best] = np.iinfo(np.int64).max
        lower = np.sqrt(far.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(at), 1e300)
        entry = lower - upper + shift[best]
        entry -= _ROUNDING * (lower + upper + shift[best])
        for key, c, place in zip(entry.tolist(), best.tolist(), at.tolist()):
            heapq.heappush(self.heaps[c], (key, place))
        old, moved = self.cluster[at], self.cluster[at] != best
        with_one = np.concatenate((matrix[at[moved]], np.ones((int(moved.sum()), 1), np.int64)), axis=1)
        np.add.at(change, best[moved], with_one)
        known = old[moved] >= 0
        np.subtract.at(change, old[moved][known], with_one[known])
        self.cluster[at] = best
        return change


_STATE = "block long, cluster binary, keys binary, places binary, sizes binary, scanned long, change binary"


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, shift: np.ndarray, size: int, buckets: int) -> DataFrame:
    """The state after assigning every vector to its nearest centroid."""
    again = state is not None

    def step(own: pa.Table, before: State) -> pa.Table:
        matrix = np.frombuffer(own.column("matrix")[0].as_py(), "<i4").reshape(-1, size).astype(np.int64)
        places = before.expired(shift) if again else list(range(len(matrix)))
        change = before.scan(places, matrix, centroids, shift)
        cells = (own.column("block")[0].as_py(), *before.dump(), len(places), change.tobytes())
        return pa.table([pa.array([c]) for c in cells], names=["block", "cluster", "keys", "places", "sizes", "scanned", "change"])

    def first(own: pa.Table) -> pa.Table:
        return step(own, State.new(len(own.column("ids")[0]), len(centroids)))

    def later(own: pa.Table, kept: pa.Table) -> pa.Table:
        return step(own, State.load(*(kept.column(c)[0].as_py() for c in ("cluster", "keys", "places", "sizes"))))

    after = (blocks.groupBy("block").applyInArrow(first, _STATE) if state is None
             else blocks.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(later, _STATE))
    return bucketed(after, "kmeans_state", buckets)


def _summed(state: DataFrame, clusters: int, size: int) -> np.ndarray:
    """The change of (sums, counts) of all blocks, (clusters, size + 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(clusters * (size + 1), np.int64)
        for batch in batches:
            for change in batch.column("change"):
                total += np.frombuffer(change.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": at.astype(np.int32), "n": total[at]})

    out = np.zeros(clusters * (size + 1), np.int64)
    for r in state.select("change").mapInArrow(task, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(clusters, size + 1)


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much each cluster's gaps shrink: its own drift plus the largest drift of another centroid."""
    moved = np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + _ROUNDING)
    others = [np.delete(moved, c).max(initial=0.0) for c in range(len(moved))]
    return moved + np.array(others)


@dataclass
class Clustering:
    assigned: DataFrame  # vec_id, cluster, distance (squared)
    centroids: np.ndarray  # (clusters, size)
    scanned: list[int]  # vectors measured against all centroids, per assignment


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE,
            block: int = BLOCK) -> Clustering:
    """``rounds`` rounds of assigning and moving centroids to floor(sum / count), then one more assignment."""
    spark = vectors.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = quantised(vectors, size)
    centroids = first_centroids(kept, clusters)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, size), np.int64), [])
    blocks = _blocks(kept, size, buckets, block)
    k = len(centroids)
    totals, shift = np.zeros((k, size + 1), np.int64), np.zeros(k)
    state, scanned = None, []
    for turn in range(rounds + 1):
        state = _round(blocks, state, centroids, shift, size, buckets)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if turn < rounds:
            totals += _summed(state, k, size)
            filled = totals[:, -1] > 0
            moved = centroids.copy()
            moved[filled] = totals[filled, :-1] // totals[filled, -1:]  # rounds down, below 0 too
            shift = (shift + drifts(centroids, moved)) * (1 + _ROUNDING)
            centroids = moved

    def measured(own: pa.Table, kept: pa.Table) -> pa.Table:
        matrix = np.frombuffer(own.column("matrix")[0].as_py(), "<i4").reshape(-1, size).astype(np.int64)
        number = np.frombuffer(kept.column("cluster")[0].as_py(), "<i4")
        d = matrix - centroids[number]
        return pa.table({"vec_id": own.column("ids").combine_chunks().flatten(), "cluster": pa.array(number), "distance": np.einsum("ij,ij->i", d, d)})

    rows = blocks.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(measured, "vec_id long, cluster int, distance long")
    return Clustering(written(rows, "kmeans"), centroids, scanned)


def digests(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row per kept vector."""
    spark = vectors.sparkSession
    found = cluster(vectors, clusters, rounds)
    sums = {r["cluster"]: r["s"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    per = spark.createDataFrame([(c, s, sum(sums.values()), ",".join(map(str, found.centroids[c].tolist()))) for c, s in sums.items()],
                                "cluster int, cluster_inertia long, inertia long, listed string")
    per = per.select("cluster", "cluster_inertia", "inertia", F.sha2("listed", 256).alias("centroid_sha256"))
    return (found.assigned.join(F.broadcast(per), "cluster")  # at most ``clusters`` rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
