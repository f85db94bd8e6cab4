"""Centroid clustering with Hamerly bounds, exact in integers.

A component x becomes floor(1024 * x).  Vectors are packed in blocks, written once, dealt
by block.  Beside each block lies its state: for every vector the cluster, one upper bound
on the distance to its centroid and one lower bound on the distance to the second nearest,
and for every cluster the sum of its vectors.  A round joins blocks with their states (both
dealt by block, so nothing is shuffled), loosens the bounds by how far centroids drifted,
and leaves a vector alone where its upper bound is below the lower one or below half the
distance from its centroid to the next.  Where that fails with the upper bound made
exact too, the vector is compared with all centroids in integers.  Bounds are floats that are always
rounded outwards and are compared strictly, so a pruned vector cannot tie.  Only sums of
clusters, a fixed number of values a block, are aggregated; the state of a round replaces
the one before.

Cases: vectors that are null, not of ``dim`` components, or hold null or non-finite ones
are left out; ties go to the smaller cluster; rows of one id count as a vector each; a
null id comes last among the starting centroids; with fewer vectors than ``k`` there are as many centroids as
vectors; an empty cluster keeps its centroid; an empty table gives no rows; further
columns are ignored.  A scaled component of 2^27 or more in size (131,072 unscaled) would leave 64 bits and raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch, arrow_rows

BLOCK = 2048
LIMIT = 1 << 27
OUT = "vec_id long, cluster int, distance long"
STATE = "block long, cluster binary, upper binary, lower binary, sums array<long>"
#: relative room for the rounding of distances and of sums of drifts
ROOM = 1e-11


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    v = np.floor(x * scale)
    if (np.abs(v) >= LIMIT).any():
        raise ValueError(f"components of {LIMIT} or more after scaling do not fit exact 64-bit distances")
    return v.astype(np.int64)


def _usable(col: F.Column, dim: int) -> F.Column:
    return (F.size(col) == dim) & F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """Blocks of up to ``BLOCK`` vectors: ids and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), scale)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()])], ["ids", "data"])

    return vectors.mapInArrow(run, "ids array<long>, data binary").withColumn("block", F.monotonically_increasing_id())


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, (vectors, centroids)."""
    return np.stack([((x - k) ** 2).sum(1) for k in c], 1)


def _up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + ROOM)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - ROOM)


def _scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties to the smaller), distance to it from above, to the second from below."""
    d = _distances(x, c)
    label = d.argmin(1)
    mine = np.take_along_axis(d, label[:, None], 1)[:, 0]
    if len(c) == 1:
        return label, _up(mine), np.full(len(x), np.inf)
    np.put_along_axis(d, label[:, None], np.iinfo(np.int64).max, 1)
    return label, _up(mine), _down(d.min(1))


class Step:
    """What a round needs to know of the centroids before and after they moved."""

    def __init__(self, before: np.ndarray | None, now: np.ndarray):
        self.now = now
        k = len(now)
        between = np.stack([((now - c) ** 2).sum(1) for c in now], 1).astype(np.float64)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - ROOM)
        self.drift = _up(((now - before) ** 2).sum(1)) if before is not None else np.zeros(k)
        # a bound on the second nearest loosens by the largest drift among the others
        self.others = np.array([np.delete(self.drift, i).max(initial=0.0) for i in range(k)])

    def assign(self, x: np.ndarray, label: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New labels and bounds, and how many vectors were scanned."""
        if label is None:
            return *_scan(x, self.now), len(x)
        label = label.copy()
        upper = (upper + self.drift[label]) * (1 + ROOM)
        lower = (lower - self.others[label]) * (1 - ROOM) - ROOM
        safe = np.maximum(lower, self.half[label])
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = _up(((x[open_] - self.now[label[open_]]) ** 2).sum(1))
        open_ = open_[upper[open_] >= safe[open_]]
        if len(open_):
            label[open_], upper[open_], lower[open_] = _scan(x[open_], self.now)
        return label, upper, lower, len(open_)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(n, -1)


def _cells(row: dict) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    if row.get("cluster") is None:
        return None, np.zeros(0), np.zeros(0)
    return np.frombuffer(row["cluster"], "<i4").astype(np.int64), np.frombuffer(row["upper"]), np.frombuffer(row["lower"])


def _round(blocks: DataFrame, state: DataFrame | None, step: Step) -> DataFrame:
    """The state after an assignment; ``sums`` holds by cluster the count, then the sums, then the number of scans."""
    k = len(step.now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for row in b.to_pylist():
                x = _unpack(row["data"], len(row["ids"]))
                label, upper, lower, scans = step.assign(x, *_cells(row))
                sums = np.zeros((k, 1 + x.shape[1]), np.int64)
                np.add.at(sums, label, np.concatenate((np.ones((len(x), 1), np.int64), x), 1))
                for column, v in zip(out, (row["block"], label.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), [*sums.ravel().tolist(), scans]), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["block", "cluster", "upper", "lower", "sums"])

    joined = blocks if state is None else blocks.join(state.drop("sums"), "block")
    return joined.mapInArrow(run, STATE)


def _final(blocks: DataFrame, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = _unpack(row["data"], len(row["ids"]))
                label = np.frombuffer(row["cluster"], "<i4")
                d = ((x - centroids[label]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(label), pa.array(d)], ["vec_id", "cluster", "distance"])

    return blocks.join(state.select("block", "cluster"), "block").mapInArrow(run, OUT)


def _totals(state: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Exact counts and sums by cluster, as Python integers; a value a cluster and component reaches the driver."""
    found = state.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    flat = np.zeros(len(found), object)
    for r in found:
        flat[r["at"]] = int(r.v)
    return flat[:-1].reshape(k, -1), flat[-1]


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, work: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    ``work``, if given, receives the number of vectors that each assignment compared with all centroids.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_usable(F.col("embedding"), dim))
    start = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding").orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).collect()
    empty = spark.createDataFrame([], f"{OUT}, cluster_inertia long, inertia long, centroid_sha256 string")
    if not start:
        return empty
    now = np.stack([_scaled(np.array(r.embedding), scale) for r in start])
    with arrow_rows(spark, BLOCK):  # numbered once written, so that a block keeps its number; then dealt by it
        numbered = scratch.table(_packed(kept, scale), "packed")
    with arrow_rows(spark, 4):
        blocks = scratch.bucketed(numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block"), "blocks", "block")
        before, state = None, None
        for r in range(rounds + 1):
            new = scratch.bucketed(_round(blocks, state, Step(before, now)), f"state{r}", "block")
            if state is not None:
                scratch.forget(old)
            state, old = new, scratch.tables[-1]
            totals, scans = _totals(state, len(now))
            if work is not None:
                work.append(int(scans))
            if r < rounds:
                before, now = now, np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else list(c) for t, c in zip(totals, now, strict=True)], np.int64)
        done = scratch.table(_final(blocks, state, now), "assigned")
    inertia = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(now)]
    return done.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
