"""Approximate nearest neighbours by learned partitions.

A bounded sample (``sample_rows`` rows, those of the smallest hash of their id) is
collected to learn from: its neighbour graph is cut into balanced parts (balanced
k-means, then moves that shorten the cut), and a small two-layer network learns, for each
vector, the distribution of its neighbours over the parts.  Every row is put into its
most probable part.  A query goes to the parts that are most probable for it, as many as
the sample needs for ``target_recall``; distances there are computed exactly.

Equal vectors are one entry that carries its smallest ids, so a vector that a third of
all rows hold is one entry; parts are searched in blocks of bounded size, each by a task
of its own for a bounded lot of the part's queries, and the best of each are merged by
query.  Tables a search is done with are removed; its result stays in the shared folder.

Cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components, and rows without an id, take no part; an id with several vectors asks
with the smallest of them; rows with the query's id are
never its candidates; ties go to the smaller id; with fewer than ``k`` candidates all are
returned; a query whose parts hold too few is searched against all parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch, small_batches


def neighbour_graph(x: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Indices of the k nearest rows of each row."""
    sq = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), chunk):
        d = sq[None, :] - 2 * x[a : a + chunk] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + chunk] = np.argpartition(d, k, axis=1)[:, :k]
    return out


def _assign(cost: np.ndarray, room: int) -> np.ndarray:
    """Each row to the cheapest part that has room, surest rows first."""
    order = np.argsort(cost, axis=1)
    sure = np.take_along_axis(cost, order[:, :1], 1)[:, 0] - np.take_along_axis(cost, order[:, 1:2], 1)[:, 0]
    left, out = np.full(cost.shape[1], room), np.empty(len(cost), np.int64)
    for i in np.argsort(sure, kind="stable"):
        for p in order[i]:
            if left[p]:
                out[i] = p
                left[p] -= 1
                break
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.15, rounds: int = 8) -> np.ndarray:
    """A partition of the neighbour graph into parts of at most ``slack`` times the mean size."""
    room = int(np.ceil(slack * len(x) / parts))
    centre = x[rng.choice(len(x), parts, replace=False)]
    label = None
    for _ in range(rounds):
        label = _assign((centre * centre).sum(1)[None, :] - 2 * x @ centre.T, room)
        for p in range(parts):
            if (mine := label == p).any():
                centre[p] = x[mine].mean(0)
    n, k = graph.shape
    both = np.concatenate((np.stack((np.repeat(np.arange(n), k), graph.ravel()), 1), np.stack((graph.ravel(), np.repeat(np.arange(n), k)), 1)))
    both = both[np.argsort(both[:, 0], kind="stable")]
    first = np.searchsorted(both[:, 0], np.arange(n + 1))
    size = np.bincount(label, minlength=parts)
    low = int(len(x) / parts / slack)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            near = np.bincount(label[both[first[i] : first[i + 1], 1]], minlength=parts)
            old = label[i]
            near[size >= room] = -1
            new = int(near.argmax())
            if new != old and near[new] > np.bincount(label[both[first[i] : first[i + 1], 1]], minlength=parts)[old] and size[old] > low:
                label[i] = new
                size[old] -= 1
                size[new] += 1
                moved += 1
        if moved < n // 200:
            break
    return label


class Router:
    """A network with one hidden layer: probability of each part for a vector."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator, hidden: int = 128):
        self.shift, self.scale = np.zeros(dim), np.ones(dim)
        self.w = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return h, z / z.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.shift) / self.scale)[1]

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 40, batch: int = 256, rate: float = 2e-3) -> None:
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-9
        x = (x - self.shift) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                h, p = self._forward(x[i])
                dz = (p - target[i]) / len(i)
                dh = (dz @ self.w[2].T) * (h > 0)
                grads = [x[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
                t += 1
                for j, g in enumerate(grads):
                    g = g + 1e-5 * self.w[j]
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= rate * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)


class Model:
    def __init__(self, router: Router | None, parts: int, probes: int):
        self.router, self.parts, self.probes = router, parts, probes

    def route(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each vector."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router(x), axis=1, kind="stable")[:, :n]


def learn(x: np.ndarray, total: int, *, k: int = 10, part_rows: int = 1024, target_recall: float = 0.97, seed: int = 7) -> Model:
    """Parts, router and number of probes from a sample of ``total`` vectors.

    A part for every ``part_rows`` vectors, at least eight, as far as the sample has
    4 k vectors for each; only tables of fewer than 8 k vectors have no parts to learn.
    """
    parts = min(max(8, total // part_rows), len(x) // (4 * k))
    if parts < 2:
        return Model(None, 1, 1)
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1.0 / k)
    target = 0.8 * target + 0.2 * np.eye(parts)[label]
    test = rng.random(len(x)) < 0.2  # these only measure
    router = Router(x.shape[1], parts, rng)
    router.fit(x[~test], target[~test], rng)
    own = router(x).argmax(1)
    place = np.argsort(np.argsort(-router(x[test]), axis=1), axis=1)
    needed = np.take_along_axis(place, own[graph[test]], 1)  # how many probes would have found each neighbour
    found = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    probes = int(np.searchsorted(found, target_recall) + 1)
    return Model(router, parts, min(parts, probes))


_ENTRY = "digest string, vec array<double>, ids array<long>"


def _entries(vectors: DataFrame, keep: int, dim: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids; a task collapses its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            seen: dict[bytes, list[int]] = {}
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if vec_id is None or v is None or len(v) != dim or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    seen.setdefault(x.tobytes(), []).append(vec_id)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(s).hexdigest() for s in seen], pa.string()),
                    pa.array([np.frombuffer(s) for s in seen], pa.list_(pa.float64())),
                    pa.array([sorted(set(i))[:keep] for i in seen.values()], pa.list_(pa.int64())),
                ],
                ["digest", "vec", "ids"],
            )

    local = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, _ENTRY)
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return local.groupBy("digest").agg(F.first("vec").alias("vec"), ids.alias("ids"))


def _routed(df: DataFrame, model: Model, n: int, columns: str) -> DataFrame:
    """A row for each of the n most probable parts of ``vec``."""
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(b.schema.get_field_index("vec")).to_pylist())
            parts = m.route(x, n)
            t = b.take(pa.array(np.repeat(np.arange(len(x)), parts.shape[1])))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(parts.ravel().astype(np.int32))], [*t.schema.names, "part"])

    return df.mapInArrow(run, f"{columns}, part int")


_BEST = "query_id long, vec_id long, score double"


def _rerank(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best of each block for each query of a lot of its part's."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            x = np.array(right.column("vec").to_pylist())
            ids = right.column("ids").to_pylist()
            smallest = np.array([i[0] for i in ids])
            for q, v in zip(left.column("query_id").to_pylist(), np.array(left.column("vec").to_pylist()), strict=True):
                d = x - v
                score = np.sqrt((d * d).sum(1))
                # k + 1 entries hold k candidates other than the query, ties included
                limit = np.partition(score, k)[k] if len(score) > k + 1 else np.inf
                near = np.flatnonzero(score <= limit)
                near = near[np.lexsort((smallest[near], score[near]))]
                found = sorted((score[j], i) for j in near for i in ids[j] if i != q)[:k]
                out[0].extend([q] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(float(s) for s, _ in found)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    at = ["part", "block", "lot"]
    return queries.groupBy(*at).cogroup(rows.groupBy(*at)).applyInArrow(best, _BEST)


def search(vectors: DataFrame, *, every: int = 100, k: int = 10, sample_rows: int = 8192, block_rows: int = 4096, lot_rows: int = 4096, target_recall: float = 0.94) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    scratch = Scratch(spark, "ann")
    dims = vectors.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = scratch.table(_entries(vectors, k + 1, dims.d))
    total = entries.count()
    sample = entries.select("vec").orderBy(F.xxhash64("digest"), "digest").limit(sample_rows).collect()
    model = learn(np.array([r.vec for r in sample]).reshape(len(sample), dims.d), total, k=k, target_recall=target_recall)

    placed = scratch.table(_routed(entries, model, 1, _ENTRY))
    # parts of more rows than a block are searched in several
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    rows = placed.join(F.broadcast(blocks), "part").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).select("part", "block", "vec", "ids")  # a row a part, of which the sample bounds the number
    wanted = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0)
    wanted = wanted.where((F.col("query_id") % every == 0) & (F.size("vec") == dims.d) & finite).groupBy("query_id").agg(F.min("vec").alias("vec"))

    result = Scratch(spark, "neighbours")

    def run(asked: DataFrame, probes: int) -> DataFrame:
        routed = _routed(asked.select("query_id", "vec"), model, probes, "query_id long, vec array<double>")
        routed = scratch.table(routed, "routed")
        # a row a part again: in how many lots its queries are dealt, and its rows given to each
        lots = routed.groupBy("part").agg(F.ceil(F.count("*") / lot_rows).cast("int").alias("lots"))
        asking = routed.join(F.broadcast(lots), "part").withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots").cast("int"))
        asking = asking.join(F.broadcast(blocks), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = rows.join(F.broadcast(lots), "part").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        found = _rerank(asking.select("part", "block", "lot", "query_id", "vec"), held.select("part", "block", "lot", "vec", "ids"), k)
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = result.table(run(wanted, model.probes))
    if model.probes < model.parts:
        short = wanted.join(first.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
        if not short.isEmpty():
            short = scratch.table(short, "short")
            again = run(short, model.parts)
            first = result.table(first.join(short.select("query_id"), "query_id", "left_anti").unionByName(again))
    scratch.drop()
    return first
