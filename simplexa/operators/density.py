"""Density clustering: mutual reachability, a spanning tree by Boruvka rounds, stable clusters of the condensed tree.

Distinct vectors are points with a weight.  They are put in the cells of their nearest
pivots (a hashed sample of bounded size).  A point visits a cell only if the triangle
inequality leaves room for what it looks for, so neighbour lists are exact without all
pairs, and vectors meet only inside a cell.

Spanning tree.  A round takes for each component its lightest edge out: first from the neighbour
lists; a point whose list ends below that weight might have a nearer one elsewhere and visits
the cells within it, except those that lie in its own component.  The result is the minimum
spanning tree of all mutual reachabilities; edges are ordered by weight and ends, so that
ties make no cycles.

Components are merged and the condensed tree is built on the driver, from no more than n - 1
tree edges: its memory grows with the number of distinct vectors, all of which take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.session import Written, ship

CELL_ROWS = 128
PIVOTS = 4096
#: queries of a cell that are searched by one task
BLOCK = 4096
#: distances that a task holds at once
MATRIX = 1 << 20
#: the triangle inequality is trusted up to rounding
SLACK = 1 + 1e-9


def points(df: DataFrame, vector: str, key: str = "uid") -> DataFrame:
    """(id, v, weight): distinct vectors under their smallest key; vectors with nulls or non-finite components are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + 0.0)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "v", "weight")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += (x[:, None] - y[None, :]) ** 2
    return np.sqrt(out)


def _lots(rows: int, columns: int) -> Iterator[slice]:
    """The rows of a matrix of distances in lots of at most ``MATRIX`` entries, or of one row."""
    step = max(1, MATRIX // max(1, columns))
    return (slice(i, i + step) for i in range(0, rows, step))


class Cells:
    """Points with their cell, and how far each cell reaches from its pivot."""

    def __init__(self, pts: DataFrame, cell_rows: int = CELL_ROWS):
        ship(pts.sparkSession)
        self.spark = pts.sparkSession
        self.written = Written(self.spark, "density")
        pts = self.written(pts)
        self.n = pts.count()
        pivots = pts.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, self.n // cell_rows))).select("id", "v").collect()
        self.pivots = np.array([r.v for r in pivots]).reshape(len(pivots), -1)
        self.pivot_ids = [r.id for r in pivots]
        p = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lot in _lots(b.num_rows, len(p)):
                    c = b.slice(lot.start, lot.stop - lot.start)
                    d = _distances(_matrix(c.column(1)), p)
                    yield pa.RecordBatch.from_arrays([*c.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "v", "weight", "cell", "off"])

        self.points = self.written(pts.select("id", "v", "weight").mapInArrow(place, "id long, v array<double>, weight long, cell int, off double"))
        self.radius = np.zeros(len(p))
        for r in self.points.groupBy("cell").agg(F.max("off").alias("r")).collect():  # a row a pivot
            self.radius[r.cell] = r.r

    def routed(self, asked: DataFrame, skip: DataFrame | None = None) -> DataFrame:
        """(id, v, comp, bound) once for each cell that may hold a point within the bound; ``skip`` (cell, comp): cells of one component."""
        p, radius = self.pivots, self.radius

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # a row may go to every cell
                for lot in _lots(b.num_rows, 16 * len(p)):
                    part = b.slice(lot.start, lot.stop - lot.start)
                    near = _distances(_matrix(part.column(1)), p) - radius[None, :]
                    q, c = np.nonzero(near <= part.column(3).to_numpy()[:, None] * SLACK + 1e-300)
                    t = part.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([*t.columns, pa.array(c.astype(np.int32))], ["id", "v", "comp", "bound", "cell"])

        out = asked.select("id", "v", "comp", "bound").mapInArrow(route, "id long, v array<double>, comp long, bound double, cell int")
        return out.join(F.broadcast(skip), ["cell", "comp"], "left_anti") if skip is not None else out  # a row a pivot at most

    def visit(self, routed: DataFrame, held: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over the queries and the points of each cell; the queries of a crowded cell are cut into blocks."""
        routed = self.written(routed)
        rows = routed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()  # a row a pivot at most
        sizes = lambda: F.broadcast(self.spark.createDataFrame([tuple(r) for r in rows], "cell int, blocks int"))
        asked = routed.join(sizes(), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        there = held.join(sizes(), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return asked.groupBy("cell", "block").cogroup(there.groupBy("cell", "block")).applyInArrow(run, schema)


def neighbours(cells: Cells, k: int) -> DataFrame:
    """(id, near): the k nearest points of each (itself first), as structs (d, id, weight); exact."""

    def own(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        bound = np.full(len(x), np.inf)
        if len(x) >= k:
            for lot in _lots(len(x), len(x)):
                bound[lot] = np.partition(_distances(x[lot], x), k - 1, axis=1)[:, k - 1]
        return pa.table([t.column("id"), t.column("v"), pa.nulls(len(x), pa.int64()), pa.array(bound)], ["id", "v", "comp", "bound"])

    asked = cells.points.select("id", "v", "cell").groupBy("cell").applyInArrow(own, "id long, v array<double>, comp long, bound double")

    def nearest(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if asked.num_rows and held.num_rows:
            ids, weights = held.column("id").to_numpy(), held.column("weight").to_numpy()
            x, y = _matrix(asked.column("v")), _matrix(held.column("v"))
            rows = (row for lot in _lots(len(x), len(y)) for row in _distances(x[lot], y))
            for q, bound, row in zip(asked.column("id").to_pylist(), asked.column("bound").to_pylist(), rows, strict=True):
                at = np.flatnonzero(row <= bound)
                at = at[np.lexsort((ids[at], row[at]))][:k]
                for column, values in zip(out, ([q] * len(at), row[at].tolist(), ids[at].tolist(), weights[at].tolist()), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["id", "d", "other", "weight"])

    found = cells.visit(cells.routed(asked), cells.points.select("cell", "id", "v", "weight"), nearest, "id long, d double, other long, weight long")
    entry = F.struct("d", F.col("other").alias("id"), "weight")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("near"))


def cores(near: DataFrame, min_samples: int, k: int) -> DataFrame:
    """(id, core, reach, near): the distance within which ``min_samples`` rows lie, the row itself among them, and where the list ends."""
    step = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d")), lambda a, x: F.struct((a["n"] + x["weight"]).alias("n"), F.when((a["n"] < min_samples) & (a["n"] + x["weight"] >= min_samples), x["d"]).otherwise(a["d"]).alias("d")))
    reach = F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near", -1)["d"])
    return near.select("id", step["d"].alias("core"), reach.alias("reach"), "near")


def _lightest(edges: DataFrame, *known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(comp, w, lo, hi, into): the first edge of each component, among the ``known`` too, in the order of weight and ends."""
    found = edges.groupBy("comp").agg(F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "into")).alias("e"))
    found = found.select("comp", "e.*").toArrow()
    new = [found.column(c).to_numpy() for c in ("comp", "w", "lo", "hi", "into")]
    comp, w, lo, hi, into = (np.concatenate(c) for c in zip(known, new, strict=True)) if known else new
    order = np.lexsort((hi, lo, w, comp))
    order = order[np.concatenate(([True], np.diff(comp[order]) != 0))[: len(order)]]
    return tuple(c[order] for c in (comp, w, lo, hi, into))


def _to_pivots(cells: Cells, state: DataFrame, ids: np.ndarray, core: np.ndarray, comp: np.ndarray) -> DataFrame:
    """Edges between points and pivots of other components: no component is without one, so all have a bound to search within."""
    p = cells.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            mine, own, c = (b.column(i).to_numpy() for i in (0, 2, 3))
            w = np.maximum(_distances(_matrix(b.column(1)), p), np.maximum(own[:, None], core[None, :]))
            w[c[:, None] == comp[None, :]] = np.inf
            i, j = np.concatenate((np.arange(len(w)), w.argmin(0))), np.concatenate((w.argmin(1), np.arange(len(p))))
            out = np.concatenate((np.ones(len(w), bool), np.zeros(len(p), bool)))  # else from the pivot
            keep = np.isfinite(w[i, j])
            i, j, out = i[keep], j[keep], out[keep]
            columns = (np.where(out, c[i], comp[j]), np.where(out, mine[i], ids[j]), np.where(out, ids[j], mine[i]), w[i, j], np.where(out, comp[j], c[i]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["comp", "a", "b", "w", "into"])

    return state.select("id", "v", "core", "comp").mapInArrow(run, "comp long, a long, b long, w double, into long")


def reached(cells: Cells, min_samples: int) -> DataFrame:
    """``cores`` of all points, written."""
    k = max(min_samples, 8)
    return cells.written(cores(neighbours(cells, k), min_samples, k))


def spanning_tree(cells: Cells, info: DataFrame) -> list[tuple[int, int, float]]:
    """(a, b, w): the minimum spanning tree of mutual reachability, from ``reached``.

    Edges are found by Spark; the driver holds the component of each point and the tree,
    both no longer than the points are many.
    """
    spark = cells.spark
    core = info.select("id", "core")
    pairs = info.select(F.col("id").alias("a"), F.col("core").alias("ca"), F.explode("near").alias("e")).select("a", "ca", F.col("e.id").alias("b"), F.col("e.d").alias("d")).where("a <> b")
    graph = cells.written(pairs.join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w")))
    held = cells.written(cells.points.select("id", "v", "cell").join(info.select("id", "core", "reach"), "id"))
    known_core = core.orderBy("id").toArrow()
    ids, cored = known_core.column("id").to_numpy(), known_core.column("core").to_numpy()
    pivot = np.searchsorted(ids, cells.pivot_ids)
    comp, tree = ids.copy(), []
    while len(np.unique(comp)) > 1:
        comps = spark.createDataFrame(pa.table({"id": ids, "comp": comp}))
        state = held.join(comps, "id")
        side = lambda x, c: comps.select(F.col("id").alias(x), F.col("comp").alias(c))
        apart = graph.join(side("a", "comp"), "a").join(side("b", "into"), "b").where("comp <> into").select("comp", "a", "b", "w", "into")
        back = apart.select(F.col("into").alias("comp"), F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("comp").alias("into"))
        best = _lightest(apart.unionByName(back).unionByName(_to_pivots(cells, state, ids[pivot], cored[pivot], comp[pivot])))

        # points that may have a nearer one than their list holds
        bounds = spark.createDataFrame(pa.table({"comp": best[0], "bound": best[1]}))
        open_ = state.join(bounds, "comp").where("reach <= bound and core <= bound").select("id", "v", "comp", "bound", "core")
        whole = state.groupBy("cell").agg(F.min("comp").alias("comp"), F.max("comp").alias("other")).where("comp = other").select("cell", "comp")
        routed = cells.routed(open_, whole).join(core, "id")
        at, w, lo, hi, into = _lightest(cells.visit(routed, state.select("cell", "id", "v", "comp", "core"), _foreign, "comp long, a long, b long, w double, into long"), *best)
        edges, first = np.unique(np.stack((lo, hi), axis=1), axis=0, return_index=True)
        tree.extend(zip(*edges.T.tolist(), w[first].tolist(), strict=True))

        # each component points over its edge; as edges are in one order, only two that share theirs point at each other
        up, own = np.searchsorted(at, into), np.arange(len(at))
        up = np.where((up[up] == own) & (own < up), own, up)
        while (up != up[up]).any():
            up = up[up]
        comp = at[up[np.searchsorted(at, comp)]]
    return tree


def _foreign(asked: pa.Table, there: pa.Table) -> pa.Table:
    """The lightest edge of each component from a block of queries into a cell."""
    best: dict[int, tuple] = {}
    if asked.num_rows and there.num_rows:
        comp, core, ids, bound = (asked.column(c).to_numpy() for c in ("comp", "core", "id", "bound"))
        comp2, core2, ids2 = (there.column(c).to_numpy() for c in ("comp", "core", "id"))
        x, y = _matrix(asked.column("v")), _matrix(there.column("v"))
        for lot in _lots(len(x), len(y)):
            w = np.maximum(_distances(x[lot], y), np.maximum(core[lot, None], core2[None, :]))
            w[comp[lot, None] == comp2[None, :]] = np.inf
            low = w.min(1)
            for i in np.flatnonzero((low <= bound[lot]) & np.isfinite(low)):
                q = lot.start + int(i)
                for j in np.flatnonzero(w[i] == low[i]):
                    e = (float(low[i]), *sorted((int(ids[q]), int(ids2[j]))), int(comp2[j]))
                    best[int(comp[q])] = min(e, best.get(int(comp[q]), e))
    rows = [(c, lo, hi, w, into) for c, (w, lo, hi, into) in best.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["comp", "a", "b", "w", "into"])


def condensed(ids: np.ndarray, weights: np.ndarray, core: np.ndarray, edges: list[tuple[int, int, float]], min_cluster_size: int) -> np.ndarray:
    """Cluster of each point (-1: noise), numbered by their smallest ids: those of largest stability, never all points together."""
    n = len(ids)
    out = np.full(n, -1, np.int64)
    if n == 0:
        return out
    place = {int(i): j for j, i in enumerate(ids)}
    size, height, children, top = weights.tolist(), core.tolist(), [()] * n, list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: (e[2], min(e[:2]), max(e[:2]))):
        x, y = find(place[a]), find(place[b])
        top[x] = top[y] = len(top)
        top.append(len(top))
        children.append((x, y))
        height.append(w)
        size.append(size[x] + size[y])

    # from the root down a cluster lives on in its only large part and ends where two part
    birth, stability, kids, members = [0.0], [0.0], [()], [[]]
    stack = [(len(size) - 1, 0)]
    while stack:
        node, c = stack.pop()
        at = 1 / max(height[node], 1e-150)
        large = [x for x in children[node] if size[x] >= min_cluster_size]
        if len(large) == 1:
            stack.append((large[0], c))
        elif large:
            stability[c] += (at - birth[c]) * size[node]
            kids[c] = tuple(len(birth) + i for i in range(2))
            for x in large:
                stack.append((x, len(birth)))
                birth.append(at)
                stability.append(0.0)
                kids.append(())
                members.append([])
        fall = [x for x in children[node] if x not in large] if children[node] else [node]
        stability[c] += (at - birth[c]) * sum(size[x] for x in fall)
        while fall:
            x = fall.pop()
            fall.extend(children[x])
            if not children[x]:
                members[c].append(x)

    best, alone = list(stability), [True] * len(birth)
    for c in range(len(birth) - 1, -1, -1):
        below = sum(best[x] for x in kids[c])
        if kids[c] and (c == 0 or below > best[c]):
            best[c], alone[c] = below, False
    groups, todo = [], list(kids[0])
    while todo:
        c = todo.pop()
        if not alone[c]:
            todo.extend(kids[c])
            continue
        whole, group = [c], []
        while whole:
            x = whole.pop()
            whole.extend(kids[x])
            group.extend(members[x])
        groups.append(group)
    for number, group in enumerate(sorted(groups, key=lambda g: ids[g].min())):
        out[group] = number
    return out


def clusters(df: DataFrame, vector: str, *, min_cluster_size: int = 2000, min_samples: int = 50, key: str = "uid", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, label) of every row; -1 is noise.

    Rows without a key or with nulls or non-finite components have no label and are absent.
    """
    spark = df.sparkSession
    kept = Written(spark, "density-rows")
    keyed = kept(df.where(F.col(key).isNotNull()).select(F.col(key), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("v")))
    pts = kept(points(keyed, "v", key))
    found = pts.select("id", "weight").orderBy("id").toArrow()
    if not found.num_rows:
        return spark.createDataFrame([], keyed.select(key, F.lit(-1).alias("label")).schema)
    cells = Cells(pts, cell_rows)
    info = reached(cells, min_samples)
    edges = spanning_tree(cells, info)
    ids, weights = found.column("id").to_numpy(), found.column("weight").to_numpy()
    core = info.select("id", "core").orderBy("id").toArrow().column("core").to_numpy()
    cells.written.drop()
    label = condensed(ids, weights, core, edges, min_cluster_size)
    named = spark.createDataFrame(pa.table({"id": ids, "label": label.astype(np.int32)}))
    return keyed.join(pts.join(named, "id").select("v", "label"), "v").select(key, "label")
