"""Held-out kernel density over a grid of bandwidths.

Training rows lie in cells (see ``density.Cells``).  For every bandwidth a cell's share of a
test row's density has a lower and an upper bound from the cell's pivot, reach and size.  A
test row visits a cell if for any bandwidth the cell could add more than ``SHARE`` of what
the others are sure to hold; sums over visited cells are exact and serve all bandwidths at
once, so results differ from the full sum by rounding only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.operators import density, ranks

SHARE = 1e-15


def halves(df: DataFrame, *, share: float = 0.3, key: str = "uid", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: exactly the ceiling of ``share`` of all rows is held out."""
    n = math.ceil(share * df.count())
    t = ranks.permutation(df, key=key, seed=seed, name="_place")
    return t.where(F.col("_place") >= n).drop("_place"), t.where(F.col("_place") < n).drop("_place")


def log_densities(cells: density.Cells, test: DataFrame, bandwidths: Sequence[float]) -> DataFrame:
    """(id, at, log_sum): log of the sum of kernels at each test point (id, v) for the bandwidth of that number."""
    p, radius, h2 = cells.pivots, cells.radius, 2 * np.array(bandwidths) ** 2
    sizes = np.zeros(len(p))
    for r in cells.points.groupBy("cell").agg(F.sum("weight").alias("n")).collect():  # a row a pivot
        sizes[r.cell] = r.n

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = density._distances(density._matrix(b.column(1)), p)
                near, far = np.maximum(d - radius, 0) ** 2, (d + radius) ** 2
                need = np.zeros(d.shape, bool)
                with np.errstate(divide="ignore"):
                    size = np.log(sizes)
                for h in h2:
                    sure = (size - far / h).max(1, keepdims=True)
                    need |= size - near / h > sure + math.log(SHARE / len(p))
                q, c = np.nonzero(need & (sizes > 0))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(q)).columns, pa.array(c.astype(np.int32))], ["id", "v", "cell"])

    def sums(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, logs = np.zeros(0, np.int64), np.zeros((0, len(h2)))
        if asked.num_rows and held.num_rows:
            ids = asked.column("id").to_numpy()
            d = density._distances(density._matrix(asked.column("v")), density._matrix(held.column("v"))) ** 2
            w = np.log(held.column("weight").to_numpy().astype(float))
            parts = []
            for h in h2:
                e = w - d / h
                top = e.max(1, keepdims=True)
                parts.append(top[:, 0] + np.log(np.exp(e - top).sum(1)))
            logs = np.stack(parts, 1)
        return pa.table([pa.array(ids), pa.array(logs.tolist(), pa.list_(pa.float64()))], ["id", "logs"])

    routed = test.select("id", "v").mapInArrow(route, "id long, v array<double>, cell int")
    found = cells.visit(routed, cells.points.select("cell", "v", "weight"), sums, "id long, logs array<double>")
    # as many values a row and bandwidth as cells it has visited
    lists = found.select("id", F.posexplode("logs").alias("at", "x")).groupBy("id", "at").agg(F.collect_list("x").alias("x"))
    top = F.array_max("x")
    return lists.select("id", "at", (top + F.ln(F.aggregate("x", F.lit(0.0), lambda a, x: a + F.exp(x - top)))).alias("log_sum"))


def held_out(df: DataFrame, vector: str, d: int, bandwidths: Sequence[float] = (0.2, 0.3, 0.4, 0.5, 0.7, 1.0), *, rows: int = 8000, key: str = "uid", seed: int = 0, cell_rows: int = density.CELL_ROWS) -> list[dict]:
    """Mean held-out log density of each bandwidth, from at most ``rows`` training and test rows each (the first of a random order)."""
    train, test = halves(df, key=key, seed=seed)
    some = lambda t: density.points(t.orderBy(F.xxhash64(key, F.lit(seed + 1)), key).limit(rows), vector, key)
    cells = density.Cells(some(train), cell_rows)
    m = cells.points.agg(F.sum("weight")).first()[0]
    asked = cells.written(some(test))
    found = log_densities(cells, asked, bandwidths).join(asked.select("id", "weight"), "id")
    mean = {r["at"]: r.m for r in found.groupBy("at").agg((F.sum(F.col("log_sum") * F.col("weight")) / F.sum("weight")).alias("m")).collect()}
    cells.written.drop()
    return [{"bandwidth": h, "held_out": mean[i] - math.log(m) - d * math.log(h * math.sqrt(2 * math.pi))} for i, h in enumerate(bandwidths)]
