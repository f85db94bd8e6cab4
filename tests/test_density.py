"""Density clustering against a plain implementation on a full matrix."""

from collections import Counter

import numpy as np
import pytest

from simplexa.operators import density


def matrix(x, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None])), core


def prim(m):
    n = len(m)
    out, best, via, left = [], m[0].copy(), np.zeros(n, int), set(range(1, n))
    while left:
        j = min(left, key=lambda i: best[i])
        out.append((int(via[j]), j, float(best[j])))
        left.discard(j)
        near = m[j] < best
        best[near], via[near] = m[j][near], j
    return out


def plain_labels(n, edges, least):
    """Clusters by cutting the tree's heaviest edge again and again."""

    def parts(nodes, edges):
        heavy = max(edges, key=lambda e: e[2])
        rest = [e for e in edges if e is not heavy]
        side, grown = {heavy[0]}, True
        while grown:
            more = {b for a, b, _ in rest if a in side} | {a for a, b, _ in rest if b in side}
            grown = not more <= side
            side |= more
        return heavy[2], [(s, [e for e in rest if e[0] in s]) for s in (side & nodes, nodes - side)]

    def live(nodes, edges, birth):
        """(value, chosen clusters) of a cluster born at a density."""
        members, gained = nodes, 0.0
        while edges:
            h, halves = parts(nodes, edges)
            big = [p for p in halves if len(p[0]) >= least]
            if len(big) == 2:
                gained += (1 / h - birth) * len(nodes)
                below = [live(*p, 1 / h) for p in big]
                value = sum(v for v, _ in below)
                if birth == 0 or value > gained:
                    return value, [c for _, cs in below for c in cs]
                return gained, [members]
            if not big:
                gained += (1 / h - birth) * len(nodes)
                break
            gained += (1 / h - birth) * (len(nodes) - len(big[0][0]))
            nodes, edges = big[0]
        return gained, [members] if birth else []

    found = live(set(range(n)), edges, 0.0)[1]
    out = np.full(n, -1)
    for c, members in enumerate(sorted(found, key=min)):
        out[sorted(members)] = c
    return out


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), "noise", 1) for i, v in enumerate(x)], "uid long, z array<double>, label string, cell int").repartition(3)


def test_labels_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.3, 220), ((4, 0, 0), 0.5, 130), ((4, 1.5, 0), 0.2, 60), ((-9, 9, 0), 0.4, 50))] + [rng.uniform(-10, 10, (40, 3))])
    m, _ = matrix(x, 8)
    edges = prim(m)
    pts = density.points(table(spark, x), "z")
    cells = density.Cells(pts, 40)
    tree = density.spanning_tree(cells, density.reached(cells, 8))
    assert len(tree) == len(x) - 1
    assert sorted(e[2] for e in tree) == pytest.approx(sorted(e[2] for e in edges))
    got = {r.uid: r.label for r in density.clusters(table(spark, x), "z", min_cluster_size=25, min_samples=8, cell_rows=40).collect()}
    want = plain_labels(len(x), edges, 25)
    assert len(set(want)) >= 4 and [got[i] for i in range(len(x))] == want.tolist()


def test_neighbour_lists_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1, 20]
    cells = density.Cells(density.points(table(spark, x), "z"), 30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for r in density.neighbours(cells, 6).collect():
        assert [n.id for n in r.near] == np.argsort(d[r.id], kind="stable")[:6].tolist()


def test_odd_rows(spark):
    x = np.random.default_rng(4).normal(size=(60, 2))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(40)] + [(200, None), (201, [None, 1.0]), (202, [float("nan"), 1.0]), (None, [1.0, 1.0]), (203, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "uid long, z array<double>")
    got = Counter(r.label for r in density.clusters(df, "z", min_cluster_size=30, min_samples=5).collect())
    assert sum(got.values()) == 101  # rows without a vector take no part
    assert density.clusters(df.limit(0), "z").count() == 0
    assert [r.label for r in density.clusters(df.limit(1), "z", min_samples=1).collect()] == [-1]


def test_all_rows_are_labelled(spark):
    """More rows than the sample that was read before, of few distinct vectors."""
    from pyspark.sql import functions as F

    df = spark.range(45_000).select(F.col("id").alias("uid"), F.array((F.col("id") % 9).cast("double"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(500.0)).alias("z"))
    got = density.clusters(df, "z", min_cluster_size=10_000, min_samples=50)
    assert Counter(map(tuple, got.groupBy(F.col("uid") % 2, "label").count().collect())) == Counter([(0, 0, 22_500), (1, 1, 22_500)])
