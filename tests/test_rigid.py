"""Resampling, motion, projection and alignment of grids against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.operators import rigid, volumes

N = 12


def blobs(n=N):
    """A smooth volume without symmetry."""
    z, y, x = np.indices((n, n, n)) / (n - 1) * 11
    out = np.zeros((n, n, n))
    for (a, b, c), s, h in (((5, 5, 3), 1.6, 1.0), ((7, 4, 7), 1.3, 1.5), ((4, 8, 6), 1.1, 0.8), ((6, 6, 8.5), 1.0, 1.2)):
        out += h * np.exp(-((z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2) / (2 * s * s))
    return out


def frame(spark, **maps):
    return spark.createDataFrame([row for name, v in maps.items() for row in volumes.to_long(name, v)], "map string, z int, y int, x int, v double")


def dense(df, n, axes=("z", "y", "x")):
    out = np.full((n,) * len(axes), np.nan)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r["v"]
    return out


def plain(v, p, outside="nearest"):
    """The value at a position, one corner at a time."""
    n = len(v)
    if outside == "zero" and (p < -1e-9).any() | (p > n - 1 + 1e-9).any():
        return 0.0
    p = np.clip(p, 0, n - 1)
    total = 0.0
    for corner in np.ndindex(2, 2, 2):
        at = np.floor(p).astype(int) + corner
        w = np.prod(1 - np.abs(p - at))
        if w > 0:
            total += w * v[tuple(at)]
    return total


def turned(v, r, shift, outside="nearest"):
    mid = (len(v) - 1) / 2
    out = np.zeros_like(v)
    for o in np.ndindex(v.shape):
        out[o] = plain(v, r @ (np.array(o) - mid - shift) + mid, outside)
    return out


@pytest.mark.parametrize("to", [2, 7, 12, 19])
def test_resampled(spark, to):
    v = np.random.default_rng(1).random((N, N, N))
    got = dense(rigid.resampled(frame(spark, a=v), N, to), to)
    want = np.zeros((to, to, to))
    for o in np.ndindex(want.shape):
        want[o] = plain(v, np.array(o) * (N - 1) / (to - 1))
    assert np.allclose(got, want)


@pytest.mark.parametrize("outside", ["nearest", "zero"])
def test_moved_and_projected(spark, outside):
    v, w = np.random.default_rng(2).random((2, 7, 7, 7))
    r, shift = rigid.rotation(np.array([0.3, -0.7, 0.4])), np.array([0.5, -1.25, 0.0])
    motions = spark.createDataFrame([(m, t, q.ravel().tolist(), s.tolist()) for m in "ab" for t, q, s in ((0, np.eye(3), np.zeros(3)), (1, r, shift))], "map string, t int, r array<double>, shift array<double>")
    out = rigid.moved(frame(spark, a=v, b=w), motions, 7, outside=outside).cache()
    for m, source in (("a", v), ("b", w)):
        assert np.allclose(dense(out.where((F.col("map") == m) & (F.col("t") == 0)), 7), source)
        assert np.allclose(dense(out.where((F.col("map") == m) & (F.col("t") == 1)), 7), turned(source, r, shift, outside))
    images = rigid.projections(frame(spark, a=v, b=w), motions, 7)
    assert np.allclose(dense(images.where("map = 'b' and t = 1"), 7, ("y", "x")), turned(w, r, shift, "zero").sum(axis=0))
    out.unpersist()


def test_missing_voxels_and_empty(spark):
    v = np.random.default_rng(3).random((5, 5, 5))
    motions = spark.createDataFrame([("a", 0, rigid.rotation(np.array([0.2, 0.1, 0.0])).ravel().tolist(), [0.0] * 3)], "map string, t int, r array<double>, shift array<double>")
    sparse = np.where(v > 0.6, v, 0)
    some = rigid.moved(frame(spark, a=v).where("v > 0.6"), motions, 5)
    assert np.allclose(dense(some, 5), dense(rigid.moved(frame(spark, a=sparse), motions, 5), 5))
    none = frame(spark, a=v).where("false")
    assert rigid.resampled(none, 5, 3).count() == 0
    assert rigid.moved(none, motions, 5).agg(F.max(F.abs("v"))).first()[0] == 0
    assert rigid.moved(frame(spark, a=v), motions.where("false"), 5).count() == 0
    with pytest.raises(ValueError):
        rigid.resampled(none, 5, 1)


def pair_rows(spark, **pairs):
    rows = [(name, z, y, x, float(a[z, y, x]), float(b[z, y, x])) for name, (a, b) in pairs.items() for z, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "pair string, z int, y int, x int, va double, vb double")


def test_align_finds_planted_motions(spark):
    v = blobs(16)
    r, shift = rigid.rotation(np.array([0.9, -1.4, 0.6])), np.array([0.0, 0.8, -0.5])
    pairs = pair_rows(spark, far=(v, turned(v, r, shift)), same=(v, v), flat=(v, np.ones_like(v)))
    found = rigid.align(pairs, 16, search=12, rotations=300, parts=8).cache()
    by = {row.pair: row for row in found.collect()}
    assert by["same"].cc == pytest.approx(1) and by["same"].degrees == pytest.approx(0, abs=1e-6)
    assert by["flat"].cc == -1
    assert by["far"].cc_raw < 0.6 < 0.95 < by["far"].cc
    # the motion found undoes the one planted
    angle = np.degrees(np.arccos(np.clip((np.trace(np.reshape(by["far"].r, (3, 3)) @ r) - 1) / 2, -1, 1)))
    assert angle < 6
    mended = rigid.aligned(pairs.where("pair = 'far'"), found, 16)
    assert mended.count() == 16**3
    assert volumes.correlation(mended).first().cc > 0.95
    assert rigid.align(pairs.where("false"), 16, search=12).count() == 0
    found.unpersist()
