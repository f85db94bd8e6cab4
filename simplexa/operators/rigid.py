"""Resampling, rigid motion, projection and alignment of grids in long form.

A grid has one row a voxel (map, x, y, z, v); missing voxels count as zero.  Positions and
matrices are in the order z, y, x.  A motion (map, t, r, shift) has the nine entries of a
rotation by rows and a translation in voxels; the voxel o of the result is read from
R (o - centre - shift) + centre, between eight voxels by straight lines.  A motion of a map
that has no voxels gives zeros; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.operators.volumes import AXES
from simplexa.session import ship

ORDER = AXES[::-1]
CORNERS = [(i >> 2, i >> 1 & 1, i & 1) for i in range(8)]
#: positions this far outside the grid still count as its edge
EDGE = 1e-9


def resampled(maps: DataFrame, n: int, to: int, values: tuple[str, ...] = ("v",), by: str = "map") -> DataFrame:
    """Grids of side ``n`` on a grid of side ``to``, corner on corner (V12); both at least two.

    Each voxel is spread over the new ones less than one old voxel away, so that partial sums
    combine before the one shuffle.
    """
    if n < 2 or to < 2:
        raise ValueError("a grid to resample has at least two voxels a side")
    step = (n - 1) / (to - 1)
    out = maps.select(by, *AXES, *values)
    weight: Column = F.lit(1.0)
    for c in AXES:
        first = F.greatest(F.ceil((F.col(c) - 1) / step), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(c) + 1) / step), F.lit(to - 1)).cast("int")
        out = out.withColumn(f"{c}_to", F.explode(F.sequence(first, last)))
        weight = weight * F.greatest(1 - F.abs(F.col(f"{c}_to") * step - F.col(c)), F.lit(0.0))
    return out.groupBy(by, *[F.col(f"{c}_to").alias(c) for c in AXES]).agg(*[F.sum(weight * F.col(v)).alias(v) for v in values])


def _cells(maps: DataFrame) -> DataFrame:
    """(map, x, y, z, k0..k7): the values at the eight corners of each cell, named by its lowest corner."""
    near = F.array(*[F.struct(F.lit(i).alias("k"), *[F.lit(d).alias(c) for c, d in zip(ORDER, at)]) for i, at in enumerate(CORNERS)])
    spread = maps.select("map", *AXES, "v").withColumn("c", F.explode(near))
    spread = spread.select("map", *[(F.col(c) - F.col(f"c.{c}")).alias(f"c{c}") for c in AXES], F.col("c.k").alias("k"), "v")
    return spread.where(" and ".join(f"c{c} >= 0" for c in AXES)).groupBy("map", *[f"c{c}" for c in AXES]).agg(*[F.sum(F.when(F.col("k") == i, F.col("v"))).alias(f"k{i}") for i in range(8)])


def moved(maps: DataFrame, motions: DataFrame, n: int, *, centre: float | None = None, outside: str = "nearest") -> DataFrame:
    """(map, t, x, y, z, v): each map under each of its motions.

    Beyond the grid the ``nearest`` voxel counts, or ``zero``.  The eight corners of a cell are
    brought together once, so that a voxel of the result joins one row, not eight.
    """
    if outside not in ("nearest", "zero"):
        raise ValueError(f"outside is nearest or zero, not {outside}")
    mid = (n - 1) / 2 if centre is None else centre
    ramp = F.sequence(F.lit(0), F.lit(n - 1))
    grid = motions.select("map", "t", "r", "shift").withColumn("z", F.explode(ramp)).repartition("map", "t", "z")
    grid = grid.withColumn("y", F.explode(ramp)).withColumn("x", F.explode(ramp))
    off = [F.col(c) - mid - F.get("shift", F.lit(i)) for i, c in enumerate(ORDER)]
    read = [(F.get("r", F.lit(3 * i)) * off[0] + F.get("r", F.lit(3 * i + 1)) * off[1] + F.get("r", F.lit(3 * i + 2)) * off[2] + mid).alias(f"p{c}") for i, c in enumerate(ORDER)]
    grid = grid.select("map", "t", *AXES, *read)
    inside = F.lit(True)
    for c in ORDER:
        inside = inside & (F.col(f"p{c}") >= -EDGE) & (F.col(f"p{c}") <= n - 1 + EDGE)
    held = lambda c: F.least(F.greatest(F.col(f"p{c}"), F.lit(0.0)), F.lit(float(n - 1)))
    grid = grid.select("map", "t", *AXES, inside.alias("inside"), *[held(c).alias(f"p{c}") for c in ORDER])
    grid = grid.select("*", *[F.floor(f"p{c}").cast("int").alias(f"c{c}") for c in ORDER])
    at = grid.join(_cells(maps), ["map", *[f"c{c}" for c in AXES]], "left")
    total: Column = F.lit(0.0)
    for i, corner in enumerate(CORNERS):
        weight: Column = F.lit(1.0)
        for c, d in zip(ORDER, corner):
            part = F.col(f"p{c}") - F.col(f"c{c}")
            weight = weight * (part if d else 1 - part)
        total = total + weight * F.coalesce(f"k{i}", F.lit(0.0))
    value = total if outside == "nearest" else F.when(F.col("inside"), total).otherwise(0.0)
    return at.select("map", "t", *AXES, value.alias("v"))


def projections(maps: DataFrame, motions: DataFrame, n: int) -> DataFrame:
    """(map, t, x, y, v): each map turned about its middle and summed along z; zero beyond the grid."""
    return moved(maps, motions, n, outside="zero").groupBy("map", "t", "x", "y").agg(F.sum("v").alias("v"))


def rotation(v: np.ndarray) -> np.ndarray:
    """The matrix of a rotation vector."""
    angle = float(np.linalg.norm(v))
    if angle == 0:
        return np.eye(3)
    a, b, c = v / angle
    k = np.array([[0, -c, b], [c, 0, -a], [-b, a, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _trial(index: int, seed: int) -> np.ndarray:
    """Rotation number ``index`` of a seeded uniform sequence; number 0 is the identity."""
    if index == 0:
        return np.eye(3)
    q = np.random.default_rng([seed, index]).normal(size=4)
    w, v = q[0] / np.linalg.norm(q), q[1:] / np.linalg.norm(q)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * w * k + 2 * k @ k


class _Match:
    """Correlation of a fixed grid with a moved one, inside the dense part of the fixed one."""

    def __init__(self, ref: np.ndarray, mov: np.ndarray, n: int):
        ref = ref.reshape(n, n, n)
        mask = ref > ref.mean() + 0.5 * ref.std()
        if mask.sum() < 50:
            mask = ref > ref.mean()
        self.n, self.mov, self.mid = n, mov, (n - 1) / 2
        self.at = np.array(np.nonzero(mask), float) - self.mid
        self.want = ref[mask] - (ref[mask].mean() if mask.any() else 0.0)

    def __call__(self, r: np.ndarray, shift: np.ndarray) -> float:
        n = self.n
        p = np.clip(r @ (self.at - shift[:, None]) + self.mid, 0, n - 1)
        low = np.minimum(p.astype(int), n - 2)
        f = p - low
        base = (low[0] * n + low[1]) * n + low[2]
        got = np.zeros(len(base))
        for dz, dy, dx in CORNERS:
            w = (f[0] if dz else 1 - f[0]) * (f[1] if dy else 1 - f[1]) * (f[2] if dx else 1 - f[2])
            got += w * self.mov[base + (dz * n + dy) * n + dx]
        if len(got) == 0:
            return -1.0
        whole = got @ got
        got -= got.mean()
        if got @ got <= 1e-18 * whole:  # constant but for rounding
            return -1.0
        size = np.sqrt((got @ got) * (self.want @ self.want))
        return float(got @ self.want / size) if size > 0 else -1.0


def _refined(match: _Match, r: np.ndarray, cc: float, *, turn: float = 0.2, push: float = 1.0, least: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """The best motion near a rotation: steps along six axes, halved when none helps."""
    shift = np.zeros(3)
    while turn > least:
        better = False
        for axis in range(6):
            for sign in (1.0, -1.0):
                e = np.zeros(3)
                e[axis % 3] = sign
                trial = (rotation(e * turn) @ r, shift) if axis < 3 else (r, shift + e * push)
                if (c := match(*trial)) > cc + 1e-9:
                    cc, (r, shift), better = c, trial, True
                    break
        if not better:
            turn, push = turn / 2, push / 2
    return cc, r, shift


def align(pairs: DataFrame, n: int, *, search: int = 48, rotations: int = 500, parts: int = 16, seed: int = 0) -> DataFrame:
    """The motion of the second grid of each pair (pair, x, y, z, va, vb) that fits it best to the first (V9).

    (pair, r, shift, cc_raw, cc, degrees); ``moved`` applies it at full size.  Both grids are
    resampled to at most ``search`` voxels a side, so that a row of the search holds at most
    2 search^3 numbers whatever the size of the grids.  The trial rotations of a pair are dealt
    to ``parts`` rows, each of which refines its own best by steps of rotation and shift; the
    best of all is kept, ties going to the smaller part.  A pair with a constant grid has cc -1.
    """
    if parts < 1 or rotations < 0 or search < 2 or n < 2:
        raise ValueError("align takes at least one part and grids of at least two voxels a side")
    ship(pairs.sparkSession)
    side = min(search, n)
    filled = pairs.select("pair", *AXES, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("va", "vb")])
    small = filled if side == n else resampled(filled, n, side, ("va", "vb"), "pair")
    place = ((F.col("z") * side + F.col("y")) * side + F.col("x")).cast("int").alias("i")
    whole = small.groupBy("pair").agg(F.collect_list(F.struct(place, "va", "vb")).alias("g"))
    rows = whole.select("pair", F.col("g.i").alias("i"), F.col("g.va").alias("va"), F.col("g.vb").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    scale = (n - 1) / (side - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            ref, mov = np.zeros(side**3), np.zeros(side**3)
            ref[row.i], mov[row.i] = row.va, row.vb
            match = _Match(ref, mov, side)
            trials = [_trial(i, seed) for i in range(row.part, rotations + 1, parts)]
            if not trials:
                continue
            scores = [match(r, np.zeros(3)) for r in trials]
            best = int(np.argmax(scores))
            cc, r, shift = _refined(match, trials[best], scores[best])
            degrees = float(np.degrees(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))))
            out.append((row.pair, row.part, r.ravel().tolist(), (shift * scale).tolist(), match(np.eye(3), np.zeros(3)), cc, degrees))
        return pd.DataFrame(out, columns=["pair", "part", "r", "shift", "cc_raw", "cc", "degrees"])

    kind = pairs.schema["pair"].dataType.simpleString()
    # a row is a group of its own, so that a worker holds one at a time
    found = rows.groupBy("pair", "part").applyInPandas(run, f"pair {kind}, part int, r array<double>, shift array<double>, cc_raw double, cc double, degrees double")
    best = F.max_by(F.struct("r", "shift", "cc_raw", "cc", "degrees"), F.struct("cc", -F.col("part"))).alias("b")
    return found.groupBy("pair").agg(best).select("pair", "b.*")


def aligned(pairs: DataFrame, motions: DataFrame, n: int) -> DataFrame:
    """The pairs (pair, x, y, z, va, vb) with the second grid moved by the result of ``align``."""
    seconds = pairs.select(F.col("pair").alias("map"), *AXES, F.coalesce(F.col("vb").cast("double"), F.lit(0.0)).alias("v"))
    turned = moved(seconds, motions.select(F.col("pair").alias("map"), F.lit(0).alias("t"), "r", "shift"), n)
    return pairs.select("pair", *AXES, "va").join(turned.select(F.col("map").alias("pair"), *AXES, F.col("v").alias("vb")), ["pair", *AXES])
