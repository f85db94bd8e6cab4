"""Operators that share passes, ranges or cells, against numpy on the whole data."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import confusion, em, gmm, kernel, latent, ordered, quantiles, ranks, resample


def column(spark, values, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "uid long, v double").repartition(parts)


# --- quantiles ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["normal", "ties", "spread", "one", "two"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(0)
    x = {"normal": rng.normal(size=3001), "ties": rng.integers(0, 4, 1000).astype(float), "spread": np.concatenate((10.0 ** rng.uniform(-300, 300, 400), [-1e308, 1e308, 5e-324, 0.0])), "one": np.array([3.5]), "two": np.array([1.0, 2.0])}[kind]
    qs = [0.0, 0.1, 0.33, 0.5, 0.66, 0.95, 1.0]
    df = column(spark, [*map(float, x), None, float("nan")])
    assert quantiles.quantiles(df, "v", qs) == pytest.approx(np.quantile(x, qs).tolist(), rel=1e-12)


def test_quantiles_by_group_and_without_rows(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=2000), rng.integers(0, 5, 2000)
    df = spark.createDataFrame([(float(a), int(b) if b else None) for a, b in zip(x, g, strict=True)], "v double, g int")
    got = quantiles.by_group(df, "v", [0.25, 0.5], "g")
    for b in range(5):
        assert got[b or None] == pytest.approx(np.quantile(x[g == b], [0.25, 0.5]).tolist())
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == [None]


# --- shared passes -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal((0, 0), 1, (300, 2)), rng.normal((4, 2), (1, 0.5), (200, 2))))
    return x, spark.createDataFrame([(i, v.tolist(), int(i >= 300)) for i, v in enumerate(x)], "uid long, x array<double>, hard int").repartition(3)


START = (np.array([0.5, 0.5]), np.array([[0.0, 0], [3, 3]]), np.array([np.eye(2), np.eye(2)]))


def weighted_em(x, w, weights, means, covs, tol=1e-5, reg=1e-6):
    last = -np.inf
    for it in range(1, 501):
        lj = em.log_joint(x, weights, means, covs)
        top = lj.max(1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(lj - top).sum(1))
        r = np.exp(lj - ll[:, None]) * w[:, None]
        n = r.sum(0)
        means = r.T @ x / n[:, None]
        covs = np.array([(r[:, c, None] * x).T @ x / n[c] - np.outer(means[c], means[c]) + reg * np.eye(2) for c in range(len(n))])
        weights, mean = n / n.sum(), (ll * w).sum() / w.sum()
        if abs(mean - last) < tol:
            return weights, means, covs, it
        last = mean


def test_replicates_are_fitted_at_once(spark, cloud):
    x, df = cloud
    base = gmm.Mixture(*START)
    got = resample.refit(df, "x", 2, base, reps=5)
    for b in range(5):
        w = em.poisson_weights(np.arange(len(x)), [b])[:, 0]
        weights, means, covs, it = weighted_em(x, w, *START)
        assert got["n_iter"][b] == it
        assert np.allclose(got["weights"][b], weights, atol=1e-8) and np.allclose(got["means"][b], means, atol=1e-8) and np.allclose(got["covs"][b], covs, atol=1e-8)
    own = resample.refit(df, "x", 2, base, reps=2, fitter=lambda t: gmm.fit(t, "x", 2, 2, init=base, weight="w"))
    assert own["means"].shape == (2, 2, 2)


def test_sweep_equals_single_fits(spark, cloud):
    _, df = cloud
    sweep = gmm.bic_sweep(df, "x", 2, range(1, 4))
    assert [r["bic"] for r in sweep] == pytest.approx([gmm.fit(df, "x", 2, k, init="seed").bic for k in range(1, 4)])
    assert gmm.best_k(sweep) == 2 and all(r["converged"] for r in sweep)


def test_replicate_sums(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((2, 1, 1), 400)
    df = spark.createDataFrame([(i, int(v.argmax()), v.tolist()) for i, v in enumerate(p)], "uid long, hard int, posterior array<double>").repartition(4)
    got = resample.replicate_populations(df, 3, 40)
    w = em.poisson_weights(np.arange(400), range(40))
    for b in range(40):
        n = np.bincount(p.argmax(1), w[:, b], 3)
        assert np.allclose(got[b, 0], n / n.sum()) and np.allclose(got[b, 1], w[:, b] @ p / w[:, b].sum())
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05)
    pairs = resample.class_moments_bootstrap(df, 3, 3)
    for b in range(3):
        c = np.repeat(np.arange(400), w[:, b].astype(int))
        stats = {k: (len(m), m.mean(0), np.cov(m.T)) for k in range(3) for m in [p[c][p[c].argmax(1) == k]]}
        assert np.allclose(pairs[b], confusion.analytical_pairwise(stats, 3))


# --- ranks -------------------------------------------------------------------------------


def test_permutation_and_folds(spark):
    df = spark.range(1001).select(F.col("id").alias("uid"), (F.col("id") % 7).cast("int").alias("hard"), F.lit("x").alias("range")).repartition(5)
    one = {r.uid: r["rank"] for r in ranks.permutation(df, range_rows=100).collect()}
    again = {r.uid: r["rank"] for r in ranks.permutation(df.repartition(2), range_rows=100).collect()}
    assert one == again and sorted(one.values()) == list(range(1001)) and ranks.permutation(df, range_rows=100).columns == [*df.columns, "rank"]
    assert {r.uid: r["rank"] for r in ranks.permutation(df, range_rows=10_000).collect()} == one  # the same order whatever the ranges
    assert sorted(Counter(r.half for r in ordered.split_half(df).collect()).values()) == [500, 501]
    by = Counter((r.hard, r.fold) for r in ordered.folds(df, 5, label="hard").collect())
    assert len(by) == 35 and all(max(by[c, f] for f in range(5)) - min(by[c, f] for f in range(5)) <= 1 for c in range(7))
    assert ranks.permutation(df.limit(0)).count() == 0


def test_running_sum_by_ranges(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    got = {r.v: r.cum for r in ranks.running(column(spark, map(float, x)), "v", F.lit(1), ranges=7).collect()}
    assert [got[v] for v in sorted(got)] == list(range(1, 501))
    u = (np.sort(x) - x.min()) / (x.max() - x.min())
    assert ordered.ecdf_gap(column(spark, map(float, x)), "v").first().gap == pytest.approx(np.abs(np.arange(1, 501) / 500 - u).max())


# --- densities ---------------------------------------------------------------------------


def test_held_out_kernel_density(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(0, 1, (350, 3)), rng.normal(6, 0.3, (150, 3))))
    x[:20] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, z array<double>").repartition(3)
    train, test = (sorted(r.uid for r in t.collect()) for t in kernel.halves(df))
    assert len(test) == 150 and sorted(train + test) == list(range(500))
    d = ((x[test][:, None] - x[train][None]) ** 2).sum(2)
    for r in kernel.held_out(df, "z", 3, (0.05, 0.2, 1.0), cell_rows=20):
        h = r["bandwidth"]
        e = -d / (2 * h * h)
        top = e.max(1, keepdims=True)
        want = (top[:, 0] + np.log(np.exp(e - top).sum(1))).mean() - math.log(len(train)) - 3 * math.log(h * math.sqrt(2 * math.pi))
        assert r["held_out"] == pytest.approx(want, rel=1e-10)


def test_correlations_by_triangles(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(400, 3))
    b = np.column_stack((a[:, 0] + 0.5 * rng.normal(size=400), rng.normal(size=400)))
    a[:, 2] = a[:, 1] + 1e-9 * rng.normal(size=400)  # nearly singular
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<double>, b array<double>").repartition(40)
    q = lambda m: np.linalg.qr(m - m.mean(0))[0]
    assert np.allclose(latent.canonical_correlations_qr(df, "a", 3, "b", 2), np.linalg.svd(q(a).T @ q(b), compute_uv=False)[:2], atol=1e-5)
    plain = df.select(F.slice("a", 1, 2).alias("a"), "b")
    assert np.allclose(latent.canonical_correlations_qr(plain, "a", 2, "b", 2), latent.canonical_correlations(plain, "a", 2, "b", 2, 0.0), atol=1e-9)


def test_back_projection(spark):
    model = gmm.Mixture(np.array([0.25, 0.75]), np.array([[0.0, 1.0], [2.0, -1.0]]), np.array([[[1.0, 0.3], [0.3, 0.5]], np.eye(2) * 0.2]))
    mean, scale = np.array([0.1, -0.2]), np.array([2.0, 0.5])
    t = gmm.back_projected(spark, model, 40_000, 3, mean=mean, scale=scale)
    share = {r.component: r["count"] / 40_000 for r in t.groupBy("component").count().collect()}
    assert share[0] == pytest.approx(0.25, abs=0.01)
    for c, (n, m, s) in confusion.moments_local(t, "component", "y", 2).items():
        assert np.allclose(m, model.means[c] * scale + mean, atol=0.06) and np.allclose(s, model.covs[c] * np.outer(scale, scale), atol=0.08)
    back = t.select(sx.alr(F.col("posterior"), 3, eps=0.0).alias("b"), "y", F.aggregate("posterior", F.lit(0.0), lambda a, x: a + x).alias("total"))
    worst = back.agg(F.max(F.abs(F.get("b", F.lit(0)) - F.get("y", F.lit(0)))).alias("d"), F.max(F.abs(F.col("total") - 1)).alias("t")).first()
    assert worst.d < 1e-6 and worst.t < 1e-9
