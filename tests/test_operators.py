"""Invariants and numpy twins of the operators that SQL cannot check."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, confusion, ensemble, exports, filters, gmm, joins, landscape, latent, ordered, populations, resample, setops, volumes
from simplexa.plans import fixtures as fx
from simplexa.sources import formats


@pytest.fixture(scope="module")
def prot(spark, sf001):
    return fx.prot_a(spark, sf001).cache()


@pytest.fixture(scope="module")
def both(spark, sf001):
    return joins.two_experts(fx.prot_a(spark, sf001), fx.prot_b(spark, sf001)).cache()


def test_soft_correction_equals_soft_mean(prot):
    for r in populations.corrected(prot, 3).collect():
        assert r.corrected_soft == pytest.approx(r.observed_soft, abs=1e-9)


def test_confusion_rows_sum_to_one(prot, spark):
    for m in (confusion.soft_posterior_confusion(prot, 3), confusion.analytical_multiclass(spark, confusion.moments_local(prot, "hard", "posterior", 3), 3, 2000)):
        assert all(r.s == pytest.approx(1) for r in m.groupBy("i").agg(F.sum("value").alias("s")).collect())
    assert np.allclose(confusion.analytical_pairwise(confusion.moments_local(prot, "hard", "posterior", 3), 3).sum(1), 1)


def test_small_class_gives_nan(spark):
    stats = {0: (5, np.zeros(2), np.eye(2)), 1: (50, np.array([0.2, 0.8]), np.eye(2) * 0.01)}
    assert np.isnan(confusion.analytical_pairwise(stats, 2)[0]).all()
    m = {(r.i, r.j): r.value for r in confusion.analytical_multiclass(spark, stats, 2, 500).collect()}
    assert math.isnan(m[0, 0]) and m[1, 0] + m[1, 1] == pytest.approx(1)


def test_effective_n_sums_to_rows(prot):
    n = prot.count()
    for r in populations.effective_n(prot, 3, [1, 3, 9]).groupBy("beta").agg(F.sum("effective_n").alias("s")).collect():
        assert r.s == pytest.approx(n)


def test_alr_round_trip(prot):
    p = sx.inverse_alr(sx.alr(F.col("posterior"), 3), 3)
    assert prot.agg(F.max(sx.distance(p, F.col("posterior")))).first()[0] < 1e-5


def test_divergence_bounds(both):
    j, k, h = both.agg(F.max(sx.js(F.col("p_a"), F.col("p_b"))), F.min(sx.kl(F.col("p_a"), F.col("p_b"))), F.max(sx.normalised_entropy(F.col("p_a"), 3))).first()
    assert 0 <= j <= math.log(2) and k >= -1e-12 and h <= 1 + 1e-12


def test_pools_at_the_ends(both):
    for pool in (sx.linear_pool, sx.log_pool):
        one, zero = both.agg(F.max(sx.distance(pool(F.col("p_a"), F.col("p_b"), F.lit(1.0)), F.col("p_a"))), F.max(sx.distance(pool(F.col("p_a"), F.col("p_b"), F.lit(0.0)), F.col("p_b")))).first()
        assert one < 1e-9 and zero < 1e-9


def test_temperature_meets_target(both):
    target = both.agg(F.avg(sx.entropy(F.col("p_a")))).first()[0]
    t = ensemble.temperature(both, target, posterior="p_b", xtol=1e-4)
    assert ensemble.mean_entropies(both, [t], "p_b")[0] == pytest.approx(target, abs=1e-4)


@pytest.mark.parametrize("v", [[0.9, 0.4, -0.2], [0.2, 0.3, 0.5], [5.0, -1.0, 0.0], [float("nan"), 0.0, 1.0]])
def test_simplex_projection(v):
    p = populations.project_to_simplex(np.array(v))
    assert p.sum() == pytest.approx(1) and (p >= 0).all() and np.allclose(populations.project_to_simplex(p), p)


def test_sanitise():
    c = populations.sanitise(np.array([[np.nan, 1], [2, 2]]))
    assert np.allclose(c, [[1, 0], [0.5, 0.5]])


def test_hungarian_against_permutations():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        cost = rng.integers(0, 9, (n, n)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(cost[i, j] for i, j in enumerate(joins.hungarian(cost))) == best


def test_agreement_invariant_to_labels(both):
    t = both.withColumn("q", (F.col("hard_b") + 1) % 3)
    assert agreement.ari(both, "hard_a", "hard_b").first().ari == pytest.approx(agreement.ari(t, "hard_a", "q").first().ari)
    a = agreement.ami(agreement.contingency_local(both, "hard_a", "hard_b"))
    assert a == pytest.approx(agreement.ami(agreement.contingency_local(t, "hard_a", "q")))
    assert agreement.ami(np.diag([5.0, 7, 9])) == pytest.approx(1)
    m, order = agreement.hungarian_confusion(t, "hard_a", "q")
    assert order == [1, 2, 0] and np.trace(m) == max(np.trace(m[:, list(p)]) for p in itertools.permutations(range(3)))


def test_expected_mutual_information_by_simulation():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    table = lambda y: np.array([[((a == i) & (y == j)).sum() for j in range(4)] for i in range(3)], float)
    assert abs(np.mean([agreement.ami(table(rng.permutation(b))) for _ in range(200)])) < 0.02


def test_threshold_counts_fall(prot):
    n = [r.n_particles_pass for r in agreement.threshold_totals(prot, [0.3, 0.5, 0.7, 0.9]).orderBy("threshold").collect()]
    assert n == sorted(n, reverse=True)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(10, 1, (200, 2))])
    rows = [(i, int(i >= 300), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "uid long, hard int, x array<double>").cache(), x


def numpy_em(x, w, m, c, reg, tol, steps):
    last = -np.inf
    for _ in range(steps):
        l = np.stack([np.log(w[k]) - 0.5 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(c[k])[1] + np.einsum("ni,ij,nj->n", x - m[k], np.linalg.inv(c[k]), x - m[k])) for k in range(len(w))], 1)
        s = np.logaddexp.reduce(l, axis=1)
        r = np.exp(l - s[:, None])
        n = r.sum(0)
        w, m = n / n.sum(), (r.T @ x) / n[:, None]
        c = np.array([(r[:, k, None] * x).T @ x / n[k] - np.outer(m[k], m[k]) + reg * np.eye(x.shape[1]) for k in range(len(w))])
        if abs(s.mean() - last) < tol:
            break
        last = s.mean()
    return w, m, c


def test_em_against_numpy(blobs):
    df, x = blobs
    start = gmm.Mixture(np.array([0.5, 0.5]), np.array([[1.0, 0], [7, 8]]), np.array([np.eye(2) * 4, np.eye(2) * 4]))
    f = gmm.fit(df, "x", 2, 2, init=start)
    w, m, c = numpy_em(x, start.weights, start.means, start.covs, 1e-6, 1e-5, 500)
    assert np.allclose(f.model.weights, w, atol=1e-6) and np.allclose(f.model.means, m, atol=1e-5) and np.allclose(f.model.covs, c, atol=1e-5)
    scored = gmm.predict(df, f.model)
    assert agreement.ari(scored, "hard", "label").first().ari == pytest.approx(1)  # positive control
    assert gmm.best_k(gmm.bic_sweep(df, "x", 2, range(1, 4), max_iter=30)) == 2
    assert set(gmm.diagnostics(f)) >= {"bic", "aic", "cond"}


def test_continuity_and_repetition(blobs):
    df, _ = blobs
    assert gmm.continuity(df.withColumn("a", F.get("x", F.lit(0))), "a")["discrete"]
    rep = gmm.repetition(df, "x", 2, 2, range(2), init="hard", max_iter=10)
    assert all(sum(r["weights"]) == pytest.approx(1) for r in rep)


def test_sampled_confusion(spark):
    w, m, c = np.array([0.7, 0.3]), np.array([[0.0], [2.0]]), np.ones((2, 1, 1))
    got = {(r.i, r.j): r.value for r in confusion.sampled_confusion(spark, w, m, c, 20000, use_weights=False).collect()}
    assert got[0, 1] == pytest.approx(0.5 - 0.5 * math.erf(1 / math.sqrt(2)), abs=0.01)
    assert confusion.bhattacharyya(m[0], c[0], m[1], c[1]) == pytest.approx(0.5) == pytest.approx(confusion.bhattacharyya_pinv(m[0], c[0], m[1], c[1]))


def test_bootstrap_covers(prot):
    ci = {(r.kind, r["class"]): r for r in resample.population_ci(prot, 3, 60).collect()}
    for r in populations.observed(prot, 3).collect():
        assert ci["hard", r["class"]].lo <= r.fraction <= ci["hard", r["class"]].hi
    n = prot.count()
    p = [r.fraction for r in populations.observed(prot, 3).orderBy("class").collect()]
    assert ci["hard", 0].std == pytest.approx(math.sqrt(p[0] * (1 - p[0]) / n), rel=0.35)


def test_latent_family(spark, sf001):
    df = fx.latent(spark, sf001).cache()
    z = np.array([r.z for r in df.orderBy("uid").collect()])
    scored, axes, share, mean = latent.pca(df, "z", 4, 2)
    u = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(np.abs(axes), np.abs(u[2][:2]), atol=1e-8) and np.allclose(share, (u[1] ** 2 / (u[1] ** 2).sum())[:2])
    a, b = z[:, :2] - z[:, :2].mean(0), z[:, 2:] - z[:, 2:].mean(0)
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    t = df.select(F.slice("z", 1, 2).alias("a"), F.slice("z", 3, 2).alias("b"))
    assert np.allclose(latent.canonical_correlations(t, "a", 2, "b", 2, 0.0), np.linalg.svd(qa.T @ qb, compute_uv=False), atol=1e-8)
    s, m, sc = latent.standardise(df, "z", 4)
    assert np.allclose(sc, z.std(0)) and np.allclose(latent.unscale((z - m) / sc, m, sc), z)
    rec = latent.separability(df, "z", 4).first()
    assert 0 <= rec.balanced_accuracy <= 1


def test_lda_separates(blobs):
    assert latent.separability(blobs[0], "x", 2).first().balanced_accuracy == pytest.approx(1)
    t = latent.centroid_axis(blobs[0], "x", 2, 0, 1)
    means = {r.hard: r.m for r in t.groupBy("hard").agg(F.avg("t").alias("m")).collect()}
    assert means[0] == pytest.approx(0) and means[1] == pytest.approx(1)


def test_silhouette_against_numpy(blobs):
    df, x = blobs
    y = (np.arange(len(x)) >= 300).astype(int)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a = np.array([d[i, (y == y[i]) & (np.arange(len(x)) != i)].mean() for i in range(len(x))])
    b = np.array([d[i, y != y[i]].mean() for i in range(len(x))])
    assert agreement.silhouette(df, "x", "hard", 1000).first()[0] == pytest.approx(np.mean((b - a) / np.maximum(a, b)))


def test_landscape(blobs):
    df, x = blobs
    placed, info = landscape.landscape(df, "x", 2, nx=40, ny=40)
    assert placed.select("basin").distinct().count() == 2 == len(info["bottoms"])
    assert agreement.ari(placed, "hard", "basin").first().ari > 0.95
    t = df.withColumn("a", F.get("x", F.lit(0)))
    grid = np.linspace(-5, 15, 200)
    h = x[:, 0].std(ddof=1) * len(x) ** (-0.2)
    want = np.exp(-0.5 * ((grid[:, None] - x[:, 0]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(landscape.density_1d(t, "a", grid), want, rtol=1e-3, atol=1e-9)
    assert len(landscape.basins_1d(landscape.free_energy(want), grid)) == 2
    lo, mid, hi = landscape.band(t, "a", grid, 20)
    assert (lo <= hi).all()


def test_flood():
    f = np.array([[0.0, 3, 1], [3, 3, 3], [0.5, 3, 2]])
    labels, bottoms, met = landscape.flood(f, 0.1)
    assert len(bottoms) == 4 and met == sorted(met, reverse=True)
    assert len(landscape.flood(f, 10)[1]) == 1
    counts = [n for _, n in landscape.basin_counts(f, [0.1, 1.5, 2.2, 10])]
    assert counts == sorted(counts, reverse=True) and counts[0] == 4 and counts[-1] == 1


def test_ordered(spark):
    grid = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 1.0, 2.0, 5.0, 4.0, 4.0, 6.0])], "x int, v double")
    assert [(r.x, r.kind) for r in ordered.turning_points(grid, "x", "v").orderBy("x").collect()] == [(2, "min"), (4, "max"), (6, "min")]
    curve = spark.createDataFrame([(0.0, 1.0), (1.0, 0.8), (2.0, 0.2)], "f double, c double")
    assert ordered.first_below(curve, "f", "c", 0.5).first()[0] == pytest.approx(1.5)
    halves = ordered.split_half(spark.range(1000).withColumnRenamed("id", "uid"))
    assert halves.where("half = 0").count() == 500
    assert ordered.ecdf_gap(spark.createDataFrame([(float(i),) for i in range(101)], "v double"), "v").first().gap < 0.02


def test_filters_and_sets(spark, prot):
    assert filters.class_split(5, 2) == ([2, 3, 4], [0, 1])
    t = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], "uid long, a double, b double")
    assert filters.drop_constant(t, ["a", "b"]).columns == ["uid", "b"]
    with pytest.raises(ValueError):
        setops.stack({"x": t, "y": t})
    assert joins.covering(t, t.select("uid")).count() == 2 and joins.covering(t, t.limit(1).select("uid")) is None
    rows = spark.range(50, numPartitions=5).withColumnRenamed("id", "row_id")
    got = sorted((r.row_id, r.position) for r in setops.positions(rows.where("row_id % 3 = 0")).collect())
    assert got == [(3 * i, i) for i in range(17)]
    assert setops.rebase(spark.createDataFrame([(2,)], "row_id long"), spark.createDataFrame([(2, 77)], "position long, row_id long")).first()[0] == 77


def test_volumes():
    rng = np.random.default_rng(0)
    v = rng.random((8, 8, 8))
    assert np.allclose(volumes.shells(v, v)["fsc"], 1)
    assert np.allclose(volumes.shells(v, v, whole=True)["fsc"], 1) and len(volumes.shells(v, v, whole=True)) == 4
    # the two ways of counting shells differ only in which coefficients meet
    w = rng.random((8, 8, 8))
    f, g, at = np.fft.fftn(v), np.fft.fftn(w), np.fft.fftfreq(8) * 8
    for whole, part in ((False, np.rint), (True, np.floor)):
        cells = [c for c in np.ndindex(8, 8, 8) if part(np.sqrt(sum(at[i] ** 2 for i in c))) == 2]
        num = sum((f[c] * np.conj(g[c])).real for c in cells)
        den = np.sqrt(sum(abs(f[c]) ** 2 for c in cells) * sum(abs(g[c]) ** 2 for c in cells))
        assert volumes.shells(v, w, whole=whole)["fsc"][2] == pytest.approx(num / den)
    m = np.zeros((7, 7, 7), bool)
    m[1, 1, 1] = m[4:6, 4:6, 4:6] = True
    assert volumes.largest_component(m).sum() == 8 and volumes.dilate(m).sum() > m.sum() and volumes.soft_edge(m, 1.0).max() == 1


def test_volume_frames(spark, sf001):
    v = fx.voxels(spark, sf001).cache()
    assert volumes.correlation(v, "va", "va").first().cc == pytest.approx(1)
    curve = volumes.fsc(v.withColumn("pair", F.lit("p")).withColumn("vb", F.col("va")))
    assert curve.agg(F.min("fsc")).first()[0] == pytest.approx(1)
    maps = v.select("x", "y", "z", F.lit("a").alias("map"), F.col("va").alias("v"))
    assert volumes.focus_masks(maps, 0.3).agg(F.max("w")).first()[0] == pytest.approx(1)


def test_exports(spark, prot, tmp_path):
    w = prot.withColumn("class", F.col("hard")).withColumn("alpha", F.lit(2.0).cast("float"))
    exports.subset(w.select("uid", "class"), prot, f"{tmp_path}/out")
    assert sum(formats.read_cs(spark, f"{tmp_path}/out/{c}/main").count() for c in range(3)) == prot.count()
    assert exports.particle_list(w, "hard", F.col("alpha")).first()["class"].startswith("P")
    assert exports.overwrite_weight(w, "hard", "alpha").schema["alpha"].dataType.typeName() == "float"
    flags = exports.verdicts(spark.createDataFrame([(0.5, 0.2)], "last_corr double, gap double")).first()
    assert flags.unstable and flags.overconfident
    assert exports.json_lines(spark.createDataFrame([(1, 2)], "a int, _b int")).first().value == '{"a":1}'


def test_referee(both):
    f = both.select("uid", F.col("p_a").alias("posterior"), F.col("hard_a").alias("hard"))
    ref = both.select("uid", F.col("hard_b").alias("label"), F.col("p_b").alias("resp"))
    m = agreement.referee_metrics({"a": f}, ref)[0]
    assert 0 < m["ari"] <= 1 and 0 < m["agreement"] <= 1
    out = ensemble.export_weights(both, 0.5, 2.0, 3, 3)
    assert out.count() == both.count()


def test_mode_count(spark):
    """Separate clouds are modes of their own; centres are fixed points further apart than the width; no rows, no modes."""
    from simplexa.operators import modes

    rng = np.random.default_rng(3)
    clouds = [rng.normal(c, 0.3, (200, 2)) for c in ((0, 0), (8, 0), (0, 9), (9, 9), (20, 4))]
    rows = [(i, z.tolist()) for i, z in enumerate(np.concatenate(clouds))]
    df = spark.createDataFrame([*rows, (9999, None)], "uid long, z array<double>")
    got = modes.mode_count(df, "z").first()
    assert (got.modes, got.sampled) == (5, 1000) and 0 < got.bandwidth < 4
    x = clouds[0]
    assert len(modes.mean_shift(x, 1.0)) == 1
    width = modes.bandwidth(x)
    centres = modes.mean_shift(x, width)
    for i, c in enumerate(centres):
        assert np.linalg.norm(x[np.linalg.norm(x - c, axis=1) <= width].mean(0) - c) <= 2e-3 * width
        assert all(np.linalg.norm(c - o) > width for o in centres[:i])
    assert modes.mode_count(df.where("uid < 0"), "z").first().modes == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "uid long, z array<double>")
    assert modes.mode_count(same, "z").first().modes == 1


def test_singular_covariance_by_pseudo_inverse(spark):
    """A component on a line: its draws stay on it, and its density is the distance alone (as numpy has it)."""
    w, m = np.array([0.5, 0.5]), np.array([[0.0, 0.0], [1.5, 1.0]])
    c = np.array([[[1.0, 1.0], [1.0, 1.0]], [[0.5, 0.1], [0.1, 0.8]]])
    got = {(r.i, r.j): r.value for r in confusion.sampled_confusion(spark, w, m, c, 20_000, use_weights=False).collect()}
    rng = np.random.default_rng(0)
    for i in range(2):
        x = m[i] + rng.normal(size=(20_000, 2)) @ (np.array([[1.0, 1.0], [0.0, 0.0]]) if i == 0 else np.linalg.cholesky(c[1]).T)
        line = -0.5 * np.einsum("ni,ij,nj->n", x - m[0], np.linalg.pinv(c[0]), x - m[0])
        full = -0.5 * np.einsum("ni,ij,nj->n", x - m[1], np.linalg.inv(c[1]), x - m[1]) - np.log(2 * np.pi) - 0.5 * np.log(np.linalg.det(c[1]))
        assert got[i, 1] == pytest.approx(np.mean(full > line), abs=0.02)


def test_exports():
    import simplexa

    assert len(simplexa.__all__) == 18 and all(callable(getattr(simplexa, n)) for n in simplexa.__all__)
    assert set(simplexa.__all__) <= set(dir(simplexa))
    with pytest.raises(AttributeError):
        simplexa.nothing
