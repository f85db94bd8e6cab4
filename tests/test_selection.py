"""Mixtures put to use and the pooled sweep, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.operators import agreement, ensemble, gmm, populations, selection


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 1, 200), ((6, 0), 0.7, 150), ((30, 30), 2, 40))])
    hard = np.repeat([2, 0, 1], [200, 150, 40])
    return x, hard, spark.createDataFrame([(i, v.tolist(), int(h), float(v[0])) for i, (v, h) in enumerate(zip(x, hard, strict=True))], "uid long, x array<double>, hard int, a double").repartition(3)


def test_components_take_the_classes_names(clouds):
    _, hard, df = clouds
    got = {r.uid: r for r in selection.axis_mixture(df, "a", 3, n_init=3).collect()}
    assert np.mean([got[i].label == h for i, h in enumerate(hard)]) > 0.97
    assert all(r.conf == max(r.resp) and int(np.argmax(r.resp)) == r.label and r.confident == (r.conf >= 0.5) for r in got.values())


def test_junk_is_the_farthest_component(clouds):
    _, hard, df = clouds
    got = {r.uid: r.junk for r in selection.junk_filter(df, "x", 2, n=3, n_init=3).collect()}
    assert [got[i] for i in range(390)] == (hard == 1).tolist()


def test_curves_and_quality(clouds):
    x, _, df = clouds
    c = {r["k"]: r for r in selection.curves(df, "x", 2, range(1, 4))}
    assert c[1]["silhouette"] is None and min(c, key=lambda k: c[k]["bic"]) == 3
    f = gmm.fit(df, "x", 2, 3, init="seed", n_init=3)
    q = selection.quality(df, f, "x")
    label = {r.uid: r.label for r in gmm.predict(df, f.model).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    lab, s = np.array([label[i] for i in range(len(x))]), []
    for i in range(len(x)):
        own = (lab == lab[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean(), min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    assert q["silhouette"] == pytest.approx(np.mean(s)) and q["n"] == 390 and q["dim"] == 2 and 0.9 < q["mean_max"] <= 1


def test_sweep_and_export(spark):
    rng = np.random.default_rng(2)
    a = rng.dirichlet((2, 1, 1), 500)
    b = a**4 / (a**4).sum(1, keepdims=True)
    ref = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(i, p.tolist(), q.tolist(), int(r)) for i, (p, q, r) in enumerate(zip(a, b, ref, strict=True))], "uid long, p_a array<double>, p_b array<double>, ref int")
    soft = b ** (1 / 3.0) / (b ** (1 / 3.0)).sum(1, keepdims=True)
    got = {(r.pool, r.lam): r for r in ensemble.ensemble_sweep(df, [0.0, 0.5], 3, 3.0, referee="ref").collect()}
    assert set(got) == {("linear", 0.0), ("linear", 0.5), ("log", 0.0), ("log", 0.5), ("linear_cal", 0.5)}
    for key, p in ((("linear", 0.5), (a + b) / 2), (("linear_cal", 0.5), (a + soft) / 2), (("log", 0.0), b)):
        r, hard = got[key], p.argmax(1)
        pi = np.bincount(hard, minlength=3) / 500
        c = np.array([[p[hard == j, i].sum() for j in range(3)] for i in range(3)])
        want = populations.deconvolve(pi, populations.sanitise(c / c.sum(1, keepdims=True)))
        assert [r[f"hard_{i}"] for i in range(3)] == pytest.approx(pi.tolist()) and [r[f"deconv_{i}"] for i in range(3)] == pytest.approx(want.tolist())
        counts = np.array([[((ref == i) & (hard == j)).sum() for j in range(3)] for i in range(3)], float)
        assert r.ari == pytest.approx(agreement.ari_of(counts))
    pooled = df.select("ref", F.lit(1).alias("one"))
    assert agreement.ari_of(np.array([[500.0]])) == 1.0 == agreement.ari(pooled, "one", "one").first().ari
    rows, table, info = ensemble.ensemble_export(df, 0.5, 3, 3.0)
    t = sorted(table.collect())
    pi = np.bincount(((a + soft) / 2).argmax(1), minlength=3) / 500
    assert [r.ensemble_hard for r in t] == pytest.approx(pi.tolist()) and sum(r.deconvolved for r in t) == pytest.approx(1) and sum(r.gmm_hard for r in t) == pytest.approx(1)
    assert rows.count() == 500 and info["temperature"] == 3.0 and rows.where(F.abs(F.array_max("resp") - F.col("weight")) > 1e-12).count() == 0
