"""Queries over fitted models, ranks, densities and files; closed forms have oracles."""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, confusion, density, em, ensemble, exports, gmm, kernel, landscape, latent, ordered, resample, selection
from simplexa.plans import fixtures as fx
from simplexa.plans.catalog import ALR, BOTH, K, _alr, _both, _cells, _fit, query
from simplexa.session import Written
from simplexa.sources import formats


def _z(spark, sf):
    return fx.latent(spark, sf).withColumns({f"z{i + 1}": F.get("z", F.lit(i)) for i in range(4)})


def _pc(spark, sf):
    return latent.oriented_pca(latent.standardise(fx.latent(spark, sf), "z", 4)[0], "x", 4)


# --- halves, folds, ranks --------------------------------------------------------------


@query("select 0::int as half, ceil(count(*)/2.0)::bigint as n from fx_latent union all select 1::int, floor(count(*)/2.0)::bigint from fx_latent", "fx_latent")
def alternating_halves(spark, sf):
    return ordered.split_half(fx.latent(spark, sf)).groupBy("half").agg(F.count("*").alias("n"))


@query("select hard, f::int as fold, (count(*)//5 + (f < count(*)%5)::int)::bigint as n from fx_latent, range(5) r(f) group by 1, 2, f", "fx_latent")
def stratified_folds(spark, sf):
    return ordered.folds(fx.latent(spark, sf), 5, label="hard").groupBy("hard", "fold").agg(F.count("*").alias("n"))


# --- closed forms of class Gaussians ---------------------------------------------------

#: count, mean and covariance of the log ratios of each class
G2 = f", g as (select hard as c, avg(x[1]) as m0, avg(x[2]) as m1, var_samp(x[1]) as a, covar_samp(x[1],x[2]) as b, var_samp(x[2]) as d from {ALR} group by 1) "
PAIR = G2 + ", p as (select p.c as i, q.c as j, p.m0-q.m0 as u, p.m1-q.m1 as v, (p.a+q.a)/2 as a, (p.b+q.b)/2 as b, (p.d+q.d)/2 as d, p.a*p.d-p.b*p.b as d1, q.a*q.d-q.b*q.b as d2, p.a+p.d as t1, q.a+q.d as t2 from g p, g q where p.c<>q.c) "
BHATT = "((d*u*u-2*b*u*v+a*v*v)/(a*d-b*b))/8 + 0.5*ln((a*d-b*b)/sqrt(d1*d2))"


def _gaussians(spark, sf):
    stats = confusion.moments_local(_alr(spark, sf), "hard", "x", 2)
    return np.array([stats[c][1] for c in range(K)]), np.array([stats[c][2] for c in range(K)])


@query(PAIR + f"select i, j, round(exp(-({BHATT})), 6) as value from p union all select c, c, 0.0 from g", "fx_prot_a")
def class_overlaps(spark, sf):
    return _cells(spark, confusion.overlap(confusion.pairwise(*_gaussians(spark, sf))))


@query(PAIR + f"select i, j, round({BHATT}, 6) as value from p union all select c, c, 0.0 from g", "fx_prot_a")
def class_distances_pinv(spark, sf):
    return _cells(spark, confusion.pairwise(*_gaussians(spark, sf), confusion.bhattacharyya_pinv))


@query(PAIR + "select round(min(s), 6) as smallest, round(avg(s), 6) as mean from (select sqrt(u*u+v*v)/sqrt(0.5*(t1+t2)/2) as s from p where i<j)", "fx_prot_a")
def class_separation(spark, sf):
    s = confusion.separation(*_gaussians(spark, sf))
    return spark.createDataFrame([(s["min"], s["mean"])], "smallest double, mean double")


@query(
    G2 + "select c as class, round(2*sqrt((a+d)/2+r), 6) as major, round(2*sqrt((a+d)/2-r), 6) as minor, round(abs(cos(0.5*atan2(2*b,a-d))), 6) as along from (select *, sqrt((a-d)*(a-d)/4+b*b) as r from g)", "fx_prot_a"
)  # the axis has no direction, so its cosine is compared
def class_ellipses(spark, sf):
    rows = []
    for c, cov in enumerate(_gaussians(spark, sf)[1]):
        major, minor, angle = latent.ellipse(cov)
        rows.append((c, major, minor, abs(float(np.cos(np.radians(angle))))))
    return spark.createDataFrame(rows, "class int, major double, minor double, along double")


@query(
    G2
    + ", w as (select hard as c, count(*)/(select count(*) from fx_prot_a)::double as w from fx_prot_a group by 1), j as (select uid, x, c, ln(w)-ln(2*pi())-0.5*ln(a*d-b*b)-0.5*(d*(x[1]-m0)*(x[1]-m0)-2*b*(x[1]-m0)*(x[2]-m1)+a*(x[2]-m1)*(x[2]-m1))/(a*d-b*b) as l from "
    + ALR
    + ", (select c, w, m0, m1, a+1e-6 as a, b, d+1e-6 as d from g join w using (c))), s as (select uid, max(l) as top from j group by 1), n as (select uid, top+ln(sum(exp(l-top))) as ll from j join s using (uid) group by uid, top), r as (select uid, x, c, exp(l-ll) as r from j join n using (uid)) "
    "select c as component, round(sum(r)/(select count(*) from n), 6) as weight, round(sum(r*x[1])/sum(r), 6) as mean0, round(sum(r*x[2])/sum(r), 6) as mean1, round(sum(r*x[1]*x[1])/sum(r)-pow(sum(r*x[1])/sum(r),2)+1e-6, 6) as var0, (select round(avg(ll), 6) from n) as loglik from r group by c",
    "fx_prot_a",
)
def em_step(spark, sf):
    """One step of EM from the classes' own weights, means and covariances."""
    t = _alr(spark, sf)
    m = gmm._from_hard(t, "x", 2, K, "hard", 1e-6)
    s = em.expectation(em.columns(t, "x", 2), {0: (m.weights, m.means, m.covs)}, 2)[0]
    w, mean, cov = em.maximisation(s, K, 2, 1e-6)
    return spark.createDataFrame([(c, float(w[c]), float(mean[c, 0]), float(mean[c, 1]), float(cov[c, 0, 0]), float(s[1] / s[0])) for c in range(K)], "component int, weight double, mean0 double, mean1 double, var0 double, loglik double")


R12 = "(select corr(z[1],z[3]) as p, corr(z[2],z[3]) as q, corr(z[1],z[2]) as r from fx_latent)"


@query(f"select round(sqrt((p*p+q*q-2*p*q*r)/(1-r*r)), 6) as corr from {R12}", "fx_latent")
def canonical_correlation_qr(spark, sf):
    t = fx.latent(spark, sf).select(F.slice("z", 1, 2).alias("a"), F.slice("z", 3, 1).alias("b"))
    return spark.createDataFrame([(float(latent.canonical_correlations_qr(t, "a", 2, "b", 1)[0]),)], "corr double")


@query(" union all ".join(f"select 'z{i}' as axis, round(avg(z[{i}]), 6) as mean, round(stddev_pop(z[{i}]), 6) as sd from fx_latent" for i in (1, 2)), "fx_latent")
def unscaled_moments(spark, sf):
    """Standardised moments, back in latent units."""
    t, mean, scale = latent.standardise(fx.latent(spark, sf), "z", 4)
    _, m, cov = latent.mean_cov(t, "x", 4, ddof=0)
    back = latent.unscale(m, mean, scale)
    return spark.createDataFrame([(f"z{i + 1}", float(back[i]), float(np.sqrt(cov[i, i]) * scale[i])) for i in range(2)], "axis string, mean double, sd double")


@query(
    ", f as (" + " union all ".join(f"select 'z{i}' as axis, pow(max(m) filter (hard=1)-max(m) filter (hard=2),2)/(sum(v)) as f from (select hard, avg(z[{i}]) as m, var_pop(z[{i}]) as v from fx_latent where hard in (1,2) group by 1)" for i in (1, 2, 3, 4)) + ") select arg_max(axis, f) as axis from f",
    "fx_latent",
)
def best_fisher_axis(spark, sf):
    return spark.createDataFrame([(latent.best_axis(_z(spark, sf), 1, 2, ["z1", "z2", "z3", "z4"]),)], "axis string")


@query(
    ", s as (select hard as c, count(*)/(select count(*) from fx_latent)::double as w, avg(z[1]) as m, var_samp(z[1]) as v from fx_latent group by 1) select c as component, g::int as point, round(w*exp(-0.5*pow(-0.5+g/10.0::double-m,2)/v)/sqrt(2*pi()*v), 6) as density from s, range(11) t(g)",
    "fx_latent",
)
def class_marginal_curves(spark, sf):
    stats = confusion.moments_local(fx.latent(spark, sf), "hard", "z", 1)
    n = sum(s[0] for s in stats.values())
    order = sorted(stats)
    grid = -0.5 + np.arange(11) / 10
    curves = landscape.marginal_curves(np.array([stats[c][0] / n for c in order]), np.array([stats[c][1][0] for c in order]), np.array([stats[c][2][0, 0] for c in order]), grid)
    return spark.createDataFrame([(c, g, float(curves[i, g])) for i, c in enumerate(order) for g in range(len(grid))], "component int, point int, density double")


@query(
    BOTH + ", c as (select hard_a as i, hard_b as j, count(*) as n from ab group by 1,2), b as (select i, arg_max(j, n*1000-j) as basin from c group by 1) select basin, count(*) as recommended_k, list(i order by i)::varchar as classes from b group by 1",
    "fx_prot_a", "fx_prot_b",
)
def substates(spark, sf):
    occupancy = confusion.hard_confusion(_both(spark, sf), "hard_a", "hard_b", K).select("i", "j", "value")
    plan = landscape.substate_plan(occupancy)
    return plan.select("basin", "recommended_k", F.concat(F.lit("["), F.array_join(F.col("classes").cast("array<string>"), ", "), F.lit("]")).alias("classes"))


# --- files -----------------------------------------------------------------------------


def _local(written: Written) -> str:
    """Structured files need a folder that executors mount."""
    return written.base.removeprefix("file://").removeprefix("file:")


@query("select hard, count(*) as n, round(sum(posterior[1]), 6) as total, min(uid) as first from fx_prot_a where uid >= 1000 group by 1", "fx_prot_a")
def structured_round_trip(spark, sf):
    """The table as a structured file and back, with a comparison that the scan answers."""
    written = Written(spark, "round-trip")
    formats.write_cs(fx.prot_a(spark, sf), f"{_local(written)}/cs")
    t = formats.read_cs(spark, f"{_local(written)}/cs").where("uid >= 1000")
    rows = t.groupBy("hard").agg(F.count("*").alias("n"), F.sum(F.get("posterior", F.lit(0))).alias("total"), F.min("uid").alias("first")).collect()  # a row a class
    written.drop()
    return spark.createDataFrame([tuple(r) for r in rows], "hard int, n long, total double, first long")


def _by_file(spark, folder):
    """The rows of a structured folder with the name of their file: row numbers count within one."""
    files = [formats.read_cs(spark, f, row_id=True).withColumn("file", F.lit(Path(f).name)) for f in formats.part_files(folder)]
    return functools.reduce(DataFrame.unionByName, files)


@query("select a.hard as class, count(*) as n, round(sum(p.df1), 6) as defocus, 0::bigint as out_of_order from fx_prot_a a join fx_passthrough p using (uid) group by 1", "fx_prot_a", "fx_passthrough")
def subset_with_twin(spark, sf):
    """Classes exported with their passthrough fields; both files of a class hold the same rows in one order."""
    written = Written(spark, "twin")
    own = fx.prot_a(spark, sf)
    counts = exports.subset(own.select("uid", F.col("hard").alias("class")), own.select("uid", "posterior"), f"{_local(written)}/x", twin=fx.passthrough(spark, sf)).collect()
    rows = []
    for r in counts:
        main, twin = (_by_file(spark, f"{_local(written)}/x/{r['class']}/{part}") for part in ("main", "passthrough"))
        both = main.select("file", "row_id", F.col("uid").alias("a")).join(twin.select("file", "row_id", F.col("uid").alias("b"), "df1"), ["file", "row_id"])
        rows.append((r["class"], *both.agg(F.count("*"), F.sum("df1"), F.sum((F.col("a") != F.col("b")).cast("long"))).first()))
    written.drop()
    return spark.createDataFrame(rows, "class int, n long, defocus double, out_of_order long")


# --- fitted, clustered, resampled (compared with plain versions in the tests) --------------


def _clusters(spark, sf):
    t = latent.standardise(fx.latent(spark, sf), "z", 4)[0]
    least = max(5, min(t.count(), 40_000) // 20)  # 2,000 at most, which 40,000 rows have
    return density.clusters(t, "x", min_cluster_size=least, min_samples=max(3, least // 40))


@query()
def density_clusters(spark, sf):
    return _clusters(spark, sf)


@query()
def density_agreement(spark, sf):
    """Agreement of density clusters with the given classes, their number and the share of noise."""
    t = _clusters(spark, sf).join(fx.latent(spark, sf).select("uid", "hard"), "uid")
    counts = agreement.contingency_local(t, "hard", "label")
    one = t.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"), F.avg((F.col("label") == -1).cast("double")).alias("noise")).first()
    return spark.createDataFrame([(agreement.ari_of(counts), agreement.ami(counts), one.k, one.noise)], "ari double, ami double, clusters long, noise double")


@query()
def held_out_models(spark, sf):
    """Held-out log density of mixtures of 1 to 4 components and of kernel densities."""
    t = latent.standardise(fx.latent(spark, sf), "z", 4)[0].select("uid", "x")
    rows = [(f"mixture_{r['k']}", r["held_out"]) for r in gmm.held_out(t, "x", 4, range(1, 5), tol=1e-4)]
    rows += [(f"kernel_{r['bandwidth']:g}", r["held_out"]) for r in kernel.held_out(t, "x", 4)]
    return spark.createDataFrame(rows, "model string, held_out double")


@query()
def bootstrap_parameters(spark, sf):
    """Thirty refits to resampled rows: mean and deviation of weights and means."""
    t, f = _fit(spark, sf)
    s = resample.refit(t, "x", 2, f.model, 30)
    w, m = s["weights"], s["means"]
    return spark.createDataFrame([(c, float(w[:, c].mean()), float(w[:, c].std()), float(m[:, c, 0].mean()), float(m[:, c, 0].std()), float(m[:, c, 1].mean()), float(m[:, c, 1].std())) for c in range(K)], "component int, weight double, weight_sd double, mean0 double, mean0_sd double, mean1 double, mean1_sd double")


@query()
def bootstrap_confusion(spark, sf):
    """Analytic pairwise confusion over twenty replicates."""
    s = resample.class_moments_bootstrap(fx.prot_a(spark, sf), K, 20)
    return spark.createDataFrame([(i, j, float(s[:, i, j].mean()), float(s[:, i, j].std())) for i in range(K) for j in range(K)], "i int, j int, mean double, sd double")


@query()
def selection_curves(spark, sf):
    t = latent.standardise(fx.latent(spark, sf), "z", 4)[0].select("uid", "x")
    rows = [(r["k"], r["bic"], r["silhouette"]) for r in selection.curves(t, "x", 4, range(2, 6), n_init=1, tol=1e-4)]
    return spark.createDataFrame(rows, "k int, bic double, silhouette double")


@query()
def axis_mixture(spark, sf):
    t = selection.axis_mixture(_pc(spark, sf).select("uid", "hard", "pc1"), "pc1", 3, n_init=2)
    return t.groupBy("label", "confident").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("pc1").alias("mean"))


@query()
def junk_rows(spark, sf):
    return selection.junk_filter(fx.latent(spark, sf), "z", 4).groupBy("label", "junk").agg(F.count("*").alias("n"), F.avg(sx.norm(F.col("z"))).alias("mean_norm"))


@query()
def ensemble_populations(spark, sf):
    return ensemble.ensemble_export(_both(spark, sf), 0.5, K)[1]


@query()
def back_projected_marginals(spark, sf):
    """Mean and deviation of each probability over draws from the fitted mixture."""
    t = gmm.back_projected(spark, _fit(spark, sf)[1].model, 200_000, K)
    return t.groupBy("component").agg(F.count("*").alias("n"), *[a(F.get("posterior", F.lit(i))).alias(f"{n}{i}") for i in range(K) for n, a in (("mean", F.avg), ("sd", F.stddev_pop))])


@query()
def wells_1d(spark, sf):
    t = _pc(spark, sf)
    grid = np.linspace(-3, 3, 400)
    wells = landscape.basins_1d(landscape.free_energy_1d(t, "pc1", grid, 0.5), grid, 0.05)
    return spark.createDataFrame([(i, w["position"], w["depth"], w["barrier_right"]) for i, w in enumerate(wells)], "well int, position double, depth double, barrier_right double")


@query()
def free_energy_band(spark, sf):
    grid = np.linspace(-2, 2, 50)
    low, mid, high = landscape.band(_pc(spark, sf), "pc1", grid, 200)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(grid, low, mid, high, strict=True)], "x double, p05 double, p50 double, p95 double")


@query()
def class_barriers(spark, sf):
    """Barrier and overlap of two classes along the axis between their centres."""
    t = latent.centroid_axis(fx.latent(spark, sf), "z", 4, 1, 2, name="axis")
    at = {r.hard: r.m for r in t.groupBy("hard").agg(F.avg("axis").alias("m")).collect()}
    b = landscape.barrier_between(t, "axis", at[1], at[2])
    return spark.createDataFrame([(b["barrier_from_a"], b["barrier_from_b"], landscape.class_overlap(t, "axis", "hard", 1, 2))], "barrier_from_a double, barrier_from_b double, overlap double")


@query()
def axis_continuity(spark, sf):
    r = gmm.continuity(_pc(spark, sf), "pc1")
    return spark.createDataFrame([(r["delta_bic"], r["separation"], r["min_weight"], r["discrete"])], "delta_bic double, separation double, min_weight double, discrete boolean")


@query()
def overconfidence(spark, sf):
    t, f = _fit(spark, sf)
    r = gmm.overconfident(gmm.predict(t, f.model), f.model)
    return spark.createDataFrame([(r["separation"], r["mean_max"], r["expected"], r["flag"])], "separation double, mean_max double, expected double, flag boolean")


@query()
def referee_table(spark, sf):
    """Agreement of both jobs' labels with a mixture fitted to the first's log ratios."""
    t, f = _fit(spark, sf)
    referee = gmm.predict(t, f.model)
    rows = agreement.referee_metrics({"a": fx.prot_a(spark, sf), "b": fx.prot_b(spark, sf)}, referee)
    return spark.createDataFrame([(r["labelling"], r["ari"], r["ami"], r["mean_max"], r["agreement"]) for r in rows], "labelling string, ari double, ami double, mean_max double, agreement double")
