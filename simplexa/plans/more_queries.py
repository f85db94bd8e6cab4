"""Further named queries with oracles, over the same fixtures as ``catalog``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, confusion, exports, filters, joins, landscape, latent, modes, ordered, populations, rigid, setops, volumes
from simplexa.plans import fixtures as fx
from simplexa.plans.catalog import BOTH, DFT, ORACLES, P3, K, _both, query

Z = [f"z[{i}]" for i in (1, 2, 3, 4)]
A3 = "fx_prot_a"


def _z(spark, sf):
    return fx.latent(spark, sf).withColumns({f"z{i + 1}": F.get("z", F.lit(i)) for i in range(4)})


def _means(*columns: str):
    return [F.avg(c).alias(c) for c in columns]


def _average(df, column: str, k: int = K):
    return df.agg(F.count("*").alias("n"), *[F.avg(F.get(column, F.lit(i))).alias(f"p{i}") for i in range(k)])


def _average_sql(vector: str, source: str, k: int = K) -> str:
    return "select count(*) as n, " + ", ".join(f"round(avg({vector}[{i + 1}]), 6) as p{i}" for i in range(k)) + f" from {source}"


# --- filters ---------------------------------------------------------------------------


@query("select (list_position(posterior,list_max(posterior))-1)::int as hard, count(*) as n, round(avg(list_max(posterior)), 6) as mean_max from fx_job_a group by 1", "fx_job_a")
def loaded_posteriors(spark, sf):
    return filters.load_posteriors(fx.job_a(spark, sf)).groupBy("hard").agg(F.count("*").alias("n"), F.avg("max_post").alias("mean_max"))


@query(_average_sql("p", "(select list_transform(posterior[2:4], lambda x: x/list_sum(posterior[2:4])) as p from fx_job_a)"), "fx_job_a")
def renormalised_posteriors(spark, sf):
    return _average(filters.renormalised_protein(fx.job_a(spark, sf), 4, 1), "posterior")


@query("select 'strict' as kind, hard, count(*) as n from fx_prot_a where list_max(posterior)>0.6 group by 2 union all select 'inclusive', hard, count(*) from fx_prot_a where list_max(posterior)>=0.6 group by 2", A3)
def threshold_filters(spark, sf):
    a = fx.prot_a(spark, sf)
    one = lambda kind: filters.above(a, 0.6, inclusive=kind == "inclusive").groupBy(F.lit(kind).alias("kind"), "hard").agg(F.count("*").alias("n"))
    return one("strict").unionByName(one("inclusive"))


@query("select 3::int as columns_left, count(*) as n, round(sum(df1), 6) as total from fx_passthrough", "fx_passthrough")
def constant_columns(spark, sf):
    t = filters.drop_constant(fx.passthrough(spark, sf).withColumn("fixed", F.lit(2.5)), ["alpha", "df1", "fixed"]).drop("df2")
    return t.agg(F.lit(len(t.columns)).alias("columns_left"), F.count("*").alias("n"), F.sum("df1").alias("total"))


@query("select hard, count(*) as n, round(avg(([alpha,df1,df2])[hard+1]), 6) as picked from fx_prot_a join fx_passthrough using (uid) group by 1", A3, "fx_passthrough")
def picked_by_argmax(spark, sf):
    t = fx.prot_a(spark, sf).join(fx.passthrough(spark, sf), "uid").withColumn("fields", F.array("alpha", "df1", "df2"))
    return filters.pick_by_argmax(t, "posterior", picked="fields").groupBy("hard").agg(F.count("*").alias("n"), F.avg("picked").alias("picked"))


@query("select count(*) as n, round(avg(posterior[hard+1]), 6) as shift, sum(hard)::bigint as pose, 0::bigint as split, count(*) as no_size from fx_prot_a", A3)
def consensus_poses(spark, sf):
    m = "alignments3D_multi/"
    t = fx.prot_a(spark, sf).select("uid", F.col("posterior").alias(m + "class_posterior"), F.col("posterior").alias(m + "shift"), F.array(*[F.lit(i) for i in range(K)]).alias(m + "pose"))
    c = filters.consensus_pose(t)
    return c.agg(F.count("*").alias("n"), F.avg("`alignments3D/shift`").alias("shift"), F.sum("`alignments3D/pose`").alias("pose"), F.sum("`alignments3D/split`").alias("split"), F.sum(F.isnan("`alignments3D/psize_A`").cast("long")).alias("no_size"))


@query("select count(*) as n, round(avg(list_max(posterior)), 6) as weight from fx_prot_a", A3)
def confidence_weights(spark, sf):
    t = filters.confidence_as_weight(fx.prot_a(spark, sf).withColumn("w", F.lit(1.0)), "posterior", "w")
    return t.agg(F.count("*").alias("n"), F.avg("w").alias("weight"))


@query("select count(*) as n, sum(uid%1009)::bigint as checksum from fx_passthrough where df1>=11000 and df1<13000", "fx_passthrough")
def range_filter(spark, sf):
    return filters.in_range(fx.passthrough(spark, sf), "df1", 11000.0, 13000.0).agg(F.count("*").alias("n"), F.sum(F.col("uid") % 1009).alias("checksum"))


# --- joins -----------------------------------------------------------------------------


@query("select count(*) as n, round(avg(l.z[1]*r.z[2]), 6) as product from fx_latent l join fx_latent r on r.uid=l.uid and r.uid%3<>0", "fx_latent")
def position_join(spark, sf):
    z = _z(spark, sf)
    t = joins.by_position(z.select(F.col("uid").alias("row_id"), "z1"), z.where("uid % 3 <> 0").select(F.col("uid").alias("row_id"), "z2"))
    return t.agg(F.count("*").alias("n"), F.avg(F.col("z1") * F.col("z2")).alias("product"))


@query("select hard, (uid%4)::int as part, count(*) as n from fx_prot_a group by 1,2", A3)
def covering_join(spark, sf):
    a = fx.prot_a(spark, sf)
    t = joins.covering(a, a.select("uid", (F.col("uid") % 4).cast("int").alias("part")))
    return t.groupBy("hard", "part").agg(F.count("*").alias("n"))


@query("select a.hard, count(*) as n, sum((t.uid is null)::int)::bigint as missing, round(avg(t.alpha), 6) as mean_alpha from fx_prot_a a left join fx_passthrough t using (uid) group by 1", A3, "fx_passthrough")
def missing_as_nan(spark, sf):
    t = joins.with_missing_nan(fx.prot_a(spark, sf), fx.passthrough(spark, sf), "alpha")
    return t.groupBy("hard").agg(F.count("*").alias("n"), F.sum(F.isnan("alpha").cast("long")).alias("missing"), F.avg(F.when(~F.isnan("alpha"), F.col("alpha"))).alias("mean_alpha"))


@query(", m as (select hard as c, avg(z[1]) as m from fx_latent group by 1) select a.c as c_i, b.c as c_j, round(abs(a.m-b.m), 6) as gap from m a join m b on a.c<b.c", "fx_latent")
def class_pairs(spark, sf):
    m = _z(spark, sf).groupBy(F.col("hard").alias("c")).agg(F.avg("z1").alias("m"))
    return joins.all_pairs(m, "c").select("c_i", "c_j", F.abs(F.col("m_i") - F.col("m_j")).alias("gap"))


@query(f", p as (select a.hard, list_transform(b.posterior, lambda x: pow(greatest(x,1e-12),2)) as w from fx_prot_a a join fx_prot_b b using (uid)) select hard, count(*) as n, round(avg(w[1]/(w[1]+w[2]+w[3])), 6) as x, round(avg(w[2]/(w[1]+w[2]+w[3])), 6) as y from p group by 1", A3, "fx_prot_b")
def cross_job_coordinates(spark, sf):
    t = joins.cross_job_axis(fx.prot_a(spark, sf), fx.prot_b(spark, sf), 0, 1, 2.0)
    return t.groupBy("hard").agg(F.count("*").alias("n"), *_means("x", "y"))


PERMUTATIONS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


@query(
    BOTH + ", t as (select hard_a as i, hard_b as j, count(*) as n from ab group by 1,2), m as (select " + ", ".join(f"coalesce(sum(case when i={i} and j={j} then n end),0) as n{i}{j}" for i in range(3) for j in range(3)) + " from t) select greatest(" + ", ".join("+".join(f"n{i}{j}" for i, j in enumerate(p)) for p in PERMUTATIONS) + ")::bigint as matched from m",
    A3, "fx_prot_b",
)
def hungarian_match(spark, sf):
    m, _ = agreement.hungarian_confusion(_both(spark, sf), "hard_a", "hard_b")
    return spark.createDataFrame([(int(sum(m[i, i] for i in range(min(m.shape)))),)], "matched bigint")


# --- populations and occupancy ---------------------------------------------------------


@query(
    ORACLES["deconvolved_3x3"].replace("select 0::int as class", ", x as (select 0::int as class", 1)
    + "), o as (select hard as class, count(*)/(select count(*) from fx_prot_a)::double as f from fx_prot_a group by 1), s as (" + " union all ".join(f"select {i}::int as class, avg({p}) as f from fx_prot_a" for i, p in enumerate(P3)) + ") select s.class, round(coalesce(o.f,0), 6) as observed_hard, round(s.f, 6) as observed_soft, x.corrected as corrected_soft from s left join o using (class) join x using (class)",
    name="corrected_populations",
)
def corrected_populations(spark, sf):
    return populations.corrected(fx.prot_a(spark, sf), K)


@query(", m as (" + " union all ".join(f"select {i}::int as i, (uid%4)::int as j, sum({p}) as s from fx_prot_a group by 2" for i, p in enumerate(P3)) + ") select i, j, round(s/sum(s) over (partition by i), 6) as value from m", A3)
def soft_basin_occupancy(spark, sf):
    a = fx.prot_a(spark, sf).withColumn("basin", (F.col("uid") % 4).cast("int"))
    return confusion.soft_occupancy(a, "basin", "posterior", K, 4)


@query("select case when hard<5 then 'low' else 'high' end as model, round(avg(z[1]), 6) as mean_std, round(max(z[1]), 6) as max_std from fx_latent group by 1", "fx_latent")
def bootstrap_stability(spark, sf):
    return agreement.stability(_z(spark, sf).select(F.when(F.col("hard") < 5, "low").otherwise("high").alias("model"), F.col("z1").alias("std")))


@query("select hard, count(*) as n, round(avg(posterior[2]), 6) as mean, round(stddev_samp(posterior[2]), 6) as sd from fx_prot_a group by 1", A3)
def axis_gaussians(spark, sf):
    return landscape.axis_gaussians(fx.prot_a(spark, sf), K, 1)[0]


@query("select least(floor(posterior[2]*60),59)::int as bin, count(*) as n from fx_prot_a where posterior[2]>=0 and posterior[2]<=1 group by 1", A3)
def axis_histogram(spark, sf):
    return landscape.axis_gaussians(fx.prot_a(spark, sf), K, 1)[1]


# --- ordered ---------------------------------------------------------------------------

CURVE = ", c as (select *, lag(loss) over (order by epoch) as p, lead(loss) over (order by epoch) as q from fx_trainlog) "


@query(CURVE + "select epoch, round(loss, 6) as loss, n, case when p>loss and q>loss then 'min' else 'max' end as kind from c where (p>loss and q>loss) or (p<loss and q<loss)", "fx_trainlog")
def curve_turning_points(spark, sf):
    return ordered.turning_points(fx.trainlog(spark, sf), "epoch", "loss")


@query(CURVE + "select epoch, round(loss, 6) as loss, n from c where loss>p and loss>=q and loss>0.02*(select max(loss) from fx_trainlog)", "fx_trainlog")
def curve_modes(spark, sf):
    return ordered.modes(fx.trainlog(spark, sf), "epoch", "loss")


@query(", c as (select epoch, exp(-epoch/9.0::double) as v from fx_trainlog), d as (select epoch, v, lag(v) over (order by epoch) as pv, lag(epoch) over (order by epoch) as po from c) select round(arg_min(po+(pv-0.143)/(pv-v)*(epoch-po), epoch), 6) as crossing from d where v<0.143", "fx_trainlog")
def curve_crossing(spark, sf):
    t = fx.trainlog(spark, sf).select(F.col("epoch").cast("double").alias("epoch"), F.exp(-F.col("epoch") / 9.0).alias("v"))
    return ordered.first_below(t, "epoch", "v", 0.143)


@query(", c as (select epoch, 1-exp(-epoch/9.0::double) as corr from fx_trainlog) select min(epoch)::int as first_epoch from c where corr>=0.95", "fx_trainlog")
def first_stable_epoch(spark, sf):
    return ordered.first_stable(fx.trainlog(spark, sf).select("epoch", (1 - F.exp(-F.col("epoch") / 9.0)).alias("corr")))


@query("select round(corr(z[1],z[2]), 6) as corr, (case when corr(z[1],z[2])<0 then -1 else 1 end)::int as sign from fx_latent", "fx_latent")
def axis_direction(spark, sf):
    return ordered.same_direction(_z(spark, sf), "z1", "z2")


@query(", m as (select hard::double as c, avg(z[1]) as m from fx_latent group by 1) select (case when regr_slope(m,c)<0 then -1 else 1 end)::int as sign from m", "fx_latent")
def axis_orientation(spark, sf):
    return ordered.orientation(_z(spark, sf), "z1")


@query("select uid, round(z[1], 6) as z1 from fx_latent order by z[1] desc limit 7", "fx_latent")
def largest_rows(spark, sf):
    return ordered.top(_z(spark, sf).select("uid", "z1"), "z1", 7)


@query(", p as (select uid, (row_number() over (order by uid)-1)::bigint as position, count(*) over () as total from fx_latent) select uid, position from p where floor(position/greatest(total/40.0::double,1))<>floor((position-1)/greatest(total/40.0::double,1))", "fx_latent")
def spaced_rows(spark, sf):
    return ordered.evenly_spaced(fx.latent(spark, sf).select("uid"), 40).select("uid", "position")


@query("select 'z.'||max(uid)||'.pkl' as name from fx_latent", "fx_latent")
def latest_file(spark, sf):
    return ordered.latest(fx.latent(spark, sf).select(F.concat(F.lit("z."), F.col("uid").cast("string"), F.lit(".pkl")).alias("name")))


@query(", v as (select z[1] as x, count(*) as n from fx_latent group by 1), c as (select x, sum(n) over (order by x) as cum from v) select round(max(abs(cum/(select count(*) from fx_latent)::double-(x-(select min(x) from v))/((select max(x) from v)-(select min(x) from v)))), 6) as gap from c", "fx_latent")
def uniform_gap(spark, sf):
    return ordered.ecdf_gap(_z(spark, sf), "z1")


# --- set operations --------------------------------------------------------------------


@query("select hard as class, count(*) as n, count(*)::double as weight from fx_prot_a group by 1", A3)
def stacks_with_unit_weight(spark, sf):
    a = fx.prot_a(spark, sf).withColumn("weight", F.array_max("posterior"))
    whole = setops.stack({str(c): a.where(F.col("hard") == c) for c in range(K)}, reset_weight=True)
    return whole.groupBy(F.col("class").cast("int").alias("class")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("select case when uid%3=0 then 'c' when uid%2=0 then 'b' else 'a' end as class, count(*) as n from fx_prot_a group by 1", A3)
def branch_membership(spark, sf):
    a = fx.prot_a(spark, sf)
    return setops.membership({"a": a, "b": a.where("uid % 2 = 0"), "c": a.where("uid % 3 = 0")}).groupBy("class").agg(F.count("*").alias("n"))


@query(", p as (select uid as row_id, row_number() over (order by uid)-1 as position from fx_latent where uid%3=0) select row_id from p where position%5=2", "fx_latent")
def rebased_selection(spark, sf):
    earlier = setops.positions(fx.latent(spark, sf).where("uid % 3 = 0").select(F.col("uid").alias("row_id")))
    picked = earlier.where("position % 5 = 2").select(F.col("position").alias("row_id"))
    return setops.rebase(picked, earlier)


@query("select hard, count(*) as n from fx_prot_a where hard in (0,2) group by 1", A3)
def pair_selection(spark, sf):
    return setops.pair_mask(fx.prot_a(spark, sf), 0, 2, "hard").groupBy("hard").agg(F.count("*").alias("n"))


# --- functions -------------------------------------------------------------------------


@query(_average_sql("q", "(select list_transform(posterior, lambda x: (x+1e-6)/(1+3e-6)) as q from fx_prot_a)"), A3)
def log_ratio_round_trip(spark, sf):
    p = F.col("posterior")
    return _average(fx.prot_a(spark, sf).select(sx.inverse_alr(sx.alr(p, K), K).alias("q")), "q")


@query(_average_sql("posterior", A3, 2), A3)
def dropped_coordinate(spark, sf):
    return _average(fx.prot_a(spark, sf).select(sx.drop_coordinate(F.col("posterior"), K).alias("q")), "q", 2)


@query(_average_sql("q", "(select list_transform(s, lambda x: x/(s[1]+s[2]+s[3])) as q from (select list_transform(posterior, lambda x: sqrt(greatest(x,1e-12))) as s from fx_prot_a))"), A3)
def softened_posteriors(spark, sf):
    return _average(fx.prot_a(spark, sf).select(sx.soften(F.col("posterior"), 2.0).alias("q")), "q")


NORM4 = "sqrt(" + "+".join(f"{z}*{z}" for z in Z) + ")"


@query(f"select hard, round(avg(degrees({NORM4})), 6) as angle from fx_latent group by 1", "fx_latent")
def rotation_angle(spark, sf):
    return fx.latent(spark, sf).groupBy("hard").agg(F.avg(sx.axis_angle(F.col("z"))).alias("angle"))


@query("select round(avg((df1+df2)/2), 6) as defocus, round(avg(abs(df1-df2)), 6) as astigmatism from fx_passthrough", "fx_passthrough")
def defocus_summary(spark, sf):
    return fx.passthrough(spark, sf).agg(F.avg(sx.mean_defocus(F.col("df1"), F.col("df2"))).alias("defocus"), F.avg(sx.astigmatism(F.col("df1"), F.col("df2"))).alias("astigmatism"))


@query("select uid, round(degrees(z[1]), 6) as rot, round(degrees(0.5+abs(z[2])), 6) as tilt, round(degrees(z[3]), 6) as psi from fx_latent", "fx_latent")
def euler_angles(spark, sf):
    rot, tilt, psi = F.col("z1"), 0.5 + F.abs("z2"), F.col("z3")
    # Rz(psi)' Ry(tilt) Rz(rot)' of the three angles
    c, s = F.cos, F.sin
    first = F.array(c(psi) * c(tilt) * c(rot) - s(psi) * s(rot), c(psi) * c(tilt) * s(rot) + s(psi) * c(rot), -s(tilt) * c(psi))
    second = F.array(-s(psi) * c(tilt) * c(rot) - c(psi) * s(rot), -s(psi) * c(tilt) * s(rot) + c(psi) * c(rot), s(tilt) * s(psi))
    t = _z(spark, sf).select("uid", sx.euler_zyz(F.array(first, second, F.array(s(tilt) * c(rot), s(tilt) * s(rot), c(tilt)))).alias("e"))
    return t.select("uid", *[F.get("e", F.lit(i)).alias(n) for i, n in enumerate(("rot", "tilt", "psi"))])


@query("select case when hard<5 then 'P'||hard else 'map_x' end as class, 'P'||hard||' / Class '||(hard+1) as label, count(*) as n from fx_latent group by 1,2", "fx_latent")
def file_classes(spark, sf):
    h = F.col("hard").cast("string")
    name = F.when(F.col("hard") < 5, F.concat(F.lit("run/J1/P"), h, F.lit("_volume.mrc"))).otherwise("run/J1/map_x.mrc")
    return fx.latent(spark, sf).groupBy(sx.class_of_file(name).alias("class"), sx.dual_label(F.col("hard")).alias("label")).agg(F.count("*").alias("n"))


@query("select hard, round(case when hard=0 then -1 else 1.5/(hard/20.0::double) end, 6) as resolution, count(*) as n from fx_latent group by 1", "fx_latent")
def shell_resolution(spark, sf):
    r = sx.resolution(F.col("hard") / 20.0, 1.5)
    return fx.latent(spark, sf).groupBy("hard", F.when(r == math.inf, -1.0).otherwise(r).alias("resolution")).agg(F.count("*").alias("n"))


@query("select '['||printf('%.2f', hard/10.0::double)||','||printf('%.2f', (hard+1)/10.0::double)||')' as bin, count(*) as n from fx_latent group by 1", "fx_latent")
def bin_labels(spark, sf):
    return fx.latent(spark, sf).groupBy(sx.bin_label(F.col("hard") / 10.0, (F.col("hard") + 1) / 10.0).alias("bin")).agg(F.count("*").alias("n"))


@query(BOTH + ", w as (select " + ", ".join(f"p_a[{i}]*0.3+p_b[{i}]*0.7 as l{i}, exp(0.3*ln(greatest(p_a[{i}],1e-12))+0.7*ln(greatest(p_b[{i}],1e-12))) as g{i}" for i in (1, 2, 3)) + " from ab) " + " union all ".join(f"select '{n}' as pool, " + ", ".join(f"round(avg({c}{i}/({c}1+{c}2+{c}3)), 6) as p{i - 1}" for i in (1, 2, 3)) + " from w" for n, c in (("linear", "l"), ("log", "g"))), A3, "fx_prot_b")
def pooled_posteriors(spark, sf):
    both, lam = _both(spark, sf), F.lit(0.3)
    one = lambda name, pool: _average(both.select(pool(F.col("p_a"), F.col("p_b"), lam).alias("q")), "q").select(F.lit(name).alias("pool"), "p0", "p1", "p2")
    return one("linear", sx.linear_pool).unionByName(one("log", sx.log_pool))


# --- exports ---------------------------------------------------------------------------


@query("select uid::varchar as uid, 'P'||hard as class, printf('%.6f', list_max(posterior)) as score from fx_prot_a where uid%20=3", A3)
def particle_list(spark, sf):
    return exports.particle_list(fx.prot_a(spark, sf).where("uid % 20 = 3"), "hard", F.array_max("posterior"))


@query("select c.i, " + ", ".join(f"round(coalesce(sum(case when p.hard={j} then p.posterior[c.i+1] end),0)/greatest(sum(p.posterior[c.i+1]),1e-12), 6) as \"{j}\"" for j in range(3)) + " from (select i::int as i from range(3) r(i)) c, fx_prot_a p group by 1", A3)
def confusion_matrix(spark, sf):
    return exports.matrix(confusion.soft_posterior_confusion(fx.prot_a(spark, sf), K), K)


@query("select '{\"uid\":'||uid||',\"hard\":'||hard||'}' as value from fx_latent", "fx_latent")
def json_rows(spark, sf):
    return exports.json_lines(fx.latent(spark, sf).select("uid", "hard", F.lit(1).alias("_private")))


@query("select " + "||' '||".join(f"printf('%.6f', {z})" for z in Z) + " as value, hard from fx_latent", "fx_latent")
def decoder_points(spark, sf):
    return exports.points(fx.latent(spark, sf), "z", 4, "hard")


@query("select round(abs(corr(df1,df2)), 6) as max_abs_corr, round(avg(alpha), 6) as gap, abs(corr(df1,df2))>0.3 as confounded, avg(alpha)>0.15 as overconfident from fx_passthrough", "fx_passthrough")
def verdict_flags(spark, sf):
    return exports.verdicts(fx.passthrough(spark, sf).agg(F.abs(F.corr("df1", "df2")).alias("max_abs_corr"), F.avg("alpha").alias("gap")))


# --- latents and volumes ---------------------------------------------------------------

U = [f"((select avg(z[{i}]) from fx_latent where hard=2)-(select avg(z[{i}]) from fx_latent where hard=1))" for i in (1, 2, 3, 4)]


@query(", u as (select " + ", ".join(f"(select avg(z[{i}]) from fx_latent where hard=1) as a{i}, {U[i - 1]} as u{i}" for i in (1, 2, 3, 4)) + ") select hard, round(avg((" + "+".join(f"(z[{i}]-a{i})*u{i}" for i in (1, 2, 3, 4)) + ")/(" + "+".join(f"u{i}*u{i}" for i in (1, 2, 3, 4)) + ")), 6) as t from fx_latent, u group by 1", "fx_latent")
def centroid_projection(spark, sf):
    return latent.centroid_axis(fx.latent(spark, sf), "z", 4, 1, 2).groupBy("hard").agg(F.avg("t").alias("t"))


def _maps(spark, sf):
    v = fx.voxels(spark, sf)
    return v.select(*volumes.AXES, F.lit("a").alias("map"), F.col("va").alias("v")).unionByName(v.select(*volumes.AXES, F.lit("b").alias("map"), F.col("vb").alias("v")))


MASK = ", m as (select x,y,z, (va+vb)/2 as m from fx_voxels), k as (select v.* from fx_voxels v join m using (x,y,z) where m.m>(select quantile_cont(m,0.9) from m)) "


@query(MASK + "select 'a' as a, 'b' as b, round(corr(va,vb), 6) as cc from k", "fx_voxels")
def map_correlations(spark, sf):
    maps = _maps(spark, sf)
    return volumes.correlation_matrix(maps, volumes.shared_mask(maps, 0.9))


@query(MASK + " union all ".join(f"select '{c}' as map, count(*) as n, round(max((v.v{c}-(select avg(v{c}) from k))/(select stddev_pop(v{c}) from k)), 6) as top, round(avg((v.v{c}-(select avg(v{c}) from k))/(select stddev_pop(v{c}) from k)), 6) as mean from fx_voxels v" for c in "ab"), "fx_voxels")
def map_zscores(spark, sf):
    maps = _maps(spark, sf)
    return volumes.zscore(maps, volumes.shared_mask(maps, 0.9)).groupBy("map").agg(F.count("*").alias("n"), F.max("v").alias("top"), F.avg("v").alias("mean"))


@query(MASK + "select round(corr(va,vb), 6) as cc from k", "fx_voxels")
def map_reproducibility(spark, sf):
    maps = _maps(spark, sf)
    return volumes.reproducibility(maps, volumes.shared_mask(maps, 0.9))


@query()
def mode_count(spark, sf):
    return modes.mode_count(fx.latent(spark, sf), "z")


@query(f"select 'a-b' as pair, s as shell, round(s/12.0, 6)::double as freq, round(sum(ra*rb+ia*ib)/sqrt(sum(ra*ra+ia*ia)*sum(rb*rb+ib*ib)), 6) as fsc from (select *, floor(sqrt(kx*kx+ky*ky+kz*kz))::bigint as s from ({DFT})) where s<6 group by s", "fx_voxels")
def fsc_whole_radius(spark, sf):
    return volumes.fsc(fx.voxels(spark, sf).withColumn("pair", F.lit("a-b")), whole=True)


# --- resampled, moved and projected grids ----------------------------------------------


def _tent(position: str, voxel: str) -> str:
    return f"(1-abs({position}-{voxel}))"


STEP = {c: f"(o.{c}*({11 / 7!r}::double))" for c in "xyz"}


@query(
    ", o as (select x::int as x, y::int as y, z::int as z from range(8) a(x), range(8) b(y), range(8) c(z)) " + " union all ".join(f"select '{m}' as map, o.x, o.y, o.z, round(sum(v.v{m}*" + "*".join(_tent(STEP[c], f"v.{c}") for c in "xyz") + "), 6) as v from o join fx_voxels v on " + " and ".join(f"abs({STEP[c]}-v.{c})<1" for c in "xyz") + " group by 2,3,4" for m in "ab"),
    "fx_voxels",
)
def map_zoom(spark, sf):
    return rigid.resampled(_maps(spark, sf), 12, 8).select("map", *volumes.AXES, "v")


#: two poses, entries by rows in the order z, y, x, and translations that leave no value halfway between two roundings
POSES = {0: ((1.0, 0.0, 0.0, 0.0, 0.8, -0.6, 0.0, 0.6, 0.8), (0.0, 0.13711337, 0.22937719)), 1: ((0.48, -0.8, 0.36, 0.64, 0.6, 0.48, -0.6, 0.0, 0.8), (0.23713391, -0.51297713, 0.91373179))}
_POSITION = {c: "+".join(f"r[{3 * i + j + 1}]*({d}-5.5-s[{j + 1}])" for j, d in enumerate("zyx")) + "+5.5" for i, c in enumerate("zyx")}
MOVED = (
    ", pose as (" + " union all ".join(f"select {t}::int as t, {[*r]}::double[] as r, {[*s]}::double[] as s" for t, (r, s) in POSES.items()) + ")"
    ", o as (select t, x::int as x, y::int as y, z::int as z, " + ", ".join(f"{p} as p{c}" for c, p in _POSITION.items()) + " from pose, range(12) a(x), range(12) b(y), range(12) c(z))"
    ", h as (select t, x, y, z, (" + " and ".join(f"p{c}>=-1e-9 and p{c}<=11+1e-9" for c in "zyx") + ") as inside, " + ", ".join(f"least(greatest(p{c},0),11) as p{c}" for c in "zyx") + " from o)"
    ", e as (select t, h.x, h.y, h.z, bool_and(inside) as inside, " + ", ".join(f"sum(v.v{m}*" + "*".join(_tent(f"p{c}", f"v.{c}") for c in "zyx") + f") as v{m}" for m in "ab") + " from h join fx_voxels v on " + " and ".join(f"abs(p{c}-v.{c})<1" for c in "zyx") + " group by 1,2,3,4) "
)


def _poses(spark):
    return spark.createDataFrame([(m, t, [*r], [*s]) for m in "ab" for t, (r, s) in POSES.items()], "map string, t int, r array<double>, shift array<double>")


@query(MOVED + " union all ".join(f"select '{m}' as map, t, x, y, z, round(v{m}, 6) as v from e" for m in "ab"), "fx_voxels")
def map_moved(spark, sf):
    return rigid.moved(_maps(spark, sf), _poses(spark), 12)


@query(MOVED + " union all ".join(f"select '{m}' as map, t, x, y, round(sum(case when inside then v{m} else 0 end), 6) as v from e group by 2,3,4" for m in "ab"), "fx_voxels")
def map_projections(spark, sf):
    return rigid.projections(_maps(spark, sf), _poses(spark), 12)


@query()
def rigid_alignment(spark, sf):
    """The motion that fits the second map best to the first (checked on planted motions in the tests)."""
    pairs = fx.voxels(spark, sf).withColumn("pair", F.lit("a-b"))
    return rigid.align(pairs, 12).select("pair", "cc_raw", "cc", "degrees", *[F.get("shift", F.lit(i)).alias(f"shift_{c}") for i, c in enumerate("zyx")])
