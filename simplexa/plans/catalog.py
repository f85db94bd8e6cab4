"""Named queries over the analytics operators, with DuckDB oracles.

Matrices come in long form i, j, value; classes are INT from 0, counts BIGINT, and
doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, confusion, ensemble, exports, filters, gmm, joins, landscape, latent, ordered, populations, resample, setops, volumes
from simplexa.plans import fixtures as fx
from simplexa.session import Written

K = 3  # real classes of the fixtures
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("int").alias(c) if t == "tinyint" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(oracle: str | None = None, *views: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        n = name or f.__name__
        QUERIES[n] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[n] = fx.with_views(oracle, *views) if views else oracle
        return f

    return register


def r6(x: str) -> str:
    return f"round({x}, 6)"


P3 = [f"posterior[{i + 1}]" for i in range(K)]
CELLS = "(select i::int as i, j::int as j from range(3) a(i), range(3) b(j))"


# --- populations -----------------------------------------------------------------------


@query("select c.i::int as class, count(p.uid) as n, round(count(p.uid)/(select count(*) from fx_prot_a)::double, 6) as fraction from range(3) c(i) left join fx_prot_a p on p.hard=c.i group by 1", "fx_prot_a")
def hard_populations(spark, sf):
    return populations.observed(fx.prot_a(spark, sf), K)


@query(" union all ".join(f"select {i}::int as class, round(avg({p}), 6) as fraction from fx_prot_a" for i, p in enumerate(P3)), "fx_prot_a")
def soft_populations(spark, sf):
    return populations.soft(fx.prot_a(spark, sf), K)


SOFT = "select c.i, c.j, coalesce(sum(case when p.hard=c.j then p.posterior[c.i+1] end),0)/greatest(sum(p.posterior[c.i+1]),1e-12) as value from %s c, fx_prot_a p group by 1, 2" % CELLS


@query(f"select i, j, round(value, 6) as value from ({SOFT})", "fx_prot_a")
def soft_confusion(spark, sf):
    return confusion.soft_posterior_confusion(fx.prot_a(spark, sf), K)


@query(
    f", c as ({SOFT}), pi as (select hard, count(*)/(select count(*) from fx_prot_a)::double as p from fx_prot_a group by 1), m as (select " + ", ".join(f"max(case when i={j} and j={i} then value end) as a{i}{j}" for i in range(3) for j in range(3)) + " from c), b as (select " + ", ".join(f"coalesce(max(case when hard={i} then p end),0) as b{i}" for i in range(3)) + " from pi), d as (select *, a00*(a11*a22-a12*a21)-a01*(a10*a22-a12*a20)+a02*(a10*a21-a11*a20) as det from m, b) "
    "select 0::int as class, round((b0*(a11*a22-a12*a21)-a01*(b1*a22-a12*b2)+a02*(b1*a21-a11*b2))/det, 6) as corrected from d union all select 1::int, round((a00*(b1*a22-a12*b2)-b0*(a10*a22-a12*a20)+a02*(a10*b2-b1*a20))/det, 6) from d union all select 2::int, round((a00*(a11*b2-b1*a21)-a01*(a10*b2-b1*a20)+b0*(a10*a21-a11*a20))/det, 6) from d",
    "fx_prot_a",
)
def deconvolved_3x3(spark, sf):
    return populations.corrected(fx.prot_a(spark, sf), K).select("class", F.col("corrected_soft").alias("corrected"))


@query("select c.i::int as class_index, 'P'||c.i as label, case when c.i<1 then 'dummy' else 'protein' end as kind, count(h.h) as hard_count, round(count(h.h)/(select count(*) from fx_job_a)::double, 6) as hard_fraction from range(4) c(i) left join (select list_position(posterior,list_max(posterior))-1 as h from fx_job_a) h on h.h=c.i group by c.i", "fx_job_a")
def class_occupancy(spark, sf):
    return populations.occupancy(fx.job_a(spark, sf), 4, 1)


@query(" union all ".join(f"select {b}::double as beta, {i}::int as class, round(sum(pow({p},{b})/greatest({'+'.join(f'pow({x},{b})' for x in P3)},1e-12)), 6) as effective_n from fx_prot_a" for b in (1, 2, 4, 8) for i, p in enumerate(P3)), "fx_prot_a")
def effective_n_by_beta(spark, sf):
    return populations.effective_n(fx.prot_a(spark, sf), K, [1, 2, 4, 8])


@query("select v.g::int as g, v.i::int as i, round(greatest(v.x::double - t.theta::double, 0), 6) as projected from (values (0,0,0.9),(0,1,0.4),(0,2,-0.2),(1,0,0.2),(1,1,0.3),(1,2,0.5),(2,0,2.0),(2,1,0.1),(2,2,0.0)) v(g,i,x), (values (0,0.15),(1,0.0),(2,1.0)) t(g,theta) where v.g=t.g")
def simplex_projection(spark, sf):
    rows = [(g, i, float(x)) for g, v in enumerate(((0.9, 0.4, -0.2), (0.2, 0.3, 0.5), (2.0, 0.1, 0.0))) for i, x in enumerate(v)]
    return populations.simplex_projection(spark.createDataFrame(rows, "g int, i int, x double"), "g", "i", "x").select("g", "i", "projected")


# --- confusion and contingency ---------------------------------------------------------

BOTH = ", ab as (select a.uid, a.hard as hard_a, b.hard as hard_b, a.posterior as p_a, b.posterior as p_b from fx_prot_a a join fx_prot_b b using (uid)) "


def _both(spark, sf):
    return joins.two_experts(fx.prot_a(spark, sf), fx.prot_b(spark, sf))


@query(BOTH + f"select c.i, c.j, count(ab.uid) as n, round(count(ab.uid)/greatest(sum(count(ab.uid)) over (partition by c.i),1)::double, 6) as value from {CELLS} c left join ab on ab.hard_a=c.i and ab.hard_b=c.j group by 1,2", "fx_prot_a", "fx_prot_b")
def empirical_confusion(spark, sf):
    return confusion.hard_confusion(_both(spark, sf), "hard_a", "hard_b", K)


@query(BOTH + "select hard_a as i, hard_b as j, count(*) as n from ab group by 1,2", "fx_prot_a", "fx_prot_b")
def contingency(spark, sf):
    return agreement.contingency(_both(spark, sf), "hard_a", "hard_b")


@query(BOTH + " union all ".join(f"select {i}::int as i, {j}::int as j, round(sum(p_a[{i + 1}]*p_b[{j + 1}]), 6) as value from ab" for i in range(3) for j in range(3)), "fx_prot_a", "fx_prot_b")
def soft_crosstab(spark, sf):
    return confusion.soft_crosstab(_both(spark, sf), "p_a", "p_b", K, K)


@query(" union all ".join(f"select hard as i, {j}::int as j, round(avg({p}), 6) as value from fx_prot_a group by hard" for j, p in enumerate(P3)), "fx_prot_a")
def mean_posterior_by_class(spark, sf):
    return confusion.mean_posterior_by_class(fx.prot_a(spark, sf), K)


def _moment_sql(v: list[str], table: str) -> str:
    d = len(v)
    return "select hard, count(*) as n, " + ", ".join([r6(f"avg({v[i]})") + f" as m{i}" for i in range(d)] + [r6(f"covar_samp({v[i]},{v[j]})") + f" as c{i}_{j}" for i in range(d) for j in range(i, d)]) + f" from {table} group by hard"


@query(_moment_sql(P3, "fx_prot_a"), "fx_prot_a")
def class_moments(spark, sf):
    return confusion.moments(fx.prot_a(spark, sf), "hard", "posterior", K)


EPS = [f"(({p}+1e-6)/(1+3e-6))" for p in P3]
ALR = f"(select uid, hard, [ln({EPS[0]}/{EPS[2]}), ln({EPS[1]}/{EPS[2]})] as x from (select uid, hard, list_transform(posterior, lambda v: v) as posterior from fx_prot_a))"


def _alr(spark, sf):
    return fx.prot_a(spark, sf).withColumn("x", sx.alr(F.col("posterior"), K))


@query(_moment_sql(["x[1]", "x[2]"], ALR), "fx_prot_a")
def alr_moments(spark, sf):
    return confusion.moments(_alr(spark, sf), "hard", "x", 2)


# --- quality and agreement -------------------------------------------------------------

Q = ", q as (select list_max(posterior) as m, list_reverse_sort(posterior) as s, " + "-(" + "+".join(f"greatest({p},1e-12)*ln(greatest({p},1e-12))" for p in P3) + ") as h from fx_prot_a) "


@query(
    Q + "select count(*) as n, " + ", ".join(r6(e) + " as " + n for n, e in (("mean_max", "avg(m)"), ("sd_max", "stddev_pop(m)"), ("median_max", "quantile_cont(m,0.5)"), ("share_05", "avg((m>0.5)::int)"), ("share_08", "avg((m>0.8)::int)"), ("share_09", "avg((m>0.9)::int)"), ("mean_margin", "avg(s[1]-s[2])"), ("sd_margin", "stddev_pop(s[1]-s[2])"), ("mean_entropy", "avg(h)"), ("share_near_uniform", "avg((h>0.95*ln(3))::int)"))) + " from q",
    "fx_prot_a",
)
def posterior_quality(spark, sf):
    return agreement.posterior_quality(fx.prot_a(spark, sf), K)


@query("select coalesce(hard,-1)::int as class, count(*) as n, round(avg(list_max(posterior)), 6) as mean_max from fx_prot_a group by rollup(hard)", "fx_prot_a")
def within_class_confidence(spark, sf):
    return agreement.within_class_confidence(fx.prot_a(spark, sf))


@query("select hard, count(*) as n, round(avg(s[1]-s[2]), 6) as margin from (select hard, list_reverse_sort(posterior) as s from fx_prot_a) group by 1", "fx_prot_a")
def margin_top2(spark, sf):
    return fx.prot_a(spark, sf).groupBy("hard").agg(F.count("*").alias("n"), F.avg(sx.top2_margin(F.col("posterior"))).alias("margin"))


H_EPS = "-(" + "+".join(f"p_a[{i}]*ln(p_a[{i}]+1e-12)" for i in (1, 2, 3)) + ")"


@query(
    BOTH + ", d as (select *, hard_a<>hard_b as dis, (uid%3)::int as referee, list_max(p_a) as m, " + H_EPS + " as h from ab) select count(*) as n_total, sum(dis::int)::bigint as n_disagree, " + ", ".join(r6(e) + " as " + n for n, e in (("frac_disagree", "avg(dis::int)"), ("disagree_mean_maxpost", "avg(case when dis then m end)"), ("agree_mean_maxpost", "avg(case when not dis then m end)"), ("disagree_mean_entropy", "avg(case when dis then h end)"), ("agree_mean_entropy", "avg(case when not dis then h end)"), ("sides_a", "avg(case when dis then (referee=hard_a)::int end)"), ("sides_b", "avg(case when dis then (referee=hard_b)::int end)"), ("sides_neither", "avg(case when dis then (referee<>hard_a and referee<>hard_b)::int end)"))) + " from d",
    "fx_prot_a", "fx_prot_b",
)
def disagreement(spark, sf):
    return agreement.disagreement(_both(spark, sf).withColumn("referee", (F.col("uid") % 3).cast("int")))


@query(
    BOTH + ", d as (select case when m<0.5 then 0 when m<0.7 then 1 when m<0.9 then 2 else 3 end::int as bin, (hard_a=hard_b)::int as same, sqrt(pow(p_a[1]-p_b[1],2)+pow(p_a[2]-p_b[2],2)+pow(p_a[3]-p_b[3],2)) as dist from (select *, list_max(p_a) as m from ab)) select bin, count(*) as n, round(count(*)/(select count(*) from ab)::double, 6) as share, round(avg(same), 6) as agreement, round(avg(dist), 6) as mean_distance from d group by 1",
    "fx_prot_a", "fx_prot_b",
)
def confidence_calibration(spark, sf):
    return agreement.calibration(_both(spark, sf))


TS = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    ", t as (select unnest([0.4,0.5,0.6,0.7,0.8,0.9]::double[]) as threshold), c as (select t.threshold, k.i::int as class, count(p.uid) as n from t cross join range(3) k(i) left join fx_prot_a p on p.hard=k.i and list_max(p.posterior)>t.threshold group by 1,2) select threshold, 'r'||replace(threshold::varchar,'.','p') as threshold_tag, class, n as n_particles, (sum(n) over (partition by threshold))::bigint as n_total_pass from c",
    "fx_prot_a",
)
def threshold_sweep(spark, sf):
    return agreement.threshold_sweep(fx.prot_a(spark, sf), TS, K)


@query(", t as (select unnest([0.4,0.5,0.6,0.7,0.8,0.9]::double[]) as threshold) select threshold, count(p.uid) as n_particles_pass, round(count(p.uid)/(select count(*) from fx_prot_a)::double, 6) as fraction_total_pass from t left join fx_prot_a p on list_max(p.posterior)>t.threshold group by 1", "fx_prot_a")
def threshold_totals(spark, sf):
    return agreement.threshold_totals(fx.prot_a(spark, sf), TS)


T = BOTH + ", t as (select hard_a as i, hard_b as j, count(*)::double as n from ab group by 1,2) "


@query(T + ", x as (select (select sum(n*(n-1)/2) from t) as s, (select sum(n*(n-1)/2) from (select sum(n) as n from t group by i)) as sa, (select sum(n*(n-1)/2) from (select sum(n) as n from t group by j)) as sb, (select sum(n) from t) as m) select round((s-sa*sb/(m*(m-1)/2))/((sa+sb)/2-sa*sb/(m*(m-1)/2)), 6) as ari from x", "fx_prot_a", "fx_prot_b")
def ari(spark, sf):
    return agreement.ari(_both(spark, sf), "hard_a", "hard_b")


@query(
    T + ", m as (select sum(n) as m from t), x as (select (select -sum(n/m*ln(n/m)) from (select sum(n) as n from t group by i), m) as ha, (select -sum(n/m*ln(n/m)) from (select sum(n) as n from t group by j), m) as hb, (select -sum(n/m*ln(n/m)) from t, m) as hab), v as (select (ha+hb-hab)/ha as hom, (ha+hb-hab)/hb as com, 2*(ha+hb-hab)/(ha+hb) as nmi from x) select round(hom, 6) as homogeneity, round(com, 6) as completeness, round(nmi, 6) as nmi, round(2*hom*com/(hom+com), 6) as v_measure from v",
    "fx_prot_a", "fx_prot_b",
)
def nmi_v_measure(spark, sf):
    return agreement.v_measures(_both(spark, sf), "hard_a", "hard_b")


@query(T + "select round(sum(m)/sum(s), 6) as purity from (select max(n) as m, sum(n) as s from t group by j)", "fx_prot_a", "fx_prot_b")
def purity(spark, sf):
    return agreement.purity(_both(spark, sf), "hard_a", "hard_b")


@query(BOTH + ", r as (select hard_a as class, count(*) as n, avg((hard_a=hard_b)::int) as recall from ab group by 1) select class, n, round(recall, 6) as recall, round(avg(recall) over (), 6) as balanced_accuracy from r", "fx_prot_a", "fx_prot_b")
def recall_by_class(spark, sf):
    return agreement.recall_by_class(_both(spark, sf), "hard_a", "hard_b")


@query("select count(*) as n, " + ", ".join(r6(e) + " as " + n for n, e in (("mean", "avg(c)"), ("median", "quantile_cont(c,0.5)"), ("share_05", "avg((c>0.5)::int)"), ("share_09", "avg((c>0.9)::int)"), ("share_099", "avg((c>0.99)::int)"))) + " from (select list_max(posterior) as c from fx_prot_b where uid%4<>0)", "fx_prot_b")
def label_confidence(spark, sf):
    df = fx.prot_b(spark, sf).withColumn("c", F.when(F.col("uid") % 4 == 0, float("nan")).otherwise(F.array_max("posterior")))
    return agreement.label_confidence(df, "c")


# --- divergences, tiers, pools ---------------------------------------------------------


def _kl(a: str, b: str) -> str:
    return "(" + "+".join(f"{a}[{i}]*ln({a}[{i}]/{b}[{i}])" for i in (1, 2, 3)) + ")"


SAFE = lambda v: f"list_transform({v}, lambda x: greatest(x,1e-12)/(greatest({v}[1],1e-12)+greatest({v}[2],1e-12)+greatest({v}[3],1e-12)))"
JS = BOTH + f", s as (select uid, hard_a, hard_b, {SAFE('p_a')} as a, {SAFE('p_b')} as b from ab), j as (select *, [(a[1]+b[1])/2,(a[2]+b[2])/2,(a[3]+b[3])/2] as m from s), d as (select *, ({_kl('a', 'm')}+{_kl('b', 'm')})/2 as js, {_kl('a', 'b')} as kl_ab, {_kl('b', 'a')} as kl_ba from j) "


def _js(spark, sf):
    a, b = F.col("p_a"), F.col("p_b")
    return _both(spark, sf).select("uid", "hard_a", "hard_b", sx.js(a, b).alias("js"), sx.kl(a, b).alias("kl_ab"), sx.kl(b, a).alias("kl_ba"))


@query(JS + "select (hard_a=hard_b) as agree, count(*) as n, round(avg(js), 6) as mean_js, round(max(js), 6) as max_js, round(avg(kl_ab), 6) as mean_kl_ab, round(avg(kl_ba), 6) as mean_kl_ba from d group by 1", "fx_prot_a", "fx_prot_b")
def js_divergence_summary(spark, sf):
    return _js(spark, sf).groupBy((F.col("hard_a") == F.col("hard_b")).alias("agree")).agg(F.count("*").alias("n"), F.avg("js").alias("mean_js"), F.max("js").alias("max_js"), F.avg("kl_ab").alias("mean_kl_ab"), F.avg("kl_ba").alias("mean_kl_ba"))


@query(JS + ", c as (select quantile_cont(js,0.66) as p66, quantile_cont(js,0.33) as p33 from d) select case when hard_a=hard_b and js<p33 then 'hc' when hard_a=hard_b and js<p66 then 'hcperm' when hard_a=hard_b then 'hard' else 'full' end as tier, count(*) as n from d, c group by 1", "fx_prot_a", "fx_prot_b")
def confidence_tiers(spark, sf):
    both = joins.two_experts(fx.prot_a(spark, sf), fx.prot_b(spark, sf, c_library=True))
    written = Written(spark, "tiers")  # read for the percentiles and for the tiers
    t = written(filters.divergences(both.select("p_a", "p_b", (F.col("hard_a") == F.col("hard_b")).cast("int").alias("agree"))).select("agree", "js"))
    found = filters.confidence_tiers(t).groupBy("tier").agg(F.count("*").alias("n")).collect()  # a row a tier
    written.drop()
    return spark.createDataFrame([tuple(r) for r in found], "tier string, n long")


@query("select hard, count(*) as n, round(avg(ln(greatest(posterior[1],1e-9)/greatest(posterior[2],1e-9))), 6) as mean_ratio from fx_prot_a where posterior[1]+posterior[2]>1.0/3 group by 1", "fx_prot_a")
def pair_log_ratio(spark, sf):
    t = filters.pair_mass(fx.prot_a(spark, sf), 0, 1, K)
    return t.groupBy("hard").agg(F.count("*").alias("n"), F.avg(sx.log_ratio(F.col("posterior"), 0, 1)).alias("mean_ratio"))


LAMS = [i / 20 for i in range(21)]


def _pool_sql() -> str:
    lin = "[" + ",".join(f"lam*p_a[{i}]+(1-lam)*p_b[{i}]" for i in (1, 2, 3)) + "]"
    log = "[" + ",".join(f"exp(lam*ln(greatest(p_a[{i}],1e-12))+(1-lam)*ln(greatest(p_b[{i}],1e-12)))" for i in (1, 2, 3)) + "]"
    cols = "count(*) as n, round(avg(list_max(p)), 6) as mean_maxpost, round(avg(-(" + "+".join(f"greatest(p[{i}],1e-12)*ln(greatest(p[{i}],1e-12))" for i in (1, 2, 3)) + ")), 6) as mean_entropy, " + ", ".join(f"round(avg((list_position(list_transform(p, lambda x: x>=list_max(p)-1e-12), true)={i + 1})::int), 6) as hard_{i}" for i in range(3)) + ", " + ", ".join(f"round(avg(p[{i + 1}]), 6) as soft_{i}" for i in range(3))
    return BOTH + f", l as (select x/20.0::double as lam from range(21) r(x)), w as (select 'linear' as pool, lam, {lin} as w from ab, l union all select 'log', lam, {log} from ab, l), p as (select pool, lam, list_transform(w, lambda x: x/greatest(w[1]+w[2]+w[3],1e-12)) as p from w) select pool, round(lam, 6) as lam, {cols} from p group by 1, lam"


@query(_pool_sql(), "fx_prot_a", "fx_prot_b")
def lambda_sweep_populations(spark, sf):
    return ensemble.lambda_sweep(_both(spark, sf), LAMS, K)


# --- joins, set operations, exports ----------------------------------------------------


@query(BOTH + "select count(*) as n, sum((hard_a=hard_b)::int)::bigint as n_agree, (sum(uid%1000))::bigint as checksum from ab", "fx_prot_a", "fx_prot_b")
def cross_job_join(spark, sf):
    return _both(spark, sf).agg(F.count("*").alias("n"), F.sum((F.col("hard_a") == F.col("hard_b")).cast("long")).alias("n_agree"), F.sum(F.col("uid") % 1000).alias("checksum"))


@query("select coalesce(b.hard,-1)::int as assigned, count(*) as n from fx_prot_a a left join fx_prot_b b using (uid) group by 1", "fx_prot_a", "fx_prot_b")
def left_assign(spark, sf):
    b = fx.prot_b(spark, sf).withColumnRenamed("hard", "assigned")
    return joins.assigned(fx.prot_a(spark, sf), b, "assigned").groupBy("assigned").agg(F.count("*").alias("n"))


@query("select hard, count(*) as n from fx_prot_a where uid not in (select uid from fx_passthrough) group by 1", "fx_prot_a", "fx_passthrough")
def anti_unmatched(spark, sf):
    return joins.members(fx.prot_a(spark, sf), fx.passthrough(spark, sf), inside=False).groupBy("hard").agg(F.count("*").alias("n"))


@query("select a.hard, count(*) as n, round(avg(t.alpha), 6) as mean_alpha from fx_prot_a a join fx_passthrough t using (uid) join fx_prot_b b using (uid) group by 1", "fx_prot_a", "fx_prot_b", "fx_passthrough")
def three_way_join(spark, sf):
    j = joins.three_way(fx.prot_a(spark, sf), fx.passthrough(spark, sf), fx.prot_b(spark, sf).select("uid"))
    return j.groupBy("hard").agg(F.count("*").alias("n"), F.avg("alpha").alias("mean_alpha"))


@query("select coalesce(o.class, a.hard)::int as hard, (o.class is not null) as is_official, count(*) as n from fx_prot_a a left join (select uid, (uid%3)::int as class from fx_prot_b where uid%5=0) o using (uid) group by 1,2", "fx_prot_a", "fx_prot_b")
def official_override(spark, sf):
    o = fx.prot_b(spark, sf).where("uid % 5 = 0").select("uid", (F.col("uid") % 3).cast("int").alias("class"))
    return joins.official_or_own(fx.prot_a(spark, sf), o).groupBy("hard", "is_official").agg(F.count("*").alias("n"))


@query("select hard as class, count(*) as n, sum(uid%97)::bigint as checksum from fx_prot_a group by 1", "fx_prot_a")
def union_stacks(spark, sf):
    a = fx.prot_a(spark, sf)
    whole = setops.stack({str(c): a.where(F.col("hard") == c) for c in range(K)})
    return whole.groupBy(F.col("class").cast("int").alias("class")).agg(F.count("*").alias("n"), F.sum(F.col("uid") % 97).alias("checksum"))


@query("select count(*) as n_rows, count(*)-count(distinct l_orderkey*8+l_linenumber) as n_duplicates from lineitem")
def duplicate_uids(spark, sf):
    return setops.duplicates(fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("uid")))


@query("select count(*) as n, sum(uid%1009)::bigint as checksum from fx_rows where uid not in (select uid from fx_prot_a)", "fx_prot_a")
def complement_selection(spark, sf):
    return setops.complement(fx.rows(spark, sf), fx.prot_a(spark, sf)).agg(F.count("*").alias("n"), F.sum(F.col("uid") % 1009).alias("checksum"))


@query("select 'union' as kind, count(distinct uid) as n from (select uid from fx_prot_a union all select uid from fx_prot_b) union all select 'intersection', count(*) from fx_prot_a join fx_prot_b using (uid)", "fx_prot_a", "fx_prot_b")
def combined_selections(spark, sf):
    a, b = fx.prot_a(spark, sf), fx.prot_b(spark, sf)
    out = [setops.combine(a, b, k, "uid").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("union", "intersection")]
    return out[0].unionByName(out[1])


@query(
    ", w as (select uid, hard, list_transform(posterior, lambda x: pow(greatest(x,1e-12),2)) as w from fx_prot_a), n as (select uid, hard, w[hard+1]/(w[1]+w[2]+w[3]) as weight from w) select hard as class, count(*) as n_particles, round(sum(weight), 6) as effective_n, round(avg(weight), 6) as mean_weight from n join fx_passthrough using (uid) where weight>0.5 group by 1",
    "fx_prot_a", "fx_passthrough",
)
def weighted_manifest(spark, sf):
    w = fx.prot_a(spark, sf).withColumn("weight", F.get(sx.sharpen(F.col("posterior"), 2.0), F.col("hard"))).withColumn("class", F.col("hard"))
    kept = filters.weight_at_least(w, 0.5)
    return exports.manifest(joins.members(kept, fx.passthrough(spark, sf)), ["class"])


@query(", w as (select t.uid, t.alpha*coalesce(list_max(a.posterior),1) as alpha from fx_passthrough t left join fx_prot_a a using (uid)) select count(*) as n, round(sum(alpha), 6) as total from w", "fx_prot_a", "fx_passthrough")
def weight_overwrite(spark, sf):
    w = fx.passthrough(spark, sf).join(fx.prot_a(spark, sf).select("uid", F.array_max("posterior").alias("w")), "uid", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    return exports.overwrite_weight(w, "w", "alpha", "multiply").agg(F.count("*").alias("n"), F.sum("alpha").alias("total"))


@query(", w as (select coalesce(a.posterior,[1/3.0,1/3.0,1/3.0]::double[]) as p from fx_passthrough t left join fx_prot_a a using (uid)) select count(*) as n, round(avg(p[1]), 6) as p0, round(avg(p[3]), 6) as p2 from w", "fx_prot_a", "fx_passthrough")
def posterior_append(spark, sf):
    t = exports.append_posterior(fx.passthrough(spark, sf), fx.prot_a(spark, sf), K, "p")
    return t.agg(F.count("*").alias("n"), F.avg(F.get("p", F.lit(0))).alias("p0"), F.avg(F.get("p", F.lit(2))).alias("p2"))


@query("select (case when o_orderkey%2=0 then o_orderkey::hugeint else 18446744073709551616::hugeint-o_orderkey end)::varchar as uid from orders")
def unsigned_keys(spark, sf):
    k = F.col("o_orderkey").cast("decimal(20,0)")
    t = fx.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, k).otherwise(F.lit("18446744073709551616").cast("decimal(20,0)") - k).cast("decimal(20,0)").cast("string").alias("u"))
    return t.select(sx.bit_pattern(F.col("u")).alias("k")).select(sx.unsigned(F.col("k")).cast("string").alias("uid"))


# --- ordered analytics and latents -----------------------------------------------------


@query(", e as (select quantile_cont(x,1/3.0) as e1, quantile_cont(x,2/3.0) as e2 from (select z[1] as x from fx_latent)) select (case when z[1]>=e2 then 2 when z[1]>=e1 then 1 else 0 end)::int as cut, count(*) as n, round(avg(z[1]), 6) as mean from fx_latent, e group by 1", "fx_latent")
def pc_cut_quantile(spark, sf):
    t = ordered.quantile_cut(fx.latent(spark, sf).withColumn("x", F.get("z", F.lit(0))), "x", 3)
    return t.groupBy("cut").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


NORM = "sqrt(z[1]*z[1]+z[2]*z[2]+z[3]*z[3]+z[4]*z[4])"


@query(f", s as (select avg({NORM})+2*stddev_pop({NORM}) as cut from fx_latent) select uid, round({NORM}, 6) as norm from fx_latent, s where {NORM}>=cut", "fx_latent")
def outlier_norm(spark, sf):
    return filters.outliers(fx.latent(spark, sf)).select("uid", "norm")


@query("select uid, hard from fx_latent where hard in (1,3,5) and z[1] between -0.1 and 0.1 and z[2] between -0.1 and 0.1", "fx_latent")
def cluster_box_filter(spark, sf):
    t = fx.latent(spark, sf).withColumn("a", F.get("z", F.lit(0))).withColumn("b", F.get("z", F.lit(1)))
    return filters.box(filters.clusters(t, [1, 3, 5], "hard"), {"a": (-0.1, 0.1), "b": (-0.1, 0.1)}).select("uid", "hard")


@query(f"select arg_max(hard, m)::int as junk from (select hard, avg({NORM}) as m from fx_latent group by 1)", "fx_latent")
def junk_component(spark, sf):
    return filters.junk_component(fx.latent(spark, sf), "hard")


@query("select hard as class, count(*) as n, round(avg(z[1]), 6) as mean, round(quantile_cont(z[1],0.5), 6) as median, round(stddev_pop(z[1]), 6) as sd, (row_number() over (order by avg(z[1]), hard)-1)::int as \"order\" from fx_latent group by 1", "fx_latent")
def class_order(spark, sf):
    return ordered.class_order(fx.latent(spark, sf).withColumn("pc1", F.get("z", F.lit(0))))


@query(", b as (select hard, least(greatest(round_even((z[1]+0.5)/0.25,0),0),4)::int as cx from fx_latent) select c.i::int as i, c.j::int as j, count(b.cx) as n, round(count(b.cx)/greatest(sum(count(b.cx)) over (partition by c.i),1)::double, 6) as value from (select i, j from range(10) a(i), range(5) b(j)) c left join b on b.hard=c.i and b.cx=c.j group by c.i, c.j", "fx_latent")
def basin_occupancy(spark, sf):
    t = fx.latent(spark, sf).withColumn("x", F.get("z", F.lit(0))).withColumn("basin", joins.grid_cell("x", -0.5, 0.25, 5))
    return confusion.hard_confusion(t, "hard", "basin", 10, 5)


@query(", b as (select least(floor((z[1]+0.5)/1.0*20),19)::int as bin from fx_latent where z[1]>=-0.5 and z[1]<=0.5) select bin, count(*) as n from b group by 1", "fx_latent")
def hist1d(spark, sf):
    return landscape.histogram(fx.latent(spark, sf).withColumn("x", F.get("z", F.lit(0))), "x", -0.5, 0.5, 20)


@query(", b as (select least(floor((z[1]+0.5)/1.0*8),7)::int as bx, least(floor((z[2]+0.5)/1.0*8),7)::int as \"by\" from fx_latent where z[1] between -0.5 and 0.5 and z[2] between -0.5 and 0.5) select bx, \"by\", count(*) as n from b group by 1,2", "fx_latent")
def hist2d(spark, sf):
    t = fx.latent(spark, sf).withColumn("x", F.get("z", F.lit(0))).withColumn("y", F.get("z", F.lit(1)))
    return landscape.histogram_2d(t, "x", "y", (-0.5, 0.5), (-0.5, 0.5), 8)


@query(", e as (select uid, z[1] as final, unnest([0,1,2]) as epoch, z from fx_latent), v as (select epoch::int as epoch, final, z[1]*epoch/2.0+z[2]*(2-epoch)/2.0 as v from e) select epoch, round(abs(corr(v,final)), 6) as corr, count(*) as n from v group by 1", "fx_latent")
def epoch_stability(spark, sf):
    t = fx.latent(spark, sf).select(F.get("z", F.lit(0)).alias("final"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("epoch"), F.get("z", F.lit(1)).alias("b"))
    return ordered.epoch_stability(t.withColumn("pc1", F.col("final") * F.col("epoch") / 2.0 + F.col("b") * (2 - F.col("epoch")) / 2.0))


@query(", t as (select * from fx_trainlog order by epoch desc limit 20) select count(*) as n, round(arg_min(loss,epoch), 6) as first, round(arg_max(loss,epoch), 6) as last, round((max(loss)-min(loss))/abs(arg_max(loss,epoch)), 6) as relative_range from t", "fx_trainlog")
def loss_tail(spark, sf):
    return ordered.loss_tail(fx.trainlog(spark, sf))


@query(", j as (select a.posterior, t.* from fx_prot_a a join fx_passthrough t using (uid)), u as (" + " union all ".join(f"select 'p{i}' as a, '{c}' as b, round(corr(posterior[{i + 1}],{c}), 6) as corr from j" for i in range(2) for c in ("alpha", "df1", "df2")) + ") select * from u", "fx_prot_a", "fx_passthrough")
def confound_corr(spark, sf):
    j = joins.select_rows(fx.prot_a(spark, sf), fx.passthrough(spark, sf)).withColumns({f"p{i}": F.get("posterior", F.lit(i)) for i in range(2)})
    return ordered.correlations(j, ["p0", "p1"], ["alpha", "df1", "df2"])


@query("select round(regr_r2(df2, df1), 6) as r2 from fx_passthrough", "fx_passthrough")
def confound_r2(spark, sf):
    r = latent.r_squared(fx.passthrough(spark, sf), "df2", ["df1"])
    return spark.createDataFrame([(r,)], "r2 double")


@query("select round(sqrt(avg(v*v)), 6) as rms, round(max(v), 6) as top from (select (z[1]-m)/s as v from fx_latent, (select avg(z[1]) as m, stddev_pop(z[1]) as s from fx_latent))", "fx_latent")
def standard_scaler(spark, sf):
    t = latent.standardise(fx.latent(spark, sf), "z", 4)[0].select(F.get("x", F.lit(0)).alias("v"))
    return t.agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.max("v").alias("top"))


# --- volumes ---------------------------------------------------------------------------


@query("select round(corr(va,vb), 6) as cc from fx_voxels", "fx_voxels")
def map_cc(spark, sf):
    return volumes.correlation(fx.voxels(spark, sf))


@query(", m as (select x,y,z, (va+vb)/2 as m from fx_voxels), c as (select quantile_cont(m,0.9) as c from m) select round(sqrt(avg((va-vb)*(va-vb))), 6) as rms from fx_voxels join m using (x,y,z), c where m.m>c.c", "fx_voxels")
def map_diff_rms(spark, sf):
    v = fx.voxels(spark, sf)
    maps = v.select(*volumes.AXES, F.lit("a").alias("map"), F.col("va").alias("v")).unionByName(v.select(*volumes.AXES, F.lit("b").alias("map"), F.col("vb").alias("v")))
    return volumes.difference(v, volumes.shared_mask(maps, 0.9))[1]


@query(", s as (select (va-vb)*(va-vb) as s from fx_voxels), c as (select quantile_cont(s,0.95) as c from s) select round(sum(case when s>=c then s else 0 end)/sum(s), 6) as top_share from s, c", "fx_voxels")
def map_localization(spark, sf):
    return volumes.localisation(volumes.difference(fx.voxels(spark, sf))[0])


@query(" union all ".join(f"select '{m}' as map, round(sum(v{m}/l), 6) as integrated, sum((v{m}/l>0.5)::int)::bigint as volume from fx_voxels, (select avg(v{m}) as l from fx_voxels where va>0.3 and vb>0.3)" for m in "ab"), "fx_voxels")
def map_core_density(spark, sf):
    v = fx.voxels(spark, sf)
    maps = v.select(*volumes.AXES, F.lit("a").alias("map"), F.col("va").alias("v")).unionByName(v.select(*volumes.AXES, F.lit("b").alias("map"), F.col("vb").alias("v")))
    return volumes.core_density(maps, setops.core_voxels(maps.withColumn("level", F.lit(0.3))))


@query("select round(max(cc), 6) as cc from (select corr(a.va, b.vb) as cc from fx_voxels a join (select *, unnest(range(8)) as f from fx_voxels) b on a.x=(case when f&1=1 then 11-b.x else b.x end) and a.y=(case when f&2=2 then 11-b.y else b.y end) and a.z=(case when f&4=4 then 11-b.z else b.z end) group by b.f)", "fx_voxels")
def map_best_flip(spark, sf):
    return volumes.best_flip(fx.voxels(spark, sf), 12).select("cc")


#: Fourier coefficients of both maps, term by term, at signed frequencies; shells by rounded radius
DFT = (
    "select kx, ky, kz, sum(va*cos(w)) as ra, sum(va*sin(w)) as ia, sum(vb*cos(w)) as rb, sum(vb*sin(w)) as ib from "
    "(select kx, ky, kz, va, vb, 2*pi()*((kx*x+ky*y+kz*z)%12)/12 as w from fx_voxels, range(-6,6) a(kx), range(-6,6) b(ky), range(-6,6) c(kz)) group by 1, 2, 3"
)


@query(f"select 'a-b' as pair, s as shell, round(s/12.0, 6)::double as freq, round(sum(ra*rb+ia*ib)/sqrt(sum(ra*ra+ia*ia)*sum(rb*rb+ib*ib)), 6) as fsc from (select *, round(sqrt(kx*kx+ky*ky+kz*kz))::bigint as s from ({DFT})) where s<=6 group by s", "fx_voxels")
def fsc(spark, sf):
    return volumes.fsc(fx.voxels(spark, sf).withColumn("pair", F.lit("a-b")))


# --- fitted models (checked against numpy in the tests) ---------------------------------


def _fit(spark, sf, **options):
    t = _alr(spark, sf).select("uid", "hard", "posterior", "x")
    return t, gmm.fit(t, "x", 2, K, **({"init": "hard"} | options))


@query()
def gmm_fit(spark, sf):
    f = _fit(spark, sf)[1]
    return spark.createDataFrame([(c, float(f.model.weights[c]), float(f.model.means[c, 0]), float(f.model.means[c, 1]), float(np.linalg.cond(f.model.covs[c])), f.bic, f.aic) for c in range(K)], "component int, weight double, mean0 double, mean1 double, cond double, bic double, aic double")


@query()
def gmm_bic_sweep(spark, sf):
    t = _alr(spark, sf).select("uid", "x")
    return spark.createDataFrame([tuple(r.values()) for r in gmm.bic_sweep(t, "x", 2, range(1, 7))], "k int, bic double, aic double, loglik double, converged boolean, min_weight double")


@query()
def class_repetition(spark, sf):
    t = _alr(spark, sf).select("uid", "hard", "x")
    rows = [(r["r"], c, w, r["bic"]) for r in gmm.repetition(t, "x", 2, K, range(4), init="hard", max_iter=300, tol=1e-4) for c, w in enumerate(r["weights"])]
    return spark.createDataFrame(rows, "r int, class int, weight double, bic double")


def _cells(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, value double")


@query()
def mc_confusion(spark, sf):
    m = _fit(spark, sf)[1].model
    return confusion.sampled_confusion(spark, m.weights, m.means, m.covs, 50_000)


@query()
def equalprior_confusion(spark, sf):
    m = _fit(spark, sf)[1].model
    return confusion.sampled_confusion(spark, m.weights, m.means, m.covs, 50_000, use_weights=False)


@query()
def analytic_multiclass(spark, sf):
    stats = confusion.moments_local(fx.prot_a(spark, sf), "hard", "posterior", K)
    return confusion.analytical_multiclass(spark, stats, K, 50_000)


@query()
def analytic_pairwise(spark, sf):
    return _cells(spark, confusion.analytical_pairwise(confusion.moments_local(fx.prot_a(spark, sf), "hard", "posterior", K), K))


@query()
def bhattacharyya_overlap(spark, sf):
    m = _fit(spark, sf)[1].model
    return _cells(spark, confusion.overlap(confusion.pairwise(m.means, m.covs)))


@query()
def bootstrap_ci(spark, sf):
    return resample.population_ci(fx.prot_a(spark, sf), K, 200)


@query()
def temperature(spark, sf):
    j = _both(spark, sf)
    target = j.agg(F.avg(sx.entropy(F.col("p_a"))).alias("h")).first().h
    return spark.createDataFrame([(float(target), ensemble.temperature(j, target, posterior="p_b", xtol=1e-3))], "target double, temperature double")


@query()
def free_energy_1d(spark, sf):
    t = latent.oriented_pca(fx.latent(spark, sf), "z", 4)
    grid = np.linspace(-0.6, 0.6, 200)
    f = landscape.free_energy_1d(t, "pc1", grid)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(grid, f, strict=True)], "x double, free_energy double")


@query()
def basins_2d(spark, sf):
    placed, _ = landscape.landscape(fx.latent(spark, sf), "z", 4, nx=60, ny=60)
    return confusion.hard_confusion(placed, "hard", "basin", 10, 1 + int(placed.agg(F.max("basin")).first()[0]))


@query()
def lda_axes(spark, sf):
    return latent.separability(fx.latent(spark, sf), "z", 4)


@query(
    "with m as (select " + ", ".join(f"covar_samp(embedding[{i}]::double, embedding[{j}]::double)+{0.0001 if i == j else 0.0} as c{i}{j}" for i in range(1, 5) for j in range(i, 5)) + " from embeddings), "
    # the squares are the roots of a quadratic whose product is the ratio of the determinants
    "q as (select c11*c22-c12*c12 as x, c33*c44-c34*c34 as y, abs(c13*c24-c14*c23) as p, "
    "(c22*(c44*c13*c13-2*c34*c13*c14+c33*c14*c14)-2*c12*(c44*c13*c23-c34*(c13*c24+c14*c23)+c33*c14*c24)+c11*(c44*c23*c23-2*c34*c23*c24+c33*c24*c24)) as t from m), "
    "r as (select sqrt(t/(x*y)/2+sqrt(greatest(t*t/(x*x*y*y)/4-p*p/(x*y), 0))) as big, p/sqrt(x*y) as prod from q) "
    "select 0::int as i, round(big, 6) as corr from r union all select 1::int, round(prod/big, 6) from r"
)
def cca(spark, sf):
    t = fx.latent(spark, sf).select(F.slice("z", 1, 2).alias("a"), F.slice("z", 3, 2).alias("b"))
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(latent.canonical_correlations(t, "a", 2, "b", 2))], "i int, corr double")


LG = lambda x: f"lgamma(({x})+1)"


@query(
    T + ", m as (select sum(n) as m from t), ra as (select i, sum(n) as a from t group by 1), rb as (select j, sum(n) as b from t group by 1), h as (select (select -sum(a/m*ln(a/m)) from ra, m) as ha, (select -sum(b/m*ln(b/m)) from rb, m) as hb, (select sum(n/m*ln(n*m/(a*b))) from t join ra using (i) join rb using (j), m) as mi), "
    f"e as (select sum(k/m*ln(m*k/(a*b))*exp({LG('a')}+{LG('b')}+{LG('m-a')}+{LG('m-b')}-{LG('m')}-{LG('k')}-{LG('a-k')}-{LG('b-k')}-{LG('m-a-b+k')})) as emi from (select a, b, m, unnest(range(greatest(1, a+b-m)::bigint, least(a,b)::bigint+1))::double as k from ra, rb, m)) select round((mi-emi)/((ha+hb)/2-emi), 6) as ami from h, e",
    "fx_prot_a", "fx_prot_b",
)
def ami(spark, sf):
    return spark.createDataFrame([(agreement.ami(agreement.contingency_local(_both(spark, sf), "hard_a", "hard_b")),)], "ami double")


@query(
    ", d as (select a.uid, a.hard as own, b.hard as other, avg(sqrt(" + "+".join(f"pow(a.z[{i}]-b.z[{i}],2)" for i in (1, 2, 3, 4)) + ")) as d from fx_latent a join fx_latent b on a.uid<>b.uid group by 1,2,3), s as (select uid, max(case when own=other then d end) as a, min(case when own<>other then d end) as b from d group by 1) select round(avg(case when a is null or b is null then 0 else (b-a)/greatest(a,b) end), 6) as silhouette from s",
    "fx_latent",
)  # the sample of 8,000 rows holds the whole table of every test scale
def silhouette(spark, sf):
    return agreement.silhouette(fx.latent(spark, sf), "z", "hard", 8_000)


@query()
def kmeans_representatives(spark, sf):
    t = fx.latent(spark, sf)
    _, centres = latent.kmeans(t, "z", 5)
    return joins.on_data(t, centres).select("centre", "uid")


@query()
def conditional_mean_path(spark, sf):
    t = latent.oriented_pca(fx.latent(spark, sf), "z", 4)
    return ordered.conditional_means(t, "pc1", "z", 4, [-0.2, 0.0, 0.2], 0.05, 50).select("bin", "n", F.get("mean", F.lit(0)).alias("m0"))


def queries() -> dict[str, Query]:
    from simplexa.plans import fitted_queries, more_queries  # noqa: F401  (register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from simplexa.plans import fitted_queries, more_queries  # noqa: F401

    return dict(ORACLES)
