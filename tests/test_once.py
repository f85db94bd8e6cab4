"""Work that must not grow with repeats, nested expressions or counts."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.operators import agreement, em, ensemble, filters
from simplexa.plans import fixtures as fx


def test_filters_do_not_copy_nested_expressions(spark, sf001):
    strict = filters.above(fx.prot_a(spark, sf001), 0.6).groupBy("hard").count()
    plan = strict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FLOOR") + plan.count("floor") <= 2  # the weight is computed in one place


def test_normalise_computes_its_argument_once(spark):
    calls = spark.range(1).select(sx.normalise(sx.normalise(sx.normalise(F.array(F.lit(1.0), F.lit(3.0))))).alias("p"))
    assert calls.first().p == [0.25, 0.75]
    text = spark.range(1).select(sx.js(sx.normalise(F.array(F.col("id") + 1.0, F.lit(3.0))), F.array(F.lit(0.5), F.lit(0.5)))).columns[0]
    assert text.count("id") == 1


@pytest.mark.parametrize("x,y,n", [(3, 4, 10), (1, 1, 1000), (1, 1, 2), (5, 5, 5), (30, 1, 31), (200, 300, 1000), (1, 50, 50)])
def test_expected_information_by_all_terms(x, y, n):
    lg = math.lgamma
    fixed = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
    want = sum(m / n * math.log(n * m / (x * y)) * math.exp(fixed - lg(m + 1) - lg(x - m + 1) - lg(y - m + 1) - lg(n - x - y + m + 1)) for m in range(max(1, x + y - n), min(x, y) + 1))
    assert agreement._expected_cell(x, y, n) == pytest.approx(want, rel=1e-8, abs=1e-15)


def test_expected_information_of_large_counts_is_quick():
    t = time.time()
    agreement.ami(np.full((3, 3), 2.0e7) + np.eye(3) * 1e6)
    assert time.time() - t < 5  # it took a term for each possible count


def _repeated(spark, n=6000):
    v = F.array((F.col("id") % 7 - 3.0) + (F.col("id") % 3) * 0.1, (F.col("id") % 5) * 0.5)
    return spark.range(n).select(F.col("id").alias("uid"), v.alias("x"))


START = (np.array([0.5, 0.5]), np.array([[-1.0, 0.0], [1.0, 1.0]]), np.array([np.eye(2)] * 2))


def test_fit_passes_over_different_vectors(spark):
    df = _repeated(spark)
    rows = em.columns(df, "x", 2)
    few = em.collapsed(rows, 2)
    assert few.count() == 105 and few.agg(F.sum("w")).first()[0] == 6000
    a, b = em.expectation(rows, {0: START}, 2)[0], em.expectation(few, {0: START}, 2, "w")[0]
    assert np.allclose(a, b, rtol=1e-12)
    assert em.fit(df, "x", 2, [START], max_iter=5)[0]["n"] == 6000


def test_replicates_pass_over_different_vectors(spark):
    rows = em.columns(_repeated(spark), "x", 2, "uid")
    few = em.collapsed_replicates(rows, 2, 3, seed=4, live=50)
    assert few.count() == 105
    models = dict.fromkeys(range(3), START)
    a, b = em.expectation(rows, models, 2, reps=True, seed=4), em.expectation(few, models, 2, reps=True, seed=4, drawn=True)
    assert all(np.allclose(a[m], b[m], rtol=1e-10) for m in models)
    assert em.collapsed_replicates(em.columns(spark.range(100).select(F.col("id").alias("uid"), F.array(F.col("id") * 1.5).alias("x")), "x", 1, "uid"), 1, 30, 0) is None


def test_mean_entropies_as_by_columns(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1],), ([1.0, 0.0, 0.0],), ([0.5, 0.5],), (None,)], "posterior array<double>")
    ts = [0.01, 1.0, 30.0]
    want = [df.agg(F.avg(sx.entropy(sx.soften(F.col("posterior"), t)))).first()[0] for t in ts]
    assert ensemble.mean_entropies(df, ts) == pytest.approx(want, abs=1e-12)


def test_divergences_to_the_last_bit(spark, sf01):
    """Every divergence as DuckDB computes it, so that ties at a percentile fall on the same side."""
    import duckdb

    from simplexa.operators import joins
    from simplexa.plans import catalog

    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf01}/lineitem.parquet'")
    want = dict(con.execute(fx.with_views(catalog.JS + "select uid, js from d", "fx_prot_a", "fx_prot_b")).fetchall())
    both = joins.two_experts(fx.prot_a(spark, sf01), fx.prot_b(spark, sf01, c_library=True))
    assert {r.uid: r.js for r in filters.divergences(both).select("uid", "js").collect()} == want
    odd = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), (None, [1.0, 0.0])], "p_a array<double>, p_b array<double>")
    assert [r.js for r in filters.divergences(odd).collect()] == [0.0, None]
