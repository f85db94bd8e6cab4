"""Every query with an oracle against DuckDB; the entry point."""

import duckdb
import pytest

from simplexa.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def con(sf01):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf01}/{t}.parquet'")
    return c


def clean(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, sf01, name):
    df = catalog.queries()[name](spark, sf01)
    r = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    types = {d[0]: TYPES[str(d[1])] for d in r.description}
    assert types == dict(df.dtypes)
    cols = sorted(names)
    key = lambda row: [(v is None, str(type(v)), v if isinstance(v, str | bool | int) else 0) for v in row] + [v for v in row if isinstance(v, float)]
    want = sorted([tuple(clean(x[names.index(c)]) for c in cols) for x in r.fetchall()], key=key)
    got = sorted([tuple(clean(x[c]) for c in cols) for x in df.collect()], key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sample_sizes_of_the_reference(monkeypatch):
    from unittest.mock import MagicMock

    from simplexa.plans import catalog

    asked = {}
    monkeypatch.setattr(catalog.agreement, "silhouette", lambda t, z, label, rows: asked.setdefault("silhouette", rows) and MagicMock())
    monkeypatch.setattr(catalog.fx, "latent", lambda spark, sf: None)
    monkeypatch.setattr(catalog.confusion, "moments_local", lambda *a: None)
    monkeypatch.setattr(catalog.confusion, "analytical_multiclass", lambda spark, stats, k, n: asked.setdefault("multiclass", n) and MagicMock())
    monkeypatch.setattr(catalog.fx, "prot_a", lambda spark, sf: None)
    monkeypatch.setattr(catalog, "_fit", lambda *a, **k: (None, type("R", (), {"model": type("M", (), {"weights": 0, "means": 0, "covs": 0})})))
    monkeypatch.setattr(catalog.confusion, "sampled_confusion", lambda spark, w, m, c, n, use_weights=True: asked.setdefault(("sampled", use_weights), n) and MagicMock())
    for name in ("silhouette", "analytic_multiclass", "mc_confusion", "equalprior_confusion"):
        catalog.queries()[name](MagicMock(), "")
    assert asked == {"silhouette": 8_000, "multiclass": 50_000, ("sampled", True): 50_000, ("sampled", False): 50_000}
