"""Exports of large classes go to several files."""

import numpy as np

from simplexa.operators import exports
from simplexa.plans import catalog


def test_a_class_has_files_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "FILE_ROWS", 50)
    main = spark.range(1000).selectExpr("id as uid", "double(id) as w")
    twin = spark.range(1000).selectExpr("id as uid", "int(id * 2) as defocus")
    chosen = spark.range(1000).selectExpr("id as uid", "if(id < 40, 'a', 'b') as class")
    assert {r["class"]: r.n for r in exports.subset(chosen, main, str(tmp_path / "x"), twin=twin).collect()} == {"a": 40, "b": 960}
    assert len(list((tmp_path / "x/a/main").glob("*.cs"))) == 1
    files = sorted((tmp_path / "x/b/main").glob("*.cs"))
    assert len(files) == 20
    seen = []
    for f in files:
        a, b = np.load(f), np.load(str(f).replace("/main/", "/passthrough/"))
        assert a["uid"].tolist() == b["uid"].tolist() == sorted(a["uid"].tolist()) and len(a) < 150
        seen += a["uid"].tolist()
    assert sorted(seen) == list(range(40, 1000))


def test_rows_of_several_files_are_compared_in_order(spark, sf001, monkeypatch):
    query = catalog.queries()["subset_with_twin"]
    whole = {r["class"]: r for r in query(spark, sf001).collect()}
    monkeypatch.setattr(exports, "FILE_ROWS", max(r.n for r in whole.values()) // 3)
    rows = query(spark, sf001).collect()
    assert len(rows) == len(whole) > 1
    for r in rows:
        w = whole[r["class"]]
        assert (r.n, r.out_of_order) == (w.n, 0) and abs(r.defocus - w.defocus) < 1e-6 * abs(w.defocus)
