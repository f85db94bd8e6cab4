"""Readers, writers and the stream."""

import pathlib
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.functions import simplex as sx
from simplexa.plans import fixtures as fx
from simplexa.operators import confusion, exports
from simplexa.sources import formats
from simplexa.streaming import populations as stream


def table(n=100):
    t = np.zeros(n, [("uid", "u8"), ("alignments3D_multi/class_posterior", "f4", (3,)), ("blob/path", "S20"), ("alignments3D/split", "u4")])
    t["uid"] = np.arange(n, dtype="u8") + np.uint64(2**64 - 200)
    t["alignments3D_multi/class_posterior"] = np.random.default_rng(0).random((n, 3))
    t["blob/path"] = b"a.mrc"
    return t


def test_cs_round_trip(spark, tmp_path):
    t = table()
    with open(tmp_path / "in.cs", "wb") as f:
        np.save(f, t)
    df = formats.read_cs(spark, str(tmp_path / "in.cs"), row_id=True)
    assert df.count() == 100
    assert {int(r.u) for r in df.select(sx.unsigned(F.col("uid")).alias("u")).collect()} == set(map(int, t["uid"]))
    assert formats.uids(spark, str(tmp_path / "in.cs")).columns == ["uid"]
    df.drop("row_id").repartition(2).write.format("cs").option("path", str(tmp_path / "out")).mode("append").save()
    parts = [np.load(p) for p in sorted((tmp_path / "out").glob("*.cs"))]
    back = np.concatenate(parts)
    assert sorted(back["uid"].tolist()) == sorted(t["uid"].tolist())


def test_cs_scan_pushes_comparisons(spark, tmp_path):
    t = table(500)
    t["alignments3D/split"] = np.arange(500) % 7
    with open(tmp_path / "in.cs", "wb") as f:
        np.save(f, t)
    df = formats.read_cs(spark, str(tmp_path / "in.cs"), row_id=True)
    split = F.col("`alignments3D/split`")
    kept = df.where((split >= 2) & split.isin(2, 5) & (F.col("row_id") < 400) & (F.col("uid") < -5) & (F.col("`blob/path`") == "a.mrc"))
    want = [i for i in range(400) if i % 7 in (2, 5) and int(t["uid"][i].astype(np.int64)) < -5]
    assert sorted(r.row_id for r in kept.collect()) == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "row_id" in plan and "400" not in plan.split("BatchScan")[0]  # the comparison runs in the scan
    row = df.where("row_id = 3").first()
    assert row["alignments3D_multi/class_posterior"] == t["alignments3D_multi/class_posterior"][3].tolist()


def test_cs_sink_commits_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, [float(i), 0.5], "é" * (i % 3)) for i in range(50)], "uid long, z array<double>, name string").repartition(3)
    formats.write_cs(df, out)
    formats.write_cs(df.limit(7), out)  # replaces
    back = formats.read_cs(spark, out)
    assert back.count() == 7 and {(r.uid, tuple(r.z), r.name) for r in back.collect()} <= {(r.uid, tuple(r.z), r.name) for r in df.collect()}
    formats.write_cs(df, out, overwrite=False)
    assert formats.read_cs(spark, out).count() == 57
    bad = df.withColumn("z", F.when(F.col("uid") == 20, F.array(F.lit(1.0))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="one length"):
        formats.write_cs(bad, out, overwrite=False)
    assert formats.read_cs(spark, out).count() == 57 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_staging")]


def test_subset_with_twin(spark, tmp_path):
    main = spark.createDataFrame([(i, float(i)) for i in range(60)], "uid long, w double").repartition(4)
    twin = spark.createDataFrame([(i, i * 2) for i in range(5, 70)], "uid long, defocus int").repartition(2)
    chosen = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(0, 80, 3)], "uid long, class string")
    counts = {r["class"]: r.n for r in exports.subset(chosen, main, str(tmp_path / "x"), twin=twin, files=2).collect()}
    ids = [i for i in range(0, 60, 3) if i >= 5]
    assert counts == {"a": sum(i % 2 == 0 for i in ids), "b": sum(i % 2 == 1 for i in ids)}
    for c in "ab":
        files = sorted((tmp_path / "x" / c / "main").glob("*.cs"))
        assert len(files) == len(list((tmp_path / "x" / c / "passthrough").glob("*.cs")))
        for f in files:
            a, b = np.load(f), np.load(str(f).replace("/main/", "/passthrough/"))
            assert a["uid"].tolist() == b["uid"].tolist() == sorted(a["uid"].tolist()) and a.dtype.names == ("uid", "w") and b.dtype.names == ("uid", "defocus")


def test_matrices_by_ranges(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 3)).astype("f4")
    np.save(tmp_path / "x.npy", x)
    np.savez(tmp_path / "x.npz", a=x, b=np.arange(5))
    np.savez_compressed(tmp_path / "c.npz", a=x)
    for path, key in (("x.npy", None), ("x.npz", "a"), ("c.npz", "a")):
        df = formats.read_matrix(spark, str(tmp_path / path), "m", key)
        got = {r.row_id: r.m for r in df.collect()}
        assert np.array_equal(np.array([got[i] for i in range(1000)]), x.astype(float))
    assert [r.z for r in formats.read_matrix(spark, str(tmp_path / "x.npz"), key="b").orderBy("row_id").collect()] == [[float(i)] for i in range(5)]
    reader = formats.MatrixReader(str(tmp_path / "x.npz"), "a", 100)
    assert len(reader.partitions()) == 10  # a stored member is cut into ranges
    for i in range(2):
        with open(tmp_path / f"z.{i}.pkl", "wb") as f:
            pickle.dump(x[: 10 + i], f)
    z = formats.read_pickle(spark, str(tmp_path / "z.*.pkl"))
    assert z.groupBy("path").count().count() == 2 and z.count() == 21
    with open(tmp_path / "bad.pkl", "wb") as f:
        pickle.dump(pathlib.Path("x"), f)
    with pytest.raises(Exception, match="is not an array"):
        formats.read_pickle(spark, str(tmp_path / "bad.pkl")).count()


def test_mrc_round_trip(spark, tmp_path):
    v = np.random.default_rng(1).random((3, 4, 5)).astype("f4")
    (tmp_path / "a.mrc").write_bytes(formats.mrc_bytes(v, 1.5))
    got, voxel = formats.parse_mrc((tmp_path / "a.mrc").read_bytes())
    assert np.array_equal(got, v) and abs(voxel - 1.5) < 1e-6
    df = formats.read_mrc(spark, str(tmp_path / "*.mrc"))
    assert df.count() == v.size and abs(df.where("z = 2 and y = 3 and x = 4").first().v - float(v[2, 3, 4])) < 1e-7


def test_matrix_log_epochs(spark, tmp_path):
    np.save(tmp_path / "z.npy", np.arange(5.0))
    assert formats.read_matrix(spark, str(tmp_path / "z.npy")).where("row_id = 3").first().z == [3.0]
    lines = spark.createDataFrame([("# =====> Epoch: 1 Average gen loss = 1.5, KLD = 0.25, total loss = 1.75; Finished",), ("noise",)], "value string")
    assert formats.training_log(lines).collect()[0].asDict() == {"epoch": 1, "gen_loss": 1.5, "kld": 0.25, "total_loss": 1.75}
    names = spark.createDataFrame([(f"run/z.{i}.pkl",) for i in range(30)] + [("run/x.pkl",)], "name string")
    kept = [r.epoch for r in formats.epoch_files(names).orderBy("epoch").collect()]
    assert len(kept) == 12 and kept[0] == 0 and kept[-1] == 29
    assert formats.labels_or_default(["a"], 2) == ["C0", "C1"] and formats.corrected_kinds(["corrected_soft", "x"]) == ["soft"]


def test_names(spark):
    t = spark.createDataFrame([("x/P12_a.cs",), ("x/other.cs",)], "n string")
    assert [r[0] for r in t.select(sx.class_of_file(F.col("n"))).collect()] == ["P12", "other"]
    assert sx.parse_pairs("6-10,8-9") == [(6, 10), (8, 9)]


def test_stream_equals_batch(spark, sf001, tmp_path):
    batch = fx.prot_a(spark, sf001).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(F.col("uid") % 300).cast("int"))).cache()
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.class_sums(s, 3, late="10 hours").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.i, r.j): r.value for r in stream.confusion_of(spark.table("sums"), 3).collect()}
    want = {(r.i, r.j): r.value for r in confusion.soft_posterior_confusion(batch, 3).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_cs_strings_whole(spark, tmp_path):
    """Text of any length and alphabet is written whole, alone and in arrays."""
    texts = ["", "x" * 300, "é" * 400, "μ.mrc"]
    df = spark.createDataFrame([(i, t, [t, "a"]) for i, t in enumerate(texts)], "uid long, path string, both array<string>").coalesce(1)
    df.write.format("cs").option("path", str(tmp_path / "out")).mode("append").save()
    rows = formats.read_cs(spark, str(next((tmp_path / "out").glob("*.cs"))), columns=["uid", "path"]).collect()
    assert {r.uid: r.path for r in rows} == dict(enumerate(texts))
    back = np.load(next((tmp_path / "out").glob("*.cs")))
    assert [x.decode() for x in back["both"][:, 0]] == texts
