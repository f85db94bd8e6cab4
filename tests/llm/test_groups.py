"""Exact dedup, centroid clustering and phrases, against brute force and odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from simplexa.llm import centroid_clustering, exact_dedup, phrases, queries
from simplexa.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, digest int, bucket string, size double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, 1, "x", 0.5) for i, t, lang in rows], DOCS).repartition(parts)


def lower(t):
    return (t or "").translate(phrases.UPPER)


# --- the registered queries --------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_centroid_clustering", "op13_phrase_collocations"])
def test_oracle(spark, sf01, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf01}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    got = queries.queries()[name](spark, sf01)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(x[c] for c in names) for x in got.collect()))) == sorted(map(str, r.fetchall()))


# --- exact dedup -------------------------------------------------------------------------


def test_perfect_hash_is_minimal_and_byte_checked():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    keys[:500, :3] = keys[0, :3]  # apart in the last word alone
    h = exact_dedup.PerfectHash.build(keys)
    assert sorted(h(keys)) == list(range(len(keys)))
    assert len(exact_dedup.PerfectHash.build(keys[:0]).levels) == 0
    strange = h(rng.integers(0, 1 << 63, (1000, 4), dtype=np.uint64))
    assert (strange >= 0).any()  # a slot alone proves nothing


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    ids = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, ids[lower(t)], len(groups[lower(t)]), i == ids[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows)


def test_exact_dedup(spark):
    rows = [(i, f"Text {i % 700}" if i % 2 else f"text {i % 700}", "en") for i in range(3000)]
    rows += [(i, "The same Everywhere", "en") for i in range(3000, 6000)]
    rows += [(7000, None, None), (7001, "", "en"), (7001, "", "en"), (None, "alone", "en"), (None, "text 3", "en"), (7002, "É", "fr"), (7003, "é", "fr"), (7004, "x " * 300_000, "en"), (7005, "X " * 300_000, "en"), (7006, "a\x00b", "en")]
    df = frame(spark, rows)
    for batches in (1, 3):
        got = Counter(tuple(r) for r in exact_dedup.dedup(df, batches=batches).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
        assert got == expected(rows)
    assert exact_dedup.dedup(df.limit(0)).count() == 0
    stay = exact_dedup.keep(df)
    assert stay.columns == df.columns and {lower(r.text) for r in stay.collect()} == {lower(t) for _, t, _ in rows}


def test_index_is_kept_between_batches(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET", 64)  # several buckets, split as the index grows
    scratch = Scratch(spark, "kept")
    first, second = [(i, f"t{i}", "en") for i in range(100)], [(i + 1000, f"T{i}", "en") for i in range(50, 900)]
    index = None
    for rows in (first, second):
        index = exact_dedup.ingest(scratch, index, exact_dedup.digests(frame(spark, rows)), len(rows))
    assert index.power > 0
    index = exact_dedup.Index(spark, index.entries_path, index.index_path, index.power, index.rows)  # opened again
    index = exact_dedup.ingest(scratch, index, exact_dedup.digests(frame(spark, [(5, "t899", "en"), (5000, "T0", "en")])), 2)
    entries = {bytes(r.digest): (r.winner, r["size"]) for r in index.entries.collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert len(entries) == 900
    assert entries[digest("t0")] == (5000, 2) and entries[digest("t60")] == (1060, 2) and entries[digest("t899")] == (1899, 2) and entries[digest("t20")] == (20, 1)
    scratch.drop()


# --- centroid clustering -----------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, dim=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    x = np.array([np.floor(1024 * np.array(v, np.float64)) for _, v in kept]).astype(object)
    key = lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), list(kept[j][1]))
    c = [list(x[j]) for j in sorted(range(len(kept)), key=key)[:k]]
    for r in range(rounds + 1):
        d = np.array([[int(((v - np.array(m, object)) ** 2).sum()) for m in c] for v in x], object)
        label = [min(range(len(c)), key=lambda m: (row[m], m)) for row in d]
        if r < rounds:
            for m in range(len(c)):
                mine = [v for v, q in zip(x, label, strict=True) if q == m]
                if mine:
                    c[m] = [int(sum(w)) // len(mine) for w in zip(*mine, strict=True)]
    total = Counter()
    for q, row in zip(label, d, strict=True):
        total[q] += row[q]
    sha = [hashlib.sha256(",".join(str(int(w)) for w in m).encode()).hexdigest() for m in c]
    return Counter((i, q, row[q], total[q], sum(total.values()), sha[q]) for (i, _), q, row in zip(kept, label, d, strict=True))


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, block long").repartition(parts)


def clustered(df, **k):
    return Counter(tuple(r[c] for c in COLUMNS) for r in centroid_clustering.cluster(df, **k).collect())


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 64))
    x = (centres[rng.integers(0, 6, 700)] + rng.normal(0, 0.4, (700, 64))).astype(np.float32)
    x[100:300] = x[0]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] * 64), (904, [float("inf")] * 64), (905, [0.0] * 64), (None, [0.5] * 64), (3, x[9].tolist())]
    work = []
    assert clustered(vectors(spark, rows), work=work) == lloyd(rows)
    assert work[0] == 703 and min(work[1:]) < 703 / 2  # the bounds spare scans


def test_ties_go_to_the_smaller_cluster(spark):
    rows = [(i, [float((i % 3) - 1)] * 2 + [0.0] * 62) for i in range(40)]
    assert clustered(vectors(spark, rows)) == lloyd(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [0.1 * i] * 64) for i in range(3)]
    assert clustered(vectors(spark, rows)) == lloyd(rows)
    assert clustered(vectors(spark, rows).limit(0)) == Counter()
    with pytest.raises(Exception, match="64-bit"):
        clustered(vectors(spark, [(1, [3e38] * 64)]))


# --- phrases -----------------------------------------------------------------------------


def plain(rows, longest=5, least=3, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for part in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", part)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[s : s + k]) for s in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= 100 * a and any(q[s : s + len(p)] == p for s in range(len(q))) for q, b in count.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return out


def mined(df, **k):
    return {tuple(r) for r in phrases.mine(df, **k).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_phrases_equal_plain_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_CHARS", 2_000)  # several chunks a task
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 300)
    rng = np.random.default_rng(seed)
    words = ["The", "of", "a", "sea", "Über", "x\x00y", "b-c", "rare", "\xa0", "…"]
    rows = []
    for i in range(150):
        text = "".join(words[rng.integers(0, len(words)) if rng.random() < 0.6 else 0] + rng.choice([" ", "  ", "\t", ". ", ",", "\n"], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]) for _ in range(rng.integers(0, 40)))
        rows.append((i, text, [None, "en", "de", "und"][rng.integers(0, 4)]))
    rows += [(1, "new york city hall is the new york city hall", "en")] * 9 + [(200, None, "en"), (201, "", None), (None, " \t ", "en"), (202, "a " * 3000, "fr")]
    df = frame(spark, rows)
    assert mined(df, least=3) == plain(rows)
    assert mined(df, least=3, top=5) == plain(rows, top=5)
    assert mined(df, least=2, longest=2) == plain(rows, least=2, longest=2)
    assert mined(df.limit(0)) == set()


def test_scores_beyond_64_bits(spark):
    n, a = 10**13, 9 * 10**12
    got = spark.sql(f"select (cast({a} as decimal(17,0)) * cast({n} as decimal(17,0)) * cast(1000 as decimal(4,0))) div (cast({a} as decimal(18,0)) * cast({a + 1} as decimal(18,0)))").first()[0]
    assert got == 1000 * a * n // (a * (a + 1))


def test_counting_out_of_core(spark):
    df = spark.range(200_000).selectExpr("'en' as lang", "concat('some phrase that is fairly long ', id % 60000) as phrase", "1L as f")
    small = phrases.counted(df, 4, memory="32MB")
    assert small.count() == 20_000 and {r.f for r in small.select("f").distinct().collect()} == {4}


def test_filter_never_denies():
    names = [f"w{i} x" for i in range(500)]
    h = phrases._phrase_hashes(["en"] * 500, names)
    bits = 14
    data = np.zeros(1 << (bits - 6), np.uint64)
    for p in phrases._places(h, bits):
        np.bitwise_or.at(data, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    f = phrases.Filter(bits, data)
    assert f(h).all() and f(phrases._phrase_hashes(["de"] * 500, names)).mean() < 0.1
