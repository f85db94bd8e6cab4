"""Operators over a whole corpus, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

from simplexa.llm import ann, decontam, fm_index, jaccard_join, line_dedup, lm, substring_dedup
from simplexa.llm.components import connected_components

EXTRA = "doc_id long, text string, doc string, comp int, key double"


def odd(rows):
    return [(i, t, "x", 1, 0.5) for i, t in rows]


# --- components ------------------------------------------------------------------------


def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(99, i) for i in range(50)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], "none": []}[kind]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = groups([e for e in edges if e[0] != e[1]])
    assert {r.v: r.comp for r in connected_components(df).collect()} == want


# --- passages --------------------------------------------------------------------------


def brute_passages(docs, window):
    first, out = {}, []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        w, gone = (text or "").encode().split(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first.setdefault(k, (i, s)) != (i, s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.mark.parametrize("letters,batches", [(3, 1), (40, 3), (40, 7)])
def test_passages(spark, letters, batches):
    rng = random.Random(letters)
    base = [f"w{rng.randrange(letters)}" for _ in range(60)]
    docs = [(None, " ".join(base[:30])), (500, None), (501, ""), (502, "a b")]
    for i in range(30):
        w = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(0, 50))]
        a = rng.randint(0, 40)
        w[5:5] = base[a : a + rng.randint(5, 30)]
        docs.append((i, " \t".join(w)))
    df = spark.createDataFrame(odd(docs), EXTRA).repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, window=8, anchor=4, batches=batches, max_runs=2).collect()]
    assert by_id(got) == by_id(brute_passages(docs, 8))


def test_passages_repeated_rows_and_text(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x a b c d e f")]
    got = substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), window=4, anchor=2, texts=True).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got) == [(1, 0, "a b c d e f"), (1, 0, "a b c d e f"), (2, 6, "x")]
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- lines -----------------------------------------------------------------------------


def edit(a, b):
    return duckdb.execute("select levenshtein(?, ?)", [a, b]).fetchone()[0]


def brute_lines(docs, similarity):
    """The occurrences to drop, by edit similarity of all pairs alone."""
    occ = defaultdict(list)
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if w := tuple(re.findall(r"[^\W_]+", line.lower())):
                occ[w].append((i, n))
    classes, edges = list(occ), []
    for i, a in enumerate(classes):
        for b in classes[:i]:
            x, y = " ".join(a), " ".join(b)
            if edit(x, y) <= int((1 - similarity) * max(len(x), len(y)) + 1e-9):
                edges.append((a, b))
    comp = groups(edges)
    first = {}
    for c in classes:
        g = comp.get(c, c)
        first[g] = min([*occ[c], *([first[g]] if g in first else [])])
    return {o for c in classes for o in occ[c] if o != first[comp.get(c, c)]}


def test_lines(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(n)) for n in (3, 8, 30, 30, 90, 300)]
    docs = [(900, None), (901, ""), (902, "...\n\n!!"), (903, "end\n...\nEND!")]
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, r = rng.randrange(len(w)), rng.random()
                if r < 0.5:
                    w[k] = f"w{rng.randint(0, 300)}"
                elif r < 0.75:
                    w.insert(k, "ins")
                elif len(w) > 1:
                    del w[k]
            lines.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w) + rng.choice(["", "."]))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(odd(docs), EXTRA)
    whole = brute_lines(docs, 0.85)
    want = {(r.doc, p) for r in line_dedup.removed_lines(df).collect() for p in r.gone}
    assert want <= whole and len(want) >= 0.95 * len(whole)
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    for r in out.collect():
        text = dict(docs)[r.doc_id]
        assert r.text == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (r.doc_id, n) not in want))
    rep = {r.doc_id: r for r in line_dedup.report(df).collect()}
    assert rep[903].n_lines == 3 and rep[903].n_removed == 1 and rep[900].n_lines == 0
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_lines_of_the_test_table(spark, sf001):
    """Recall on real lines: all pairs that share two words in a row, by edit similarity alone."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    rows = defaultdict(list)
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if w := tuple(re.findall(r"[^\W_]+", line.lower())):
                rows[w].append((i, n))
    lines, near = list(rows), defaultdict(set)
    for k, w in enumerate(lines):
        for j in range(max(1, len(w) - 1)):
            near[w[j : j + 2]].add(k)
    text = [" ".join(w) for w in lines]
    pairs = {(a, b) for v in near.values() for a in v for b in v if a < b and abs(len(text[a]) - len(text[b])) <= 0.15 * max(len(text[a]), len(text[b])) and len(set(lines[a]) & set(lines[b])) >= 0.6 * max(len(set(lines[a])), len(set(lines[b])))}
    comp = groups([(a, b) for a, b in pairs if len(text[a]) < 3000 and edit(text[a], text[b]) <= int(0.15 * max(len(text[a]), len(text[b])) + 1e-9)])
    first = {}
    for k, w in enumerate(lines):
        first[comp.get(k, k)] = min([*rows[w], *([first[comp.get(k, k)]] if comp.get(k, k) in first else [])])
    whole = {o for k, w in enumerate(lines) for o in rows[w] if o != first[comp.get(k, k)]}
    got = {(r.doc, p) for r in line_dedup.removed_lines(spark.read.parquet(f"{sf001}/documents.parquet")).collect() for p in r.gone}
    assert len(got & whole) >= 0.95 * len(whole)


def test_lines_of_a_large_near_group(spark):
    """Copies of one line with a few words changed: more than one round of hubs; unrelated lines share a block."""
    rng = random.Random(9)
    base = [f"word{rng.randrange(10**6)}" for _ in range(40)]
    near = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"word{rng.randrange(10**6)}"
        near.append(" ".join(w))
    other = [" ".join(sorted(base)[:6] + [f"else{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(20)]
    docs = list(enumerate(near + other))
    got = {(r.doc, p) for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() for p in r.gone}
    whole = brute_lines(docs, 0.85)
    assert got <= whole and len(got) >= 0.95 * len(whole)


def test_block_simhash(spark):
    rng = random.Random(6)
    rows = [([rng.getrandbits(62) for _ in range(4)],) for _ in range(20)]
    got = spark.createDataFrame(rows, "h array<long>").select("h", *[line_dedup.simhash([F.col("h")[j] for j in range(n)]).alias(f"s{n}") for n in (1, 2, 3, 4)]).collect()
    for r in got:
        for n in (1, 2, 3, 4):
            assert r[f"s{n}"] == sum(1 << b for b in range(62) if sum(x >> b & 1 for x in r.h[:n]) > n // 2)


# --- shingles --------------------------------------------------------------------------


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_join(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(sets)
    edges = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = groups(edges)
    return {i: (len(sets[i]), comp.get(i, i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_join(spark, n, percent):
    rng = random.Random(percent)
    docs = [(5000, None), (5001, ""), (5002, " \t")]
    for size in (1, 2, 3, 20, 60, 150, 300):
        cur = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(rng.randint(2, 9)):
            for _ in range(rng.randint(0, max(1, size // 25))):
                cur[rng.randrange(len(cur))] = f"w{rng.randint(0, 400)}"
            docs.append((len(docs), " ".join(cur)))
    rng.shuffle(docs)
    out, _ = jaccard_join.join(spark.createDataFrame(odd(docs), EXTRA).repartition(4), shingle=n, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_join(docs, n, percent)


def test_join_near_copies(spark):
    """One large group of near copies: most do not link, and chains between them count."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base if rng.random() < 0.7 else docs[rng.randrange(len(docs))][1].split())
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(w))
            if rng.random() < 0.7:
                w[k] = f"n{rng.randint(0, 10**6)}"
            elif rng.random() < 0.5:
                w.insert(k, f"n{rng.randint(0, 10**6)}")
            else:
                del w[k]
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base)) for i in range(30)]
    out, _ = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_join(docs, 3, 90)


def test_join_late_copies_behind_unlinked_variants(spark):
    """Copies of the first document whose signatures are all headed by variants in their own task."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 241):
        w, k = list(base), rng.randrange(2, 112)
        w[k : k + 6] = [f"n{i}x{j}" for j in range(6)]
        docs.append((i, " ".join(w)))
    tasks = [docs[:61], *([*docs[1 + 60 * t : 61 + 60 * t], *[(1000 * t + c, " ".join(base)) for c in range(3)]] for t in (1, 2, 3))]
    rows = [d for task in tasks for d in task]
    df = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)).flatMap(lambda t: t), "doc_id long, text string")
    out, _ = jaccard_join.join(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_join(rows, 3, 90)


def test_join_null_ids_and_keep(spark):
    docs = [(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (1, "a b c d"), (3, "")]
    df = spark.createDataFrame(odd(docs), EXTRA)
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.join(df)[0].collect())
    assert [r[:2] for r in rows] == [(-1, 2), (1, 2), (1, 2), (2, 2), (3, 0)] and rows[0][2] is None and rows[3][2] == 1
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 1, 3]
    assert jaccard_join.join(df.limit(0))[0].count() == 0


# --- benchmark -------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(docs, bench, window):
    pats = defaultdict(set)
    for i, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(len(w) - min(window, len(w)) + 1 if w else 0):
            pats[tuple(w[k : k + min(window, len(w))])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, its = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in pats:
                    hit.update(range(k, k + n))
                    its |= pats[p]
        out.append((i, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [20, 10**6])
def test_benchmark(spark, block):
    rng = random.Random(block)
    letters = [f"w{i}" for i in range(6)] + ["É", "x_Y", "1"]
    docs = [(900, None), (901, ""), (None, "w1 w2 w3")] + [(i, rng.choice([" ", ", "]).join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(25)]
    bench = [(None, "w1 w2"), (1, None), (2, " - "), (3, "w1")] + [(10 + i, " ".join(rng.choice(letters).upper() for _ in range(rng.randint(1, 14)))) for i in range(8)]
    d, b = spark.createDataFrame(odd(docs), EXTRA), spark.createDataFrame(bench, "item_id long, text string")
    got = [tuple(r) for r in decontam.find(d, b, window=4, shard_words=50, block_bytes=block).collect()]
    assert by_id(got) == by_id(brute_hits(docs, bench, 4))
    cut = decontam.remove(d, b.where("item_id >= 10"), window=4, block_bytes=block)
    assert cut.columns == d.columns and cut.count() == len(docs)
    assert decontam.find(d, b.limit(0)).where("contaminated").count() == 0 and decontam.find(d.limit(0), b).count() == 0


def test_remove_keeps_the_rest(spark):
    d = spark.createDataFrame([(1, "Keep this. One TWO, three four! And that.", 7)], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontam.remove(d, b).first().text == "Keep this. ! And that."


def test_remove_over_blocks(spark):
    """Passages of different blocks overlap, and a cut would join words into a window the text never held."""
    docs = [(1, "x a b c d e f y"), (2, "p q a b c d r s"), (3, "plain"), (4, None)]
    bench = [(10, "a b c d"), (11, "c d e f"), (12, "p q r s")]
    d, b = spark.createDataFrame(odd(docs), EXTRA), spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    for block in (4, 10**6):
        cut = decontam.remove(d, b, window=4, block_bytes=block)
        assert cut.columns == d.columns
        assert {r.doc_id: r.text for r in cut.collect()} == {1: "x  y", 2: "p q  r s", 3: "plain", 4: None}


def test_long_items_are_cut_without_loss(spark):
    """One item far above the size of a block, in pieces that share all but a word of a window."""
    rng = random.Random(3)
    long = [f"w{rng.randint(0, 30)}" for _ in range(400)]
    docs = [(i, " ".join(long[k : k + n])) for i, (k, n) in enumerate((rng.randint(0, 380), rng.randint(1, 30)) for _ in range(60))]
    bench = [(1, " ".join(long)), (2, "w1 w2"), (2, "w1 w2")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = [tuple(r) for r in decontam.find(d, b, window=6, block_bytes=300).collect()]
    assert by_id(got) == by_id(brute_hits(docs, bench, 6))


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = rng.integers(1, 5, rng.integers(1, 200))
        index = fm_index.FMIndex(s, 5, sample=4)
        pats = [rng.integers(1, 5, rng.integers(1, 6)) for _ in range(20)]
        lo, hi = index.search(pats)
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- language model --------------------------------------------------------------------


def test_language_model(spark):
    rng = random.Random(0)
    docs = [(900, None), (901, ""), (None, "W1 w2")]
    for i in range(300):
        w = [f"w{min(int(rng.expovariate(0.2)), 60)}"]
        for _ in range(rng.randint(1, 30)):
            w.append(f"w{(int(w[-1][1:]) * 7 + rng.randint(0, 2)) % 61}")
        docs.append((i, " ".join(w)))
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame(odd(docs), EXTRA).repartition(3)).collect()}
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in docs}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = rows[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held[i])
        assert r.base_score == pytest.approx(base)
    out = [i for i in toks if held[i]]
    assert sum(rows[i].score for i in out) > sum(rows[i].base_score for i in out) + 0.3 * sum(rows[i].n_tokens for i in out)


def test_language_model_probabilities_sum_to_one(spark):
    """The same context and every known or unknown word: end probabilities of one-word texts add up."""
    train = [(i, " ".join(f"w{(i * k) % 7}" for k in range(12))) for i in range(1, 60)]
    words = sorted({w for i, t in train if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    ids = [i for i in range(10_000, 30_000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(words) + 2]
    probes = [(i, w) for i, w in zip(ids, [*words, "unseen", ""], strict=True)]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(train + probes, "doc_id long, text string")).collect()}
    two = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(train + [(i, f"{w} {words[0]}".strip()) for i, w in probes], "doc_id long, text string")).collect()}
    assert all(s < 0 for s in [*got.values(), *two.values()])
    # P(words[0] | start) P(end | words[0]) is the empty probe's second text and the first word's first
    assert two[ids[-1]] == pytest.approx(got[ids[0]], abs=1e-6)
    # after the start: every word, the unknown one, or the end
    assert sum(10 ** got[i] for i in ids) <= 1 + 1e-6


def test_language_model_tells_contexts_apart(spark):
    """Two words whose mixed hashes agree in 16 bits keep their own followers."""
    import xxhash

    seen, n = {}, 0
    while True:
        h = int(lm._mix(np.array([xxhash.xxh3_64_intdigest(b"c%d" % n)], np.uint64) + np.uint64(lm.M2))[0]) >> 48
        if h in seen:
            break
        seen[h], n = n, n + 1
    a, b = f"c{seen[h]}", f"c{n}"
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    train = [(i, f"{a} x" if i % 2 else f"{b} y") for i in range(1000, 1400)]
    docs = [*train, (held[0], f"{a} x"), (held[1], f"{a} y")]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_language_model_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = lm.score(spark.createDataFrame([(i, "a") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in one)


def test_seating():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 10, 32, 33, 5000])
    t = lm.seat(c, np.full(len(c), -3.0), 0.5, rng)
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0
    # two customers: a second table with odds a : (1 - d)
    many = lm.seat(np.full(20000, 2), np.full(20000, math.log(0.5)), 0.5, rng)
    assert np.mean(many == 2) == pytest.approx(0.5, abs=0.02)


# --- neighbours ------------------------------------------------------------------------


@pytest.mark.parametrize("lot", [7, 4096])
def test_neighbours(spark, lot):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (40, 16))
    x = centres[rng.integers(0, 40, 9000)] + rng.normal(0, 0.3, (9000, 16))
    x[3000:3400] = x[0]  # a very common vector
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(9100, None), (9200, [0.0] * 16), (9300, [float("nan")] * 16), (9400, [1.0] * 5), (None, [1.0] * 16), (9500, [None] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, part int").repartition(4)
    got = defaultdict(list)
    for r in ann.search(df, lot_rows=lot).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float32).astype(float)
    assert sorted(got) == list(range(0, 9000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        assert len(found) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for i, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        d[q] = np.inf
        hit += len({i for i, _ in found} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hit / (10 * len(got)) >= 0.9


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0)).count() == 0


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 6, rng)
    assert np.bincount(label, minlength=6).max() <= math.ceil(1.15 * 100)


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_links_from_four_fifths(spark):
    import corpus_pipeline as p

    base = [f"b{i}" for i in range(60)]
    near = [*base[:30], "other", *base[31:]]  # 51 of 61 five-word shingles in common
    far = [*base[:20], "x", *base[21:40], "y", *base[41:]]  # 46 of 66
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in p.dedup_documents(spark, docs, "").collect()) == [1, 3]


def test_pipeline(spark, sf001):
    import corpus_pipeline as p

    out = p.run(spark, sf001)
    ids = [r.doc_id for r in out.collect()]
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf001).columns == docs.columns
