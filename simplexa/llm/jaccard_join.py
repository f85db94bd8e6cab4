"""N-gram Jaccard self-join by PartEnum signatures.

A document's set: the distinct ``shingle``-word shingles of its lower-cased (A-Z) words;
with fewer words the whole sequence; without words it is empty and linked with nothing.
Two documents link when ``100 * intersection >= percent * union``.

Signatures.  Sets are put in bands of sizes, wide by a power of the threshold; a
set near the lower end of the band above joins that band as well, so that any two sets
that can link share a band.  Within a band at most ``k`` shingles differ.  The shingle
domain is cut by hash into ``n1`` parts of ``n2`` pieces, where ``n1 * (k2 + 1) > k``:
in some part at most ``k2`` pieces differ, so some choice of ``n2 - k2`` pieces of it
agrees.  Each choice is a signature (the sum of the hashes of its shingles): linked
documents share one, always.

An empty signature (no shingle of the set in the chosen pieces) says nothing, and all sets
of a band that lack shingles there would meet in it.  So a band has more parts than needed,
by ``slack``: with that many spare parts, a linked pair agrees in some part outside any
``spare`` parts.  A set with empty signatures in at most ``spare`` parts leaves its empty
ones out; by any such set a linked pair still shares a signature.  Only sets with more,
among which pairs could be missed, keep theirs, so they meet each other there.

Links.  Documents that share a signature are tied to the smallest of them; a task first
ties its own, so that a signature sends one row a task at most.  Ties are verified on
whole sets.  A signature whose documents are not all connected then is broken.  Of two
documents the pair was verified already; of up to ``FEW`` those from different components
are paired and verified in a second round; of more, those that may still link (see
``_across``).  So no link between components is lost.  Components follow from verified
links alone.

Cases: null and empty texts have size 0 and are their own component; a null doc_id has a
null component; rows with the same doc_id are one document with the words of each; texts
are read whole; exact copies share all signatures; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from simplexa.llm.common import Scratch, small_batches
from simplexa.llm.components import connected_components
from simplexa.llm.substring_dedup import M1, WordHash, _groups, _mix

CHUNK = 1_500_000
N2, K2 = 3, 1
#: up to so many documents of a broken signature are paired as they are
FEW = 8
CHOICES = ((0, 1), (0, 2), (1, 2))


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


class Bands:
    """Size bands and their partitionings for a threshold in per cent."""

    def __init__(self, percent: int, top: int = 1 << 31):
        self.percent = percent
        # narrow bands and spare parts keep the signatures of low thresholds, which cover few shingles, from being empty
        power, slack = (3, 0.04) if percent >= 90 else (1, 0.15)
        self.lows = [1]
        while self.lows[-1] < top:
            low = self.lows[-1]
            self.lows.append(max(low + 1, math.floor(low * (100 / percent) ** power) + 1))
        self.low = np.array(self.lows, np.int64)
        high = self.low[1:] - 1
        #: linked sets a, b differ in at most (|a| + |b|) (100 - p) / (100 + p) shingles
        self.k = 2 * high * (100 - percent) // (100 + percent)
        least = np.where(self.k == 0, 1, -(-(self.k + 1) // (K2 + 1)))
        self.spare = np.where(self.k == 0, 0, np.ceil(slack * least).astype(np.int64))
        self.n1 = least + self.spare

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which set, band) pairs: its own band, and the next one if it can link into it."""
        band = np.searchsorted(self.low, sizes, side="right") - 1
        up = 100 * sizes >= self.percent * self.low[band + 1]
        which = np.flatnonzero(sizes > 0)
        more = np.flatnonzero((sizes > 0) & up)
        return np.concatenate((which, more)), np.concatenate((band[which], band[more] + 1))


def shingle_sets(hasher: WordHash, texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each distinct shingle, sorted by both."""
    words = [t.encode().lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h, _ = hasher([w for ws in words for w in ws])
    first = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(words)), counts)
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place = np.arange(len(doc)) - first[doc]
    x = np.zeros(len(doc), np.uint64)
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    for i in range(size):
        inside = place + i < counts[doc]
        x = x * _u(M1) + np.where(inside, padded[i : i + len(doc)] | np.uint64(1), np.uint64(0))
    use = (place + size <= counts[doc]) | (place == 0)
    doc, x = doc[use], _mix(x[use])
    order, new = _groups((x, doc), (doc, x))
    order = order[new]
    return doc[order], x[order]


def signatures(doc: np.ndarray, x: np.ndarray, n_docs: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(document number, signature) rows of sorted sets."""
    sizes = np.bincount(doc, minlength=n_docs)
    which, band = bands.of(sizes)
    if not len(which):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n1 = bands.n1[band]
    first = np.concatenate(([0], np.cumsum(sizes)))
    # the shingles of every (set, band) pair end to end
    take = np.arange(sizes[which].sum()) - np.repeat(np.concatenate(([0], np.cumsum(sizes[which])))[:-1] - first[which], sizes[which])
    pair = np.repeat(np.arange(len(which)), sizes[which])
    e = x[take]
    base = np.concatenate(([0], np.cumsum(n1 * N2)))
    part = ((e >> np.uint64(8)) % n1[pair].astype(np.uint64)).astype(np.int64)
    piece = (_mix(e + _u(0x51ED27)) % np.uint64(N2)).astype(np.int64)
    place = base[pair] + part * N2 + piece
    sums = np.zeros(int(base[-1]), np.uint64)
    np.add.at(sums, place, _mix(e + _u(0xA076)))
    sums = sums.reshape(-1, N2)
    held = np.bincount(place, minlength=int(base[-1])).reshape(-1, N2) > 0
    owner = np.repeat(np.arange(len(which)), n1)
    index = np.arange(len(sums)) - (base[owner] // N2)
    key = _mix((band[owner] * 1_000_003 + 17).astype(np.uint64) * _u(M1) + index.astype(np.uint64))
    exact = bands.k[band[owner]] == 0  # nothing may differ: one signature of the whole set
    out_doc, out_sig = [which[owner[exact]]], [_mix(sums[exact].sum(axis=1, dtype=np.uint64) + key[exact])]
    # sets with empty signatures in more parts than are to spare keep them
    hollow = held.sum(axis=1) <= K2  # some choice of N2 - K2 pieces holds nothing
    keeps = np.bincount(owner, weights=hollow, minlength=len(which)) > bands.spare[band]
    for c, (i, j) in enumerate(CHOICES):
        some = ~exact & (held[:, i] | held[:, j] | keeps[owner])
        out_doc.append(which[owner[some]])
        out_sig.append(_mix(sums[some, i] + sums[some, j] + key[some] * np.uint64(2 * c + 3)))
    return np.concatenate(out_doc), np.concatenate(out_sig)


_ROWS = "sig long, doc long, other long, size long"


def _stage(docs: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """Three kinds of rows: (sig, doc), a task's first of each signature; ties (doc, other) within a task; (doc, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(sig, doc, other, size) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(doc, pa.int64()), pa.array(other, pa.int64()), pa.array(size, pa.int64())], ["sig", "doc", "other", "size"])

        def flush() -> Iterator[pa.RecordBatch]:
            sig, doc = (np.concatenate(v) for v in zip(*held, strict=True))
            order, new = _groups((doc, sig), (sig,))
            heads = order[new]
            hub = doc[heads[np.cumsum(new) - 1]]
            mine = doc[order]
            ties = np.unique(np.stack((hub, mine), axis=1)[hub != mine], axis=0)
            n = len(heads)
            yield rows(sig[heads].astype(np.int64), doc[heads], [None] * n, [None] * n)
            if len(ties):
                spread = _mix(ties[:, 0].astype(np.uint64) * _u(M1) + ties[:, 1].astype(np.uint64)).astype(np.int64)
                yield rows(spread, ties[:, 0], ties[:, 1], [None] * len(ties))

        total = 0
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            doc, x = shingle_sets(hasher, b.column(1).to_pylist(), shingle)
            sizes = np.bincount(doc, minlength=len(ids))
            yield rows(_mix(ids.astype(np.uint64)).astype(np.int64), ids, [None] * len(ids), sizes)
            d, s = signatures(doc, x, len(ids), bands)
            held.append((s, ids[d]))
            total += len(d)
            if total >= CHUNK:
                yield from flush()
                held.clear()
                total = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, _ROWS)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for b in batches:
            doc, x = shingle_sets(hasher, b.column(1).to_pylist(), shingle)
            parts = np.split(x, np.cumsum(np.bincount(doc, minlength=b.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc", "set"])

    return docs.mapInArrow(run, "doc long, set binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, bands: Bands | None) -> DataFrame:
    """(a, b, linked, shared): with ``bands`` also the shared signatures of pairs that do not link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked, shared = [], []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(x) if s == t else len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                linked.append(ok)
                if ok or bands is None:
                    shared.append(None)
                else:
                    d, g = signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate((x, y)), 2, bands)
                    shared.append(np.intersect1d(g[d == 0], g[d == 1]).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(shared, pa.list_(pa.int64()))], ["a", "b", "linked", "shared"])

    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean, shared array<long>")


def _members(sets: DataFrame, bands: Bands) -> DataFrame:
    """(sig, doc, size) of stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(s, np.uint64) for s in b.column(1).to_pylist()]
            if not parts:
                continue
            sizes = np.array([len(p) for p in parts], np.int64)
            d, g = signatures(np.repeat(np.arange(len(parts)), sizes), np.concatenate(parts), len(parts), bands)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(np.array(b.column(0).to_pylist(), np.int64)[d]), pa.array(sizes[d])], ["sig", "doc", "size"])

    return sets.mapInArrow(run, "sig long, doc long, size long")


def _differences(grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """How each document of a group differs from the group's hub; a copy of the hub has an empty difference and is linked."""
    num, den = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, doc, comp = (batch.column(i).to_pylist() for i in range(3))
            linked, need, least, diff = [], [], [], []
            for s, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                h, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                d = np.setxor1d(h, y, assume_unique=True)
                linked.append(den * len(d) <= num * (len(h) + len(y)))
                most = num * (len(y) + 100 * len(y) // percent) // den
                least.append(max(1, len(d) - most))
                need.append(max(1, (den * len(d) + num * (len(h) - len(y))) // (2 * den) + 1, len(d) - most))
                diff.append(d.astype(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((hub, doc, comp, linked, need, least, diff), kinds, strict=True)], ["hub", "doc", "comp", "linked", "need", "least", "diff"])

    left, right = sets.select(F.col("doc").alias("hub"), F.col("set").alias("x")), sets.select("doc", F.col("set").alias("y"))
    rows = grouped.where("hub != doc").join(left.hint("merge"), "hub").join(right.hint("merge"), "doc").select("hub", "doc", "comp", "x", "y")
    return rows.mapInArrow(run, "hub long, doc long, comp long, linked boolean, need long, least long, diff array<long>")


def _across(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) from different components of broken signatures that may link, and links with hubs.

    Each signature's documents (sig, doc, comp) are seen by how they differ from a hub,
    the first document of their largest component.  Of two that are both linked with the hub nothing more is to be found.  If x
    is not, and x and y link, their differences from the hub must share at least ``need``
    shingles (a bound of y alone), so one of them is among the first ``|diff| - need + 1``
    of y's in any fixed order: rare ones come first, and those of one document alone
    meet nobody.  The same holds for x with ``least``, a bound of x alone whatever y is.  So the pairs of a large group of near copies are not enumerated.
    """
    counted = members.groupBy("sig", "comp").agg(F.count("*").alias("n"))
    # a component goes by its smallest document, so that few hubs serve many signatures
    hubs = counted.groupBy("sig").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("hub"))
    grouped = members.join(hubs, "sig").select("hub", "doc", "comp").distinct()
    diffs = scratch.table(_differences(grouped, sets, percent))
    each = diffs.select("hub", "doc", "comp", "linked", "need", "least", F.explode("diff").alias("e"))
    own = Window.partitionBy("hub", "doc")
    counted = each.withColumn("n", F.count("*").over(Window.partitionBy("hub", "e"))).where("n > 1")
    shared = counted.withColumn("nth", F.row_number().over(own.orderBy("n", "e"))).withColumn("both", F.count("*").over(own))
    first = lambda bound: F.col("nth") <= F.col("both") - F.col(bound) + 1
    shared = scratch.table(shared.select("hub", "e", "doc", "comp", first("need").alias("front"), (~F.col("linked") & first("least")).alias("apart")).where("front or apart"))
    y = shared.where("front").select("hub", "e", F.col("doc").alias("y"), F.col("comp").alias("cy"))
    x = shared.where("apart").select("hub", "e", F.col("doc").alias("x"), F.col("comp").alias("cx"))
    met = x.join(y.hint("merge"), ["hub", "e"]).where("cx != cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met, diffs.where("linked").select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))


def join(docs: DataFrame, *, shingle: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of every row, and the verified links (a, b)."""
    spark = docs.sparkSession
    small_batches(spark)
    bands = Bands(percent)
    scratch, early = Scratch(spark, "jaccard"), Scratch(spark, "jaccard")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    known = whole.where(F.col("doc").isNotNull())
    dealt = _stage(known, shingle, bands)
    kind = F.when(F.col("size").isNotNull(), 2).when(F.col("other").isNotNull(), 1).otherwise(0)
    hub = F.min("doc").over(Window.partitionBy("sig", kind))
    tied = dealt.withColumn("hub", F.when(kind == 0, hub)).where((kind != 0) | (F.col("hub") != F.col("doc")))
    first = early.table(tied.select("doc", "size", F.when(kind == 0, F.col("hub")).when(kind == 1, F.col("doc")).alias("a"), F.when(kind == 0, F.col("doc")).when(kind == 1, F.col("other")).alias("b")))
    sizes = scratch.table(first.where(F.col("size").isNotNull()).select("doc", "size"))
    pairs = scratch.table(first.where(F.col("a").isNotNull()).select("a", "b").distinct())
    early.drop()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = scratch.table(_sets(known.join(wanted.hint("merge"), "doc", "left_semi").select("doc", "text"), shingle))
    checked = scratch.table(_verify(pairs, sets, percent, bands))
    links = checked.where("linked").select("a", "b").distinct()
    comps = connected_components(links)
    broken = checked.where("not linked and size(shared) > 0")
    if not broken.isEmpty():
        ca, cb = comps.select(F.col("v").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
        apart = broken.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        sigs = apart.select(F.explode("shared").alias("sig")).distinct()
        own = comps.select(F.col("v").alias("doc"), "comp")
        members = _members(sets, bands).join(sigs.hint("merge"), "sig", "left_semi").join(own.hint("merge"), "doc", "left").select("sig", "doc", "size", F.coalesce("comp", "doc").alias("comp")).distinct()
        members = scratch.table(members)
        counted = members.groupBy("sig").agg(F.count("*").alias("n"))
        few = members.join(counted.where(F.col("n").between(3, FEW)), "sig")
        x, y = few.select("sig", F.col("doc").alias("a"), F.col("size").alias("sa"), F.col("comp").alias("ca")), few.select("sig", F.col("doc").alias("b"), F.col("size").alias("sb"), F.col("comp").alias("cb"))
        near = x.join(y.hint("merge"), "sig").where("a < b and ca != cb").where(100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")).select("a", "b")
        met, with_hubs = _across(members.join(counted.where(F.col("n") > FEW), "sig", "left_semi"), sets, percent, scratch)
        met = met.unionByName(near).distinct()
        again = scratch.table(_verify(met.join(checked.select("a", "b"), ["a", "b"], "left_anti"), sets, percent, None))
        links = links.unionByName(again.where("linked").select("a", "b")).unionByName(with_hubs).distinct()
        comps = connected_components(links)
    own = comps.select(F.col("v").alias("doc"), "comp")
    out = sizes.join(own, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))
    nameless = _sets(whole.where(F.col("doc").isNull()), shingle).select(F.col("doc").alias("doc_id"), (F.octet_length("set") / 8).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless), links


def keep_one(docs: DataFrame, *, shingle: int = 3, percent: int = 90) -> DataFrame:
    """The documents, all columns, without those whose component has a smaller doc_id."""
    out, _ = join(docs, shingle=shingle, percent=percent)
    gone = out.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
