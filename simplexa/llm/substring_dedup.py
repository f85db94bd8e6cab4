"""Removal of repeated passages with a log-structured fingerprint index.

A passage is a window of ``window`` consecutive words (runs of characters other than
space and ``\\x09``-``\\x0D``).  Each word covered by a window whose word sequence also
starts earlier (in a smaller doc_id, or earlier in the same document) is removed.

Fingerprints.  Of the hashes of all ``anchor``-word windows inside a window, the smallest
(the first of equal ones) is its fingerprint.  Equal windows have equal fingerprints at
equal offsets, so every repeat is found though only about one place in six is indexed.

Index.  ``FingerprintIndex.ingest`` takes a batch.  Its fingerprints form an immutable
run, sorted and bucketed by hash, which is merge-joined bucket by bucket (no exchange)
with the runs of earlier batches; where these are more than ``max_runs``, they are
compacted into one before the batch meets them.  Runs lie in the shared folder.  What is returned are the places, of the batch and of the history, whose
fingerprint occurs more than once.

Verification.  For windows with such a fingerprint, 128-bit digests of all their words
are compared: two independent 64-bit hashes of every word, combined by two polynomials.
Equal digests count as equal words; among 10^13 windows the chance of one error is below
10^-12.

Skew.  A task collapses what repeats within its own documents before anything is dealt
out, so that a fingerprint or digest sends one row a task at most, however common it is.

Cases: a null or empty text has no words; a null doc_id counts as smaller than all
others; rows with the same doc_id count as one document read twice: equal windows at the
same start do not remove each other; texts are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch, small_batches

NULL_ID = -(2**63)
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK = 1_500_000


class WordHash:
    """Two 64-bit hashes of every word, remembered while there is room."""

    def __init__(self, room: int = 1 << 18):
        import xxhash

        self.digest, self.room = xxhash.xxh3_128_intdigest, room
        self.lo, self.hi = np.empty(room, np.uint64), np.empty(room, np.uint64)
        me = self

        class Index(dict):
            def __missing__(self, word: bytes) -> int:
                i = len(self)
                if i == len(me.lo):
                    me.lo, me.hi = np.resize(me.lo, 2 * i), np.resize(me.hi, 2 * i)
                h = me.digest(word)
                me.lo[i], me.hi[i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
                self[word] = i
                return i

        self.index = Index()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) >= self.room:
            self.index.clear()
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.lo[ids], self.hi[ids]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(base) + h[i : i + n]
    return _mix(out)


class Batch:
    """The words of some documents laid end to end."""

    def __init__(self, hasher: WordHash, texts: list[str | None], window: int, anchor: int):
        words = [t.encode().split() if t else [] for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.lo, self.hi = hasher([w for ws in words for w in ws])
        self.words, self.window = words, window
        doc = np.repeat(np.arange(len(words)), self.sizes)
        starts = np.flatnonzero(np.arange(len(doc)) + window <= self.first[doc + 1]) if len(doc) else np.empty(0, np.int64)
        self.starts, self.doc = starts, doc
        anchors = _rolling(self.lo, anchor, M1)
        if len(starts):
            best, at = anchors[starts], np.zeros(len(starts), np.int64)
            for j in range(1, window - anchor + 1):
                other = anchors[starts + j]
                less = other < best
                best, at = np.where(less, other, best), np.where(less, j, at)
            self.chosen = starts + at  # the place of each window's fingerprint
        else:
            self.chosen = np.empty(0, np.int64)
        self.anchors = anchors

    def place(self, at: np.ndarray) -> np.ndarray:
        """Places within their documents."""
        return at - self.first[self.doc[at]]


def _groups(order_keys: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A sort order, and which rows of it begin a group of equal keys."""
    order = np.lexsort(order_keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def _packed_rows(docs: np.ndarray, places: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One row a document: its places as 32-bit integers."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    cuts = np.flatnonzero(np.diff(docs)) + 1
    parts = np.split(places, cuts) if len(docs) else []
    return docs[np.concatenate(([0], cuts))].tolist() if len(docs) else [], [p.astype("<i4").tobytes() for p in parts]


_FP = "fp long, doc long, pos int, n long, packed binary"


def fingerprints(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row for each fingerprint of a task's documents, and the places that repeat within them, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            fp, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new = _groups((pos, doc, fp), (fp,))
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            heads = order[new]
            again = order[count[group] > 1]
            d, packed = _packed_rows(doc[again], pos[again])
            spread = _mix(np.array(d, np.int64).astype(np.uint64) + np.uint64(M2)).astype(np.int64)
            none = len(heads)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((fp[heads].astype(np.int64), spread))),
                    pa.array(np.concatenate((doc[heads], np.array(d, np.int64)))),
                    pa.array(np.concatenate((pos[heads], np.full(len(d), -1))).astype(np.int32)),
                    pa.array(np.concatenate((count, np.zeros(len(d), np.int64)))),
                    pa.array([None] * none + packed, pa.binary()),
                ],
                ["fp", "doc", "pos", "n", "packed"],
            )

        size = 0
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            batch = Batch(hasher, b.column(1).to_pylist(), window, anchor)
            at = np.unique(batch.chosen)
            if len(at):
                held.append((batch.anchors[at], ids[batch.doc[at]], batch.place(at)))
                size += len(at)
            if size >= CHUNK:
                yield flush()
                held.clear()
                size = 0
        if size:
            yield flush()

    return docs.mapInArrow(run, _FP)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, bucketed by hash."""

    def __init__(self, spark: SparkSession, *, window: int, anchor: int, max_runs: int = 4):
        self.spark, self.window, self.anchor, self.max_runs = spark, window, anchor, max_runs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "fingerprints")
        self.runs: list[str] = []

    def _write(self, df: DataFrame) -> str:
        self.scratch.tables.append(name := f"simplexa_fp_{uuid.uuid4().hex}")
        df.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", self.scratch.path("run")).format("parquet").saveAsTable(name)
        return name

    def compact(self) -> None:
        """Merge all runs into one that keeps a row for each fingerprint."""
        rows = self._rows(self.runs).groupBy("fp").agg(F.min(F.struct("doc", "pos")).alias("a"), F.sum("total").alias("total"))
        merged = rows.select("fp", F.col("a.doc").alias("doc"), F.col("a.pos").alias("pos"), "total", F.lit(True).alias("first"), F.lit(None).cast("binary").alias("packed"))
        old, self.runs = self.runs, [self._write(merged)]
        for name in old:
            self.scratch.forget(name)

    def _rows(self, runs: list[str]) -> DataFrame:
        """A row for each fingerprint of each run."""
        out = None
        for name in runs:
            t = self.spark.table(name).where("first").select("fp", "doc", "pos", "total")
            out = t if out is None else out.unionByName(t)
        return out

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add a batch (doc, text); returns (doc, pos, packed) of places whose fingerprint is not unique.

        What the call before returned must be written by now, for runs that are compacted go.
        """
        if len(self.runs) > self.max_runs:
            self.compact()
        w = Window.partitionBy("fp", F.col("pos") < 0)
        dealt = fingerprints(docs, self.window, self.anchor).repartition(self.buckets, "fp")
        ranked = dealt.withColumn("total", F.sum("n").over(w)).withColumn("nth", F.row_number().over(w.orderBy("doc", "pos")))
        new = self._write(ranked.select("fp", "doc", "pos", "total", ((F.col("nth") == 1) & (F.col("pos") >= 0)).alias("first"), "packed"))
        run = self.spark.table(new)
        found = run.where((F.col("total") > 1) | F.col("packed").isNotNull()).select("doc", "pos", "packed")
        for old in self.runs:  # both sides hold each fingerprint once
            a, b = self._rows([new]).alias("a"), self._rows([old]).alias("b")
            both = a.join(b.hint("merge"), F.col("a.fp") == F.col("b.fp"))
            sides = F.explode(F.array(F.struct("a.doc", "a.pos"), F.struct("b.doc", "b.pos")))
            met = both.where((F.col("a.total") == 1) | (F.col("b.total") == 1)).select(sides.alias("x"))
            found = found.unionByName(met.select("x.doc", "x.pos", F.lit(None).cast("binary").alias("packed")))
        self.runs.append(new)
        return found

    def drop(self) -> None:
        self.scratch.drop()


def _places(found: list[int] | None, packed: list[bytes] | None) -> np.ndarray:
    parts = [np.array(found or [], np.int64), *(np.frombuffer(p, "<i4").astype(np.int64) for p in packed or ())]
    return np.unique(np.concatenate(parts))


def _kept(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, bytes]:
    """Number of removed words, and the kept ones joined by a space."""
    if not len(starts):
        return 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + window, len(words)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


_X = "doc long, n_words long, text string, places binary, kept_sha256 string"


def _prepare(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with candidate places keep their text; the others are finished."""
    by_doc = candidates.groupBy("doc").agg(F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("found"), F.collect_list("packed").alias("packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, found, packed in zip(*(b.column(n).to_pylist() for n in ("doc", "text", "found", "packed")), strict=True):
                words = text.encode().split() if text else []
                if found or packed:
                    out.append((doc, len(words), text, _places(found, packed).astype("<i4").tobytes(), None))
                else:
                    out.append((doc, len(words), None, None, hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc", "n_words", "text", "places", "kept_sha256"])

    return docs.join(by_doc, "doc", "left").select("doc", "text", "found", "packed").mapInArrow(run, _X)


_DIG = "h1 long, h2 long, doc long, start int, packed binary"


def _digests(pending: DataFrame, window: int, anchor: int) -> DataFrame:
    """Digests of windows with a candidate fingerprint: one row for each of a task's, and the repeats within it, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new = _groups((start, doc, h2, h1), (h1, h2))
            heads = order[new]
            head_of = heads[np.cumsum(new) - 1]
            later = order[(doc[order] != doc[head_of]) | (start[order] != start[head_of])]
            d, packed = _packed_rows(doc[later], start[later])
            spread = _mix(np.array(d, np.int64).astype(np.uint64) + np.uint64(M2)).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((h1[heads].astype(np.int64), spread))),
                    pa.array(np.concatenate((h2[heads].astype(np.int64), spread))),
                    pa.array(np.concatenate((doc[heads], np.array(d, np.int64)))),
                    pa.array(np.concatenate((start[heads], np.full(len(d), -1))).astype(np.int32)),
                    pa.array([None] * len(heads) + packed, pa.binary()),
                ],
                ["h1", "h2", "doc", "start", "packed"],
            )

        size = 0
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            batch = Batch(hasher, b.column(1).to_pylist(), window, anchor)
            wanted = np.zeros(int(batch.first[-1]) + 1, bool)
            for i, p in enumerate(b.column(2).to_pylist()):
                wanted[batch.first[i] + np.frombuffer(p, "<i4")] = True
            take = batch.starts[wanted[batch.chosen]] if len(batch.chosen) else batch.starts
            if len(take):
                d1, d2 = _rolling(batch.lo, window, M1), _rolling(batch.hi, window, M2)
                held.append((d1[take], d2[take], ids[batch.doc[take]], batch.place(take)))
                size += len(take)
            if size >= CHUNK:
                yield flush()
                held.clear()
                size = 0
        if size:
            yield flush()

    return pending.select("doc", "text", "places").mapInArrow(run, _DIG)


_OUT = "doc long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, *, window: int = 20, anchor: int = 10, batches: int = 3, max_runs: int = 1, texts: bool = False) -> DataFrame:
    """One row per document: its words, how many are removed, digest of the rest (with ``texts`` also the rest)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    cuts = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("q")).first().q if batches > 1 else []
    cuts = sorted(set(cuts or []))
    index = FingerprintIndex(spark, window=window, anchor=anchor, max_runs=max_runs)
    scratch, early = Scratch(spark, "substring"), Scratch(spark, "candidates")
    candidates = None
    for i in range(len(cuts) + 1):
        part = docs
        if i > 0:
            part = part.where(F.col("doc") > cuts[i - 1])
        if i < len(cuts):
            part = part.where(F.col("doc") <= cuts[i])
        found = early.table(index.ingest(part))
        candidates = found if candidates is None else candidates.unionByName(found)
    index.drop()
    prepared = scratch.table(_prepare(docs, candidates), "prepared")
    early.drop()
    pending = prepared.where(F.col("places").isNotNull())

    w = Window.partitionBy("h1", "h2", F.col("start") < 0).orderBy("doc", "start")
    ranked = _digests(pending, window, anchor).withColumn("nth", F.rank().over(w)).where((F.col("nth") > 1) | F.col("packed").isNotNull())
    flagged = ranked.groupBy("doc").agg(F.collect_list(F.when(F.col("start") >= 0, F.col("start"))).alias("found"), F.collect_list("packed").alias("packed"))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for doc, text, found, packed in zip(*(b.column(n).to_pylist() for n in ("doc", "text", "found", "packed")), strict=True):
                words = text.encode().split()
                gone, kept = _kept(words, _places(found, packed), window)
                out.append((doc, len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    changed = pending.select("doc", "text").join(flagged, "doc", "left").mapInArrow(finish, _OUT)
    whole = prepared.where(F.col("places").isNull()).select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    if texts:
        plain = docs.select("doc", F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda x: x != ""), " ").alias("kept"))
        whole = whole.join(plain, "doc")
    else:
        whole = whole.withColumn("kept", F.lit(None).cast("string"))
    out = whole.unionByName(changed)
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id")
    return out.select(doc_id, "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []))
