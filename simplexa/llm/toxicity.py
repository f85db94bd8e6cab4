"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

``fit`` learns the lexicon from labelled rows: words and word beginnings that are far
more frequent in toxic than in clean texts, weighted by their log odds, together with
exception phrases (a hit and its neighbour that occur in clean texts only) and two
coefficients that turn weights into a probability.  ``score`` folds a text (lower case,
homoglyphs of other scripts, digits and signs used as letters), runs the automaton over
it, drops hits inside exception phrases and normalises by length.

The classifier is fitted on at most ``max_rows`` labelled rows, those of the smallest
hash of their id; scoring reads every whole text.

Cases: a null or empty text has no hits and gets the score of a text without hits;
labels other than 0 and 1, null ids and labels without a document are not learned from;
an id labelled twice counts as toxic if one label says so; without toxic or without
clean training rows every score is 0; repeated rows give repeated results; further
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import bucket_expr, small_batches

WORD = re.compile(r"[^\W_]+")
MIXED = re.compile(r"[\w@$]*[0-9@$][\w@$]*")
LETTER = re.compile(r"[^\W\d_]")
#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = str.maketrans("авеіјкмнорсѕтухԁԛαεικνορτυχ", "abeijkmhopcstyxdqaeikvoptux") | {c: chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B)}
#: A letter that the table folds.
FOREIGN = re.compile(f"[{''.join(map(chr, HOMOGLYPHS))}]")
#: Digits and signs used as letters (fixed values).
LEET = str.maketrans("01345789@$", "oieastbgas")

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits long"


def _leet(m: re.Match) -> str:
    word = m.group()
    return word.translate(LEET) if LETTER.search(word) else word


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    text = text.lower()
    if FOREIGN.search(text):
        text = text.translate(HOMOGLYPHS)
    return WORD.findall(MIXED.sub(_leet, text))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  #: " word " or " beginning" -> weight
    exceptions: list[str] = field(default_factory=list)  #: " two words "
    coef: tuple[float, float, float] | None = None

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), -1.0))
        a.make_automaton()
        return a

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place in the joined text, weight) of each word hit."""
        if not self.weights or not words:
            return []
        found: dict[int, float] = {}
        masked = []
        for end, (size, w) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if w < 0:
                masked.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        out, reach, at = [], -1, 0
        masked.sort()
        for start, w in sorted(found.items()):  # one sweep over hits and exceptions
            while at < len(masked) and masked[at][0] <= start:
                reach = max(reach, masked[at][1])
                at += 1
            if start >= reach:
                out.append((start, w))
        return out

    def features(self, words: list[str]) -> tuple[float, float, int]:
        h = self.hits(words)
        if not h:
            return 0.0, 0.0, 0
        total = sum(w for _, w in h)
        return max(w for _, w in h), total / math.sqrt(len(words) + 10.0), len(h)

    def probability(self, x1: float, x2: float) -> float:
        if self.coef is None:
            return 0.0
        z = self.coef[0] + self.coef[1] * x1 + self.coef[2] * x2
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coef": self.coef}


def _patterns(words: list[str]) -> set[str]:
    out = set()
    for w in set(words):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(4, min(len(w), 8)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, float, float]:
    """Ridge logistic regression by damped Newton steps; slopes are kept from going below 0."""
    a = np.c_[np.ones(len(x)), x]
    b = np.array([-2.0, 0.1, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        g = a.T @ (p - y) + ridge * b
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        b = b - np.clip(np.linalg.solve(h, g), -1, 1)
        b[1:] = np.maximum(b[1:], 0)
    return tuple(float(v) for v in b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 20_000,
    max_patterns: int = 2_000,
    max_exceptions: int = 500,
    min_share: float = 0.01,
    purity: float = 0.01,
    held_out_of: int = 5,
) -> Model:
    """Learn a model from labelled rows whose crc32(doc_id) mod ``held_out_of`` is not 0."""
    small_batches(docs.sparkSession)
    # at most max_rows rows of two numbers: bounded, so it may be broadcast
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket_expr(F.col("doc_id"), held_out_of) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = [(r.doc_id, r.toxic) for r in sample.collect()]
    if not rows:
        return Model()
    marked = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush():
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k][1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64())], ["pattern", "pos", "neg"])
            seen.clear()
            return out

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in _patterns(fold(text)) | {""}:
                    seen.setdefault(p, [0, 0])[y] += 1
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    counts = train.mapInArrow(count, "pattern string, pos long, neg long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n_pos = sum(y for _, y in rows)
    least = max(3, math.ceil(min_share * n_pos))
    # the empty pattern stands in every text, so its row carries the class sizes
    kept = counts.where((F.col("pattern") == "") | (F.col("pos") >= least) & (F.col("neg") * n_pos <= purity * F.col("pos") * (len(rows) - n_pos)))
    kept = {r.pattern: (r.pos, r.neg) for r in kept.orderBy((F.col("pattern") != ""), F.col("pos").desc(), "pattern").limit(max_patterns + 1).collect()}
    pos, neg = kept.pop("", (0, 0))
    if not pos or not neg:
        return Model()
    model = Model({p: math.log((a + 0.1) / (pos + 0.2)) - math.log((b + 0.1) / (neg + 0.2)) for p, (a, b) in kept.items()})
    packed = pickle.dumps(model)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for b in batches:
            out: Counter = Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold(text)
                if h := {s for s, _ in m.hits(words)}:
                    at, near = 0, set()
                    for i, w in enumerate(words):
                        if at in h:
                            near.update([f" {words[i - 1]} {w} "] if i else [])
                            near.update([f" {w} {words[i + 1]} "] if i + 1 < len(words) else [])
                        at += len(w) + 1
                    out.update((p, y) for p in near)
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([out[k] * k[1] for k in keys], pa.int64()), pa.array([out[k] * (1 - k[1]) for k in keys], pa.int64())], ["phrase", "pos", "neg"])

    near = train.mapInArrow(phrases, "phrase string, pos long, neg long").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    clean_only = near.where((F.col("pos") == 0) & (F.col("neg") >= 2)).orderBy(F.col("neg").desc(), "phrase").limit(max_exceptions)
    model = Model(model.weights, [r.phrase for r in clean_only.collect()])
    packed2 = pickle.dumps(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed2)
        for b in batches:
            got = [m.features(fold(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), b.column(1)], ["x1", "x2", "toxic"])

    seen = train.mapInArrow(measured, "x1 double, x2 double, toxic int").groupBy("x1", "x2", "toxic").count().orderBy("x1", "x2", "toxic").collect()  # at most max_rows rows
    x = np.repeat(np.array([(r.x1, r.x2) for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([float(r.toxic) for r in seen]), [r["count"] for r in seen])
    model.coef = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, *, held_out_of: int = 5) -> DataFrame:
    """Score every text; ``predicted`` is 1 from a score of one half."""
    small_batches(docs.sparkSession)
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for b in batches:
            got = [m.features(fold(t)) for t in b.column(2).to_pylist()]
            p = [m.probability(g[0], g[1]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32()), pa.array([g[2] for g in got], pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    held = (bucket_expr(F.col("doc_id"), held_out_of) == 0).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    small_batches(docs.sparkSession)
    packed = pickle.dumps(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for b in batches:
            keep = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                x1, x2, _ = m.features(fold(t or ""))
                keep.append(m.probability(x1, x2) < 0.5)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
