"""Benchmark decontamination with an FM-index per shard.

Words are runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  A window is ``window`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  A shard is what a task has gathered of its
documents.  Its words are projected on the words of the windows: all others become
separators, and so do runs too short for any window made of their words, which loses no
occurrence.  The FM-index of this sequence is searched backwards for every window,
occurrences are located by sampled suffix positions, and their spans merged by document.

The items are dealt to blocks of at most ``block_bytes`` of folded text (a longer item is
cut where its windows allow it: pieces share ``window`` - 1 words) and the blocks lie in
a table.  The driver holds one block at a time, whose size it has checked, and broadcasts
it; a worker builds its windows once.  A benchmark of several blocks takes a pass a block,
each written before the next.

Cases: null and empty texts have no words and no hits; null or wordless items make no
window; items with the same id count once; texts are read whole; repeated rows give
repeated results; without a benchmark nothing is hit; further columns are ignored by
``find`` and kept by ``remove``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch, small_batches
from simplexa.llm.fm_index import FMIndex

_WORD = rb"0123456789abcdefghijklmnopqrstuvwxyz"
FOLD = bytes(c if c >= 0x80 else (c + 32 if 65 <= c <= 90 else c) if bytes([c]).lower() in [_WORD[i : i + 1] for i in range(36)] else 32 for c in range(256))
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: folded text of the items of a block; its windows take about a hundred times as much in a worker
BLOCK_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Windows:
    """The windows of some items and the words they are made of."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words]  # 0 ends the sequence, 1 separates
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.patterns = [np.array(p, np.int64) for p in found]
        self.items = [sorted(v) for v in found.values()]
        self.sizes = sorted({len(p) for p in found})
        #: for each window size, which symbols stand in a window of that size
        self.members = {}
        for size in self.sizes:
            member = np.zeros(len(self.vocab) + 2, bool)
            for p in self.patterns:
                if len(p) == size:
                    member[p] = True
            self.members[size] = member

    def useful(self, ids: np.ndarray) -> np.ndarray:
        """Places that stand in a run long enough for a window of its words."""
        keep = np.zeros(len(ids), bool)
        for size, member in self.members.items():
            inside = np.concatenate(([0], member[ids].astype(np.int8), [0]))
            edge = np.diff(inside)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for a, b in zip(starts[ends - starts >= size], ends[ends - starts >= size], strict=True):
                keep[a:b] = True
        return keep


class Shard:
    """Documents gathered until they are searched together."""

    def __init__(self, windows: Windows, sample: int = 16):
        self.w, self.sample = windows, sample
        self.counts: list[int] = []
        self.symbols: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        doc = len(self.counts)
        self.counts.append(len(words))
        if not words or not self.w.patterns:
            return
        ids = np.fromiter(map(self.w.vocab.get, words, repeat(1)), np.int64, len(words))
        keep = np.flatnonzero(self.w.useful(ids))
        if not len(keep):
            return
        # a separator behind every run
        gaps = np.flatnonzero(np.diff(keep) > 1) + 1
        symbols = np.append(np.insert(ids[keep], gaps, 1), 1)
        places = np.append(np.insert(keep, gaps, -1), -1)
        self.symbols.append(symbols)
        self.places.append(places)
        self.docs.append(np.full(len(symbols), doc, np.int64))
        self.size += len(symbols)

    def search(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Merged word spans and items by document."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if not self.size:
            return spans, items
        docs, places = np.concatenate(self.docs), np.concatenate(self.places)
        index = FMIndex(np.concatenate(self.symbols), len(self.w.vocab) + 2, self.sample)
        lo, hi = index.search(self.w.patterns)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return spans, items
        which = np.repeat(found, (hi - lo)[found])
        rows = np.concatenate([np.arange(lo[i], hi[i]) for i in found])
        at = index.locate(rows)
        size = np.array([len(p) for p in self.w.patterns])[which]
        doc, start = docs[at], places[at]
        for d, i in {*zip(doc.tolist(), which.tolist(), strict=True)}:
            items.setdefault(d, set()).update(self.w.items[i])
        order = np.lexsort((start, doc))
        for d, a, n in zip(doc[order].tolist(), start[order].tolist(), size[order].tolist(), strict=True):
            mine = spans.setdefault(d, [])
            if mine and a <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(mine[-1][1], a + n))
            else:
                mine.append((a, a + n))
        return spans, items


class Block:
    """A block of items; its windows are built once a worker."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items, self.window = items, window
        self.built: Windows | None = None

    def windows(self) -> Windows:
        if self.built is None:
            self.built = Windows([(i, t.split(b" ")) for i, t in self.items], self.window)
        return self.built

    def __getstate__(self) -> tuple:
        return self.items, self.window

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)


def _pieces(words: list[bytes], window: int, limit: int) -> Iterator[bytes]:
    """The words joined by spaces, in pieces of about ``limit`` bytes at most that lose no window."""
    a = 0
    while True:
        b, size = a, 0
        while b < len(words) and (size <= limit or b - a < 2 * window):
            size += len(words[b]) + 1
            b += 1
        yield b" ".join(words[a:b])
        if b == len(words):
            return
        a = b - window + 1


def _dealt(bench: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(block, item, words): tasks fold the items and fill blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in _pieces(words_of(text), window, block_bytes // 2):
                    if not piece:
                        continue
                    if size and size + len(piece) > block_bytes:
                        block, size = block + 1, 0
                    size += len(piece)
                    out.append((task << 32 | block, item, piece))
            kinds = [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["block", "item", "words"])

    items = bench.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(run, "block long, item string, words binary")


def _blocks(bench: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The blocks, one at a time; small neighbours are put together.  At least one, be it empty."""
    scratch = Scratch(bench.sparkSession, "benchmark")
    dealt = scratch.table(_dealt(bench, window, block_bytes), "blocks")
    sizes = dealt.groupBy("block").agg(F.sum(F.length("words")).alias("size")).orderBy("block").toLocalIterator()
    group: list[int] = []
    held = 0
    found = False
    for r in sizes:
        if group and held + r.size > block_bytes:
            yield _read(dealt, group, window)
            found, group, held = True, [], 0
        group.append(r.block)
        held += r.size
    if group or not found:
        yield _read(dealt, group, window)
    scratch.drop()


def _read(dealt: DataFrame, blocks: list[int], window: int) -> Block:
    # at most block_bytes of words, as summed before
    rows = dealt.where(F.col("block").between(blocks[0], blocks[-1])).select("item", "words").collect() if blocks else []
    return Block([(r.item, bytes(r.words)) for r in rows], window)


STATE = "doc_id long, text string, n_words long, spans array<long>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pass(block: Broadcast, shard_words: int, last: bool):
    """Adds what one block of windows finds to the spans and items of every document; the last pass gives no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value.windows()
        rows: list[tuple] = []
        shard = Shard(windows)

        def done() -> pa.RecordBatch:
            spans, items = shard.search()
            out = []
            for i, (doc, text, old_spans, old_items) in enumerate(rows):
                mine, its = spans.get(i, []), items.get(i, set())
                if old_spans:
                    mine = _merged([*mine, *zip(old_spans[::2], old_spans[1::2], strict=True)])
                out.append((doc, None if last else text, shard.counts[i], [x for s in mine for x in s], sorted({*its, *(old_items or ())})))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "text", "n_words", "spans", "items"])

        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "spans", "items")), strict=True):
                shard.add(words_of(row[1]))
                rows.append(row if not last else (row[0], None, *row[2:]))
                if shard.size >= shard_words or len(rows) >= (50_000 if last else 500):
                    yield done()
                    rows, shard = [], Shard(windows)
        if rows:
            yield done()

    return run


def find(docs: DataFrame, bench: DataFrame, *, window: int = 10, shard_words: int = 1_000_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, words hit, items found."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    found = _over_blocks(found, bench, window, block_bytes, lambda block, last: (_pass(block, shard_words, last), STATE))
    n_hit = _covered("spans")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _covered(spans: str):
    """Words in merged spans, given as start, end, start, end ..."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)


def remove(docs: DataFrame, bench: DataFrame, *, window: int = 10, shard_words: int = 1_000_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, with every hit span cut from ``text`` (from its first to its last word)."""
    small_batches(docs.sparkSession)
    at = docs.schema.names.index("text")
    # the text stays as it is until all blocks have searched it; spans travel in a last column, found by its place
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.array().cast("array<long>").alias(f"_spans_{uuid.uuid4().hex}"))
    wide = found.schema
    return _over_blocks(found, bench, window, block_bytes, lambda block, last: (_cutter(block, at, last), docs.schema if last else wide))


def _over_blocks(found: DataFrame, bench: DataFrame, window: int, block_bytes: int, stage) -> DataFrame:
    """A pass a block; all but the last are written, so that a block leaves the cluster before the next comes."""
    context, scratch = found.sparkSession.sparkContext, Scratch(found.sparkSession, "decontaminated")
    blocks = _blocks(bench, window, block_bytes)
    block, read = next(blocks), None
    while block is not None:
        following = next(blocks, None)
        sent = context.broadcast(block)
        run, schema = stage(sent, following is None)
        found = found.mapInArrow(run, schema)
        if following is not None:
            path = scratch.path("pass")
            found.write.parquet(path)
            found = found.sparkSession.read.schema(found.schema).parquet(path)
            if read:
                scratch.remove(read)
            read = path
            sent.destroy()
        block = following
    return found


def _cutter(block: Broadcast, at: int, last: bool):
    """Adds the spans of one block to those in the last column; the last block's pass cuts all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value.windows()
        for b in batches:
            shard = Shard(windows)
            texts = b.column(at).to_pylist()
            for t in texts:
                shard.add(words_of(t))
            mine, _ = shard.search()
            spans = [_merged([*zip(old[::2], old[1::2], strict=True), *mine.get(i, [])]) for i, old in enumerate(b.column(b.num_columns - 1).to_pylist())]
            arrays = list(b.columns)
            if not last:
                arrays[-1] = pa.array([[x for s in found for x in s] for found in spans], b.schema.field(b.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)
                continue
            for i, found in enumerate(spans):
                if not found:
                    continue
                raw = texts[i].encode()
                places = [m.span() for m in WORDS.finditer(raw)]
                keep, end = [], 0
                for a, e in found:
                    keep.append(raw[end : places[a][0]])
                    end = places[e - 1][1]
                texts[i] = b"".join([*keep, raw[end:]]).decode()
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays[:-1], schema=pa.schema(list(b.schema)[:-1]))

    return run
