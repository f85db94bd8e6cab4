"""Exact dedup against a minimal perfect hash over historical distinct digests.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the
largest doc_id stays.  A row is known by the SHA-256 of its lower-cased text.

The index cuts the distinct digests of history into buckets by their first bits, so that a
bucket holds some ten thousand at any size.  A bucket is a row: a minimal perfect hash
(bit arrays of falling size: at each level the digests that are alone on their position
take it, the others go on) and, by slot, the whole digest, the locator of the winner and
the number of rows.  A new batch is collapsed by its tasks, so that a digest sends one row
a chunk however many rows hold it, and meets its bucket.  A lookup compares all 32 bytes
of the slot: members update winner and count, nonmembers are grouped apart and become
entries.  The updated entries make the next index.

Decisions are joined back to the rows.  Digests of more than a thousandth of all rows, at
most a thousand, are broadcast; all others, each of few rows, are joined by shuffle.

Cases: null texts count as empty; a null doc_id is smaller than any other and is kept only
where its group has no other id (``keep_id`` is null then); rows of equal doc_id and equal
text count separately in ``group_size`` and are kept or dropped alike; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch, arrow_rows

BUCKET = 16_384
#: stands for a null doc_id, below every other
NONE = -(1 << 63)
CHUNK = 100_000
ROWS = "doc_id long, digest binary, head long"
ENTRIES = "digest binary, head long, winner long, size long"
INDEX = "bucket long, levels array<int>, bits binary, slots binary, winners binary, sizes binary"


# --- minimal perfect hash of a bucket --------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each digest (rows of four words); every word has its turn."""
    with np.errstate(over="ignore"):
        x = keys[:, level % 4] ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 .. n-1 for n distinct digests; others get some slot or -1."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[int] = []
        arrays = [np.zeros(0, np.uint8)]
        left = keys
        while len(left):
            m = 64 * (len(left) * 3 // 128 + 1)
            at = (_mixed(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(m)
            arrays.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels, np.concatenate(arrays))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.levels):
            at = base + (_mixed(keys[left], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + m
        return out


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests of 32 bytes as rows of four words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _digest_column(keys: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys).tobytes()
    return pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())


def _grouped(keys: np.ndarray, winner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal digests as one."""
    if not len(keys):
        return keys, winner, size
    order = np.lexsort(keys.T)
    keys, winner, size = keys[order], winner[order], size[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    return keys[first], np.maximum.reduceat(winner, first), np.add.reduceat(size, first)


# --- the index -------------------------------------------------------------------------


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, head): SHA-256 of each lower-cased text and its first 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes.lower changes A-Z alone
            found = [hashlib.sha256((t or b"").lower()).digest() for t in b.column(1).cast(pa.binary()).to_pylist()]
            heads = np.array([int.from_bytes(d[:4], "big") for d in found], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), pa.array(heads)], ["doc_id", "digest", "head"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def _collapsed(rows: DataFrame) -> DataFrame:
    """Entries of the rows of each chunk of a task: what one digest sends does not grow with its rows."""

    def entries(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        k, winner, size = _grouped(np.concatenate(keys), i := np.concatenate(ids), np.ones(len(i), np.int64))
        heads = k[:, 0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        return pa.RecordBatch.from_arrays([_digest_column(k), pa.array(heads), pa.array(winner), pa.array(size)], ["digest", "head", "winner", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0
        for b in batches:
            keys.append(_words(b.column(1)))
            ids.append(b.column(0).fill_null(NONE).to_numpy())
            held += b.num_rows
            if held >= CHUNK:
                yield entries(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield entries(keys, ids)

    return rows.select("doc_id", "digest").mapInArrow(run, ENTRIES)


@dataclass
class Index:
    """Entries of history, as rows and as perfect hashes by bucket; both are written tables.

    An index is kept by keeping the two paths, the power and the number of rows.
    """

    spark: SparkSession
    entries_path: str
    index_path: str
    power: int
    rows: int

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(self.entries_path)


def _bucket(power: int) -> F.Column:
    """The first ``power`` bits."""
    return F.shiftright("head", 32 - power).alias("bucket")


def _power(rows: int) -> int:
    return min(31, max(0, (rows - 1) // BUCKET).bit_length())


def _write_index(entries: DataFrame, power: int, path: str) -> None:
    def run(t: pa.Table) -> pa.Table:
        keys = _words(t.column("digest"))
        h = PerfectHash.build(keys)
        at = np.argsort(h(keys))
        columns = [[t.column("bucket")[0].as_py()], [h.levels], [np.packbits(h.bits).tobytes()], [keys[at].tobytes()], [t.column("winner").to_numpy()[at].tobytes()], [t.column("size").to_numpy()[at].tobytes()]]
        types = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["bucket", "levels", "bits", "slots", "winners", "sizes"])

    entries.select(_bucket(power), "digest", "winner", "size").groupBy("bucket").applyInArrow(run, INDEX).write.parquet(path)


def _looked_up(index: DataFrame, batch: DataFrame, power: int) -> DataFrame:
    """Entries of history and batch together: members where their slot holds their very bytes."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        keys, winner, size = _words(new.column("digest")), new.column("winner").to_numpy(), new.column("size").to_numpy()
        head = np.zeros(0, np.int64)
        if old.num_rows:
            row = old.to_pylist()[0]
            slots = np.frombuffer(row["slots"], "<u8").reshape(-1, 4)
            winners, sizes = (np.frombuffer(row[c], np.int64).copy() for c in ("winners", "sizes"))
            h = PerfectHash(row["levels"], np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["levels"])))
            slot = h(keys)
            member = slot >= 0
            member[member] = (slots[slot[member]] == keys[member]).all(1)
            np.maximum.at(winners, slot[member], winner[member])
            np.add.at(sizes, slot[member], size[member])
            fresh = _grouped(keys[~member], winner[~member], size[~member])
            keys, winner, size = (np.concatenate(x) for x in zip((slots, winners, sizes), fresh, strict=True))
        else:
            keys, winner, size = _grouped(keys, winner, size)
        head = np.ascontiguousarray(keys[:, 0]).view(np.uint8).reshape(-1, 8)[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        return pa.table([_digest_column(keys), pa.array(head), pa.array(winner), pa.array(size)], ["digest", "head", "winner", "size"])

    return index.groupBy("bucket").cogroup(batch.select(_bucket(power), "digest", "winner", "size").groupBy("bucket")).applyInArrow(run, ENTRIES)


def ingest(scratch: Scratch, index: Index | None, rows: DataFrame, count: int) -> Index:
    """A new index of history and ``rows`` (see ``digests``), of which there are ``count``."""
    spark = scratch.spark
    total = count + (index.rows if index else 0)
    power = _power(total)
    if index is None:
        held = spark.createDataFrame([], INDEX)
    else:
        if index.power != power:  # the buckets have become too full
            _write_index(index.entries, power, path := scratch.path("index"))
        else:
            path = index.index_path
        held = spark.read.schema(INDEX).parquet(path)
    entries = scratch.path("entries")
    _looked_up(held, _collapsed(rows), power).write.parquet(entries)
    _write_index(spark.read.schema(ENTRIES).parquet(entries), power, new := scratch.path("index"))
    return Index(spark, entries, new, power, total)


def decide(rows: DataFrame, entries: DataFrame, count: int) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row."""
    e = entries.select("digest", F.when(F.col("winner") != NONE, F.col("winner")).alias("keep_id"), F.col("size").alias("group_size"))
    large = F.col("group_size") > max(1_000, count // 1_000)
    hot = F.broadcast(e.where(large))  # fewer than a thousand
    r = rows.select("doc_id", "digest")
    both = r.join(hot, "digest").unionByName(r.join(hot.select("digest"), "digest", "left_anti").join(e.where(~large), "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per document, dropped ones too; the rows come in ``batches`` by a hash of their id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    with arrow_rows(spark, 500):
        rows = scratch.table(digests(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "rows")
    counts = {r.batch: r["count"] for r in rows.groupBy("batch").count().collect()}  # a row a batch
    index = None
    for batch in range(batches):
        if batch in counts or index is None:
            index = ingest(scratch, index, rows.where(F.col("batch") == batch), counts.get(batch, 0))
    return decide(rows, index.entries, sum(counts.values()))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows of equal doc_id all stay or none."""
    stay = dedup(docs).where("kept").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_stay")), "left_semi")
