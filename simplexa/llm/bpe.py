"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of at most ``chunk_chars`` code points is one chunk.  A longer one is cut
into chunks that overlap by ``overlap`` code points; every chunk is pre-tokenised
and its pieces encoded by a task of its own, and the chunks of a document are
stitched at the first boundary on which two neighbours agree.

Why stitching is exact: the pattern is matched from left to right and looks ahead
only.  From a true boundary on, matching depends on the text behind it alone, so
two passes that share one boundary share all that follow.  A chunk's boundaries
are trusted up to ``GUARD`` code points before its end, since a match that ends
earlier cannot change when more text follows.  Where two chunks share no trusted
boundary (one piece spans the overlap), the text between is matched anew.

Cases: a null text counts as empty (0 tokens); texts of any length are encoded
whole; repeated rows give repeated results; a null doc_id is kept; further columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import small_batches

GUARD = 4
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = "doc_id long, ids array<int>, decoded binary"


class Codec:
    """Pieces to ids and ids to bytes by a table of ranks."""

    def __init__(self, path: str, pattern: str, cache_size: int = 200_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        codec = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.asarray(codec.enc._encode_single_piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= 48:
                    if len(self) >= cache_size:
                        self.clear()
                    self[piece] = ids
                return ids

        self.cache = Cache()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.find.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ends of the pieces, number of ids up to each, and the ids."""
        pieces = self.find.findall(text)
        ids = list(map(self.cache.__getitem__, pieces))
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        counts = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)
        return ends, counts, b"".join(ids)


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def stitch(c: Codec, chunks: list[tuple[int, str, np.ndarray, np.ndarray, bytes]]) -> bytes:
    """Ids of a document from its chunks (start, text, ends, counts, ids), in order of start.

    ``ends`` are positions within the document.
    """
    out: list[bytes] = []
    at = 0  # a true boundary; all before it is in out
    for k, (start, text, ends, counts, ids) in enumerate(chunks):
        last = k + 1 == len(chunks)
        stop = start + len(text)
        trusted = int(np.searchsorted(ends, stop if last else stop - GUARD, side="right"))
        if k == 0:
            i = 0
        elif at == start:
            i = 0
        else:
            i = int(np.searchsorted(ends[:trusted], at))
            if i < trusted and ends[i] == at:
                i += 1
            else:
                # no shared boundary: match anew from the last true one until it meets this chunk's
                behind, off = _text_between(chunks, at, stop), at
                known = set(ends[:trusted].tolist())
                i = trusted
                for m in c.find.finditer(behind):
                    end = off + m.end()
                    if not last and end > stop - GUARD:
                        break
                    out.append(c.cache[m.group()])
                    at = end
                    if end in known:
                        i = int(np.searchsorted(ends, end)) + 1
                        break
        if i < trusted:
            first = int(counts[i - 1]) if i else 0
            out.append(ids[4 * first : 4 * int(counts[trusted - 1])])
            at = int(ends[trusted - 1])
    return b"".join(out)


def _text_between(chunks: list, a: int, b: int) -> str:
    parts, at = [], a
    for start, text, *_ in chunks:
        if start <= at < start + len(text):
            parts.append(text[at - start : b - start])
            at = start + min(len(text), b - start)
            if at >= b:
                break
    return "".join(parts)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, *, chunk_chars: int = 32768, overlap: int = 512, full: bool = False
) -> DataFrame:
    """Encode and decode ``text`` of every row; digests, or with ``full`` the ids and bytes themselves."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")

    def finish(ids: list, c: Codec, bodies: list[bytes]) -> pa.RecordBatch:
        decoded = [c.decode(b) for b in bodies]
        if full:
            arrays = [pa.array(ids, pa.int64()), pa.array([np.frombuffer(b, "<i4") for b in bodies], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])
        hashed = [hashlib.sha256(b).hexdigest() for b in bodies], [hashlib.sha256(b).hexdigest() for b in decoded]
        arrays = [pa.array(ids, pa.int64()), pa.array([len(b) // 4 for b in bodies], pa.int64()), *(pa.array(h, pa.string()) for h in hashed)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield finish(b.column(0).to_pylist(), c, [c.encode(t) for t in b.column(1).to_pylist()])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            rows = []
            for row, doc, start, text in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "start", "text")), strict=True):
                ends, counts, ids = c.chunk(text)
                rows.append((row, doc, start, text, ends + start, counts, ids))
            names = ["row", "doc_id", "start", "text", "ends", "counts", "ids"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def joined(table: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        cols = [table.column(n).to_pylist() for n in ("start", "text", "ends", "counts", "ids")]
        chunks = [(s, t, np.asarray(e, np.int64), np.asarray(n, np.int64), i) for s, t, e, n, i in sorted(zip(*cols, strict=True), key=lambda r: r[0])]
        return pa.Table.from_batches([finish([table.column("doc_id")[0].as_py()], c, [stitch(c, chunks)])])

    schema = FULL_SCHEMA if full else SCHEMA
    small = docs.where(size <= chunk_chars).mapInArrow(short, schema)
    step = chunk_chars - overlap
    # the row number tells repeated ids apart; it lives only within this expression's one exchange
    long = docs.where(size > chunk_chars).withColumn("row", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))
    starts = F.sequence(F.lit(0), F.greatest(size - overlap - 1, F.lit(0)), F.lit(step))
    long = (
        long.withColumn("at", F.explode(starts))
        .select("row", "doc_id", F.col("at").cast("long").alias("start"), F.substring("text", F.col("at") + 1, F.lit(chunk_chars)).alias("text"))
        .repartition("row", "start")
        .mapInArrow(pieces, "row long, doc_id long, start long, text string, ends array<long>, counts array<long>, ids binary")
    )
    return small.unionByName(long.groupBy("row").applyInArrow(joined, schema))
