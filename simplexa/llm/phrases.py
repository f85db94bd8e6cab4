"""Phrase collocations: exact counts of word n-grams by language, scored by their weakest cut.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into
words ``[^\\x20\\x09]+``.  By language, n counts all words and f(phrase) all contiguous
occurrences within pieces.  Candidates are phrases of 2 to ``longest`` words with
a = f(phrase) >= ``least``.  A cut after k words has l = f(first part), r = f(rest) and the
score floor(1000 a n / (l r)); the lowest cut counts, ties to the smallest k.  A candidate
is dropped where its words lie in a longer candidate (dropped or not) that is as frequent.
The ``top`` best of each language are returned.

Counting.  Identical pieces become one with a multiplicity.  A phrase is frequent only if
all its words and all its word pairs are, so words are counted first, then pairs of
frequent words, then longer phrases of frequent pairs.  What is frequent travels between
these passes as a bit array of bounded size that may say yes wrongly, never no: a larger corpus
makes passes emit more, but changes no count.  A task sums the phrases of some hundred
thousand words at a time before it sends them; they are dealt by hash of language and
phrase, so that each partition is a bucket, and DuckDB sums the weights of a bucket as they
stream in, within ``MEMORY`` and else out of core in the folder where the executor itself
spills, for the time of the task.

Parts.  Each candidate asks for the counts of the two parts of each cut; requests and counts
meet by a shuffled join on language and part.  Every part is frequent, as the candidate is.

Cases: null texts are empty, a null language is ``und`` (as is a row that says ``und``); a piece without
words counts nothing; rows that repeat count again; phrases that tie in score and count are ranked by their UTF-8 bytes;
ids are not read; texts are read whole; an empty table gives no rows; further columns are ignored.  Arithmetic is in decimals
of 38 digits, which hold 1000 a n for corpora of up to 10^17 words; beyond, Spark raises.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplexa.llm.common import Scratch, arrow_rows

PIECE_END = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CHUNK_WORDS = 500_000
CHUNK_CHARS = 8_000_000
MEMORY = "256MB"
#: a filter holds 2^MOST_BITS bits at most (8 MB)
MOST_BITS = 26
GRAMS = "lang string, phrase string, f long"


# --- pieces ----------------------------------------------------------------------------


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, their words joined by one space, with multiplicities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict[tuple[str, str], int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "piece", "m"])

        held: dict[tuple[str, str], int] = {}
        chars = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in PIECE_END.split(text.translate(UPPER)):
                    if piece := " ".join(WORD.findall(part)):
                        key = (lang, piece)
                        if key in held:
                            held[key] += 1
                        else:
                            held[key] = 1
                            chars += len(piece)
                if chars > CHUNK_CHARS:
                    yield out(held)
                    held, chars = {}, 0
        if held:
            yield out(held)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return texts.mapInArrow(run, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


# --- filters of what is frequent ---------------------------------------------------------


def _hashed(values: list[str]) -> np.ndarray:
    from pandas.util import hash_array

    return hash_array(np.array(values, object), categorize=False) if values else np.zeros(0, np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its beginning and of its last word."""
    with np.errstate(over="ignore"):
        x = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Of language and words in turn, as the tasks compute it."""
    words = [p.split(" ") for p in phrases]
    lens = np.array([len(w) for w in words], np.int64)
    flat = _hashed([w for ws in words for w in ws])
    at = np.cumsum(lens) - lens
    h = _hashed(langs)
    for k in range(int(lens.max(initial=0))):
        on = lens > k
        h[on] = _joined(h[on], flat[at[on] + k])
    return h


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


class Filter:
    """Which hashes may be frequent: two bits for each that is."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def __call__(self, h: np.ndarray) -> np.ndarray:
        a, b = _places(h, self.bits)
        return ((self.data[a >> 6] >> (a & 63).astype(np.uint64)) & (self.data[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _filter(frequent: DataFrame) -> Filter:
    """Built by tasks as words of 64 bits, of which at most 2^(MOST_BITS - 6) reach the driver."""
    bits = min(MOST_BITS, max(12, (16 * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(_phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist()), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "word"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    data = np.zeros(1 << (bits - 6), np.uint64)
    data[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return Filter(bits, data)


# --- counting ----------------------------------------------------------------------------


def _uniques(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position of each distinct key, its summed weight, and the number of each key's distinct value."""
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, back, weight)
    return first, total, back


def _emit(table: pa.Table, shortest: int, longest: int, words: Filter | None, pairs: Filter | None) -> Iterator[pa.RecordBatch]:
    """Weighted phrases of ``shortest`` to ``longest`` words of a chunk of pieces, each once."""
    lists = pc.split_pattern(table.column("piece").combine_chunks(), " ")
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    langs = table.column("lang").combine_chunks().dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens)
    weight = np.repeat(table.column("m").to_numpy().astype(np.int64), lens)
    room = np.repeat(np.cumsum(lens), lens) - np.arange(len(code))  # words from here to the end of the piece
    by_word, by_lang = _hashed(names.to_pylist()), _hashed(langs.dictionary.to_pylist())

    # phrases of one word by language: a number each, with its hash
    first, total, number = _uniques(lang * len(names) + code, weight)
    hashes = _joined(by_lang[lang[first]], by_word[code[first]])
    single = code[first]  # the word of each such number
    text = names.take(pa.array(single))
    if shortest == 1:
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[first])), text, pa.array(total)], ["lang", "phrase", "f"])
    if longest == 1:
        return
    good = words(hashes)[number]  # of each position
    link = np.zeros(len(code), bool)  # this word and the next may be a frequent pair
    link[:-1] = (room[:-1] > 1) & good[:-1] & good[1:]
    at = np.flatnonzero(link)
    mine = number[at]
    for n in range(2, longest + 1):
        if not len(at):
            return
        last = number[at + n - 1]
        first, total, back = _uniques(mine * (len(single) + 1) + last, weight[at])
        hashes = _joined(hashes[mine[first]], by_word[single[last[first]]])
        text = pc.binary_join_element_wise(text.take(pa.array(mine[first])), names.take(pa.array(single[last[first]])), " ")
        if n >= shortest:
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at[first]])), text, pa.array(total)], ["lang", "phrase", "f"])
        if n == 2 and longest > 2:
            keep = pairs(hashes)[back]
            link[:] = False
            link[at[keep]] = True
            at, mine = at[keep], back[keep]
        else:
            mine = back
        keep = np.zeros(len(at), bool)
        inside = at + n - 1 < len(link)
        keep[inside] = link[at[inside] + n - 1]
        at, mine = at[keep], mine[keep]


def _weighted(parts: DataFrame, shortest: int, longest: int, words: Filter | None = None, pairs: Filter | None = None) -> DataFrame:
    share = parts.sparkSession.sparkContext.broadcast  # filters are of bounded size
    held = [share((x.bits, x.data.tobytes())) if x else None for x in (words, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = (Filter(h.value[0], np.frombuffer(h.value[1], np.uint64)) if h else None for h in held)
        chunk: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            chunk.append(b)
            size += b.column(1).nbytes
            if size > 6 * CHUNK_WORDS:
                yield from _emit(pa.Table.from_batches(chunk), shortest, longest, w, p)
                chunk, size = [], 0
        if chunk:
            yield from _emit(pa.Table.from_batches(chunk), shortest, longest, w, p)

    return parts.select("lang", "piece", "m").mapInArrow(run, GRAMS)


def spill_folder() -> str:
    """A new folder beside this executor's own spill files."""
    base = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("SPARK_EXECUTOR_DIRS") or tempfile.gettempdir()).split(",")[0].split(os.pathsep)[0]
    return tempfile.mkdtemp(prefix="buckets-", dir=base if os.path.isdir(base) else None)


def counted(weighted: DataFrame, least: int, memory: str = MEMORY) -> DataFrame:
    """(lang, phrase, f) with f >= ``least``: weights dealt by hash, summed by DuckDB bucket by bucket."""
    buckets = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        folder = spill_folder()
        try:
            con = duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
            con.register("bucket", pa.RecordBatchReader.from_batches(first.schema, stream()))
            for b in con.sql(f"select lang, phrase, sum(f)::bigint as f from bucket group by lang, phrase having sum(f) >= {int(least)}").to_arrow_reader(50_000):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2)], ["lang", "phrase", "f"])
            con.close()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return weighted.repartition(buckets, "lang", "phrase").mapInArrow(run, GRAMS)


# --- scores ------------------------------------------------------------------------------


def mine(docs: DataFrame, *, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    with arrow_rows(spark, 500):
        parts = scratch.table(pieces(docs), "pieces")
    with arrow_rows(spark, 20_000):
        words = scratch.table(counted(_weighted(parts, 1, 1), least), "words")
        common = _filter(words)
        pairs = scratch.table(counted(_weighted(parts, 2, 2, common), least), "pairs")
        longer = scratch.table(counted(_weighted(parts, 3, longest, common, _filter(pairs)), least), "longer") if longest > 2 else pairs.limit(0)
        # a row a language
        sizes = scratch.table(parts.groupBy("lang").agg(F.sum(F.col("m") * F.size(F.split("piece", " "))).alias("n")), "sizes")
    phrases = pairs.unionByName(longer)
    held = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), s -> array_join(slice(w, s, k), ' '))))")
    within = longer.select("lang", F.split("phrase", " ").alias("w"), "f").select("lang", F.explode(held).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    open_ = phrases.join(within, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("f"))).select("lang", "phrase", F.col("f").alias("a"))

    cuts = open_.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("head"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("part")))).alias("ask"))
    counts = words.unionByName(phrases).select("lang", F.col("phrase").alias("part"), "f")
    answered = asked.select("lang", "phrase", "a", "k", "ask.head", "ask.part").join(counts, ["lang", "part"])
    pair = answered.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    if sizes.count() <= 100_000:
        sizes = F.broadcast(sizes)
    scored = pair.join(sizes, "lang").withColumn("score", F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
