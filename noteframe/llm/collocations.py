"""Phrase collocations by SON partitioning: shards mined at lowered support, then all candidates counted exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import attached, stored, table, text_of
from noteframe.llm.tokens import BASE, groups, mix, powers, prefix_hashes, span_hashes

#: Bytes that end a piece, and bytes that end a word within one.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
GROUP_BYTES = 1_000_000
#: Rows that a task gives to the JVM at once.
ROWS = 65_536
#: What is locally frequent is told to the counting tasks by two bitmaps of so many bits, whatever the size of the tables: 16 MB.
FILTER_BITS = 26
#: A part with one in SHARE of all words is sent to all tasks when parts are looked up; there are fewer than 2 * SHARE of them.
SHARE = 1000


class Phrases:
    """All phrases of up to `longest` words in some texts, each text of one language: distinct ones and their counts.

    Words are numbered by a dictionary of the words themselves, phrases by their words' numbers, so nothing is merged by chance.
    """

    def __init__(self, texts: list[bytes], langs: list[str], longest: int):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8).copy()
        data[(data >= 65) & (data <= 90)] += 32
        ends = np.isin(data, np.frombuffer(PIECE_ENDS, np.uint8))
        inside = ~(ends | np.isin(data, np.frombuffer(BLANKS, np.uint8)))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, stops = edge[0::2], edge[1::2]
        self.piece = np.cumsum(ends)[starts]
        offsets = np.append(0, np.cumsum(stops - starts))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        named = pa.array(langs, pa.string()).dictionary_encode()
        self.langs, lang = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        self.lang = lang.astype(np.int64)[text]
        self.longest = longest

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        sizes = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        stops = np.cumsum(sizes)
        return span_hashes(prefix_hashes(np.frombuffer(b"".join(self.words.to_pylist()), np.uint8)), stops - sizes, stops)

    def levels(self, allowed: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each size: keys of the distinct phrases, the place of one occurrence of each, its language's number, its count.

        With `allowed`, a test of keys, only phrases whose words but the last and words but the first both pass are looked at.
        """
        n, v, hashes = len(self.code), max(1, len(self.words)), self.hashes()
        at, run, passed = np.arange(n), self.lang, None  # where phrases begin, and the number of (language, words so far)
        for size in range(1, self.longest + 1):
            if size > 1:
                fits = at + size <= n
                fits[fits] = self.piece[at[fits] + size - 1] == self.piece[at[fits]]
                if passed is not None:
                    good = np.zeros(n, bool)
                    good[at] = passed[run]
                    fits &= good[at] & good[np.minimum(at + 1, n - 1)]
                at, run = at[fits], run[fits]
            coded = pa.array(run * v + self.code[at + size - 1]).dictionary_encode()
            run = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            count = np.bincount(run, minlength=len(coded.dictionary))
            first = np.zeros(len(count), np.int64)
            first[run] = at
            keys = self.keys(size, first, self.lang[first], hashes)
            if allowed is not None:
                passed = allowed(keys)
            yield size, keys, first, self.lang[first], count

    def keys(self, size: int, at: np.ndarray, lang: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Hashes of phrases with their language; the lowest four bits are free for a shard."""
        salts = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in self.langs], np.uint64)
        total = salts[lang] + np.uint64(size)
        for k in range(size):
            total += hashes[self.code[at + k]] * powers(BASE, 64)[k + 1]
        return mix(total) & ~np.uint64(15)


def in_rows(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns as batches of ROWS rows: what is handed over at once stays small."""
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, len(whole), ROWS):
        yield whole.slice(at, ROWS)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().cast("binary").alias("text"))


def locally_frequent(docs: DataFrame, support: int, longest: int, shards: int) -> np.ndarray:
    """Bitmaps of all phrases that stand `support / shards` times or more, rounded up, in one shard at least.

    The corpus is dealt into shards (16 at most) by its scan's tasks, and each shard is mined completely, level by level: words and
    pairs, then longer phrases of which both parts that are one word shorter are frequent somewhere. If a phrase stayed
    under that number in all shards, it would stay under `support` in all, so none that is frequent is missed. A hash
    that several phrases share only lets more through.
    """
    local, bits = -(-support // shards), np.zeros((2 << FILTER_BITS) // 8, np.uint8)
    texts = texts_of(docs)
    for sizes in ((1, 2), *((n,) for n in range(3, longest + 1))):
        counts = texts.mapInArrow(_mining(texts.sparkSession.sparkContext.broadcast(bits) if sizes[0] > 1 else None, sizes, shards), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        bits |= bitmaps(counts.where(F.col("n") >= local).select(F.col("key").bitwiseAND(F.lit(-16)).alias("hash")))
    return bits


def _mining(bits: Broadcast | None, sizes: tuple[int, ...], shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = np.uint64(TaskContext.get().partitionId() % shards)
        allowed = None if bits is None else lambda keys: has_bits(bits.value, keys)
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                p = Phrases(sub.column("text").to_pylist(), sub.column("lang").to_pylist(), sizes[-1])
                for size, keys, _, _, count in p.levels(allowed):
                    if size in sizes:
                        yield from in_rows([pa.array((keys | shard).view(np.int64)), pa.array(count.astype(np.int64))], ["key", "n"])

    return run


def bitmaps(hashes: DataFrame) -> np.ndarray:
    """Two bitmaps that have a bit for each hash, from its lower and its upper bits; built by Spark in blocks of 4 KB."""
    low = F.shiftrightunsigned("hash", 4).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    high = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = hashes.select(F.explode(F.array(low, high + F.lit(1 << FILTER_BITS))).alias("bit"))
    blocks = bits.groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((2 << FILTER_BITS) // 8, np.uint8)
    for r in blocks.collect():  # 4096 blocks at most
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low, high = np.split(bits, 2)
    found = np.ones(len(hashes), bool)
    for part, bit in ((low, hashes >> np.uint64(4) & np.uint64((1 << FILTER_BITS) - 1)), (high, hashes >> np.uint64(64 - FILTER_BITS))):
        found &= (part[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def counted(docs: DataFrame, bits: np.ndarray, support: int, longest: int) -> DataFrame:
    """lang, size, phrase, f: exact counts over all documents of every phrase that stands `support` times or more; size 0 counts all words.

    Only phrases in the bitmaps are counted, by their words: what gets in by chance is counted as well and falls out at the end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["lang", "size", "phrase", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                p = Phrases(sub.column("text").to_pylist(), sub.column("lang").to_pylist(), longest)
                langs = pa.array(p.langs, pa.string())
                total = np.bincount(p.lang, minlength=len(p.langs))
                yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), pa.array([b""] * len(langs), pa.binary()), pa.array(total.astype(np.int64))], names)
                for size, keys, at, lang, count in p.levels(lambda keys: has_bits(shared.value, keys)):
                    keep = has_bits(shared.value, keys)
                    at, lang, count = at[keep], lang[keep], count[keep]
                    words = [p.words.take(pa.array(p.code[at + k])) for k in range(size)]
                    phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if size > 1 else words[0]
                    yield from in_rows([langs.take(pa.array(lang)), pa.array(np.full(len(at), size, np.int32)), phrase.cast(pa.binary()), pa.array(count.astype(np.int64))], names)

    found = texts_of(docs).mapInArrow(run, "lang string, size int, phrase binary, f long")
    sums = found.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= support) | (F.col("size") == 0))


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, top: int = 2000, covered: int = 50, shards: int = 4) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to `longest` words that stand `support` times or more are scored by their weakest cut,
    floor(1000000 a² / (l r)); those that lie in a longer one which has `covered` percent of their count are dropped. Counts
    are exact as long as they are under 4e15; `shards` is 16 at most. Null languages are `und`, null and empty texts have no words;
    repeated documents count each; other columns are ignored. An empty table gives no row.
    """
    docs = docs.select("lang", "text")
    counts = stored(counted(docs, locally_frequent(docs, support, longest, shards), support, longest), "phrases")
    totals = counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    candidates = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    heavy = F.col("f") * SHARE > words
    for column, name in (("first", "l"), ("rest", "r")):
        known = counts.where("size > 0").select("lang", F.col("phrase").alias(column), "f")
        cuts = attached(cuts, known, ["lang", column], heavy, "inner").withColumnRenamed("f", name)
    exact = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")}
    score = F.expr("(cast(1000000 as decimal(38,0)) * da * da) div (dl * dr)")
    cuts = cuts.withColumns({f"d{c}": x for c, x in exact.items()}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    longer = inner.groupBy("lang", part(F.col("s"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    kept = stored(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each part of a language, then the first of all its parts: no task sorts a whole language
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))
