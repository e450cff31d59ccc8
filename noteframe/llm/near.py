"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import digest_of, gathered, sent, stored, table, text_of
from noteframe.llm.graph import components, merged
from noteframe.llm.tokens import LETTERS, Group, groups, mix

SHINGLE = 5
SIMILAR = 0.8
#: Samples in a band, and bands: texts of similarity 0.8 meet in a band with a chance of 1 - (1 - 0.8**3)**9 = 0.998.
ROWS, BANDS = 3, 9
SAMPLES = ROWS * BANDS
#: Pairs with fewer equal samples than this are not verified: at similarity 0.8 that is five standard deviations off.
LEAST_EQUAL = 11
#: In a bucket up to this size all pairs are taken; in a larger one each row meets the first and the next NEXT rows.
ALL_PAIRS, NEXT = 12, 3
#: Keys of texts to verify are sent to all tasks up to so many (about 10 MB).
MAX_ENDS = 200_000
#: A bucket is spread over cells of about so many rows.
CELL = 2048
#: Shingles in this share of the documents have document frequencies of their own; all others count as if they were just below it.
FREQUENT = 1 / 1000
#: The least weight of a frequent shingle, as a share of a rare one's.
LEAST_WEIGHT = 0.7
#: Frequent shingles that tasks hold at most (16 bytes each; those of more come with the texts), and bits of the table that sets rare ones aside.
MAX_FREQUENT, SKETCH_BITS = 500_000, 21
GROUP_BYTES = 256_000
#: Shingles of rows in large buckets are counted in a table of 2**ORDER_BITS; it only sets in which order they are looked at.
ORDER_BITS, ORDER_BLOCK = 20, 1 << 14
#: What sums of weights may be off by.
SLACK = 1 - 1e-6

_rng = np.random.default_rng(77)
#: Quantiles of Gamma(2, 1) in the middle of 65,536 equal parts, in random order; drawn by 16 bits of a hash.
_u = (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma_quantiles() -> np.ndarray:
    x = np.full(len(_u), 1.7)
    lo, hi = np.zeros(len(_u)), np.full(len(_u), 40.0)
    for _ in range(60):
        below = 1 - np.exp(-x) * (1 + x) < _u
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        x = (lo + hi) / 2
    return x


GAMMA = _rng.permutation(_gamma_quantiles())
LOG_C = np.log(_rng.permutation(_gamma_quantiles()))
SALTS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Frequencies:
    """How many of `documents` hold each of the frequent shingles, those that `least` documents hold at least.

    Where they are more than MAX_FREQUENT, the rarer ones are rows of `more` (shingle, n); only shingles whose bucket is
    marked in `may` can be frequent.
    """

    documents: int
    least: int
    hashes: np.ndarray  # ascending
    counts: np.ndarray
    may: np.ndarray
    more: DataFrame | None = None


@dataclass
class Idf:
    """Inverse document frequencies: of the frequent shingles their own, of all others that of the rarest frequent ones."""

    hashes: np.ndarray
    counts: np.ndarray
    documents: int
    rest: float

    def value(self, counts: np.ndarray) -> np.ndarray:
        """But no less than LEAST_WEIGHT of that of rare shingles: see idf_of."""
        return np.log((self.documents + 1.0) / (counts + 0.5)).clip(LEAST_WEIGHT * self.rest, self.rest)

    def of(self, hashes: np.ndarray, own: list[pa.ListArray] = ()) -> np.ndarray:
        """own: shingles (shingle, n) of the texts that frequencies of their own come with."""
        out = np.full(len(hashes), self.rest)
        parts = [tuple(x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten()) for part in own if part.null_count < len(part)]
        tables = [(self.hashes, self.counts)]
        if parts:
            found, first = np.unique(np.concatenate([a for a, _ in parts]).view(np.uint64), return_index=True)
            tables.append((found, np.concatenate([n for _, n in parts])[first]))
        for known, counts in tables:
            if len(known):
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                same = np.flatnonzero(known[at] == hashes)
                out[same] = self.value(counts[at[same]])
        return out


def document_frequencies(docs: DataFrame) -> Frequencies:
    """Exact document frequencies of all shingles in FREQUENT of the documents or more, over all documents (column text, binary).

    A first pass adds up how often shingles of each of 2**SKETCH_BITS buckets stand in all texts, which is no less than
    any one's document frequency; a second counts the documents of those whose bucket reaches the bound. So what is
    shuffled follows from FREQUENT, and not from how many shingles the corpus has. Should more than MAX_FREQUENT reach
    it, as texts are very long, those above twice the bound (or four times it, and so on) are held by tasks, and all others are joined to the texts
    (`with_frequencies`): none is left out.
    """
    documents = docs.count()
    least = max(2, math.ceil(documents * FREQUENT))
    may = np.packbits(shingle_counts(docs, SKETCH_BITS) >= least, bitorder="little")
    shared = docs.sparkSession.sparkContext.broadcast(may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [marked_shingles(sub, shared.value)[1] for sub in groups(batch, GROUP_BYTES)]
            hashes, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = gathered(docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    held = least
    while counts.where(F.col("n") >= held).count() > MAX_FREQUENT:
        held *= 2
    rows = counts.where(F.col("n") >= held).toArrow()
    hashes, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    return Frequencies(documents, least, hashes[order], n[order], may, None if held == least else counts.where(F.col("n") < held))


def marked_shingles(batch: pa.RecordBatch, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a group (column text) whose bucket is marked: which text, the hash."""
    owner, hashes = all_shingles(Group(batch.column("text").to_pylist(), LETTERS))
    bit = hashes >> np.uint64(64 - SKETCH_BITS)
    marked = (may[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    order = np.lexsort((owner[marked], hashes[marked]))
    owner, hashes = owner[marked][order], hashes[marked][order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return owner[first], hashes[first]


def with_frequencies(docs: DataFrame, frequencies: Frequencies) -> DataFrame:
    """The documents (doc_id, digest, text) and in `own` the frequencies (shingle, n) of their shingles that tasks don't hold; null if none."""
    kind = "array<struct<shingle: bigint, n: bigint>>"
    if frequencies.more is None:
        return docs.withColumn("own", F.lit(None).cast(kind))
    shared = docs.sparkSession.sparkContext.broadcast(frequencies.may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                owner, hashes = marked_shingles(sub, shared.value)
                yield pa.RecordBatch.from_arrays([sub.column("digest").take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["digest", "shingle"])

    pairs = docs.select("digest", "text").mapInArrow(run, "digest string, shingle long").distinct()
    own = pairs.join(frequencies.more, "shingle").groupBy("digest").agg(F.collect_list(F.struct("shingle", "n")).cast(kind).alias("own"))
    return stored(docs.join(own, "digest", "left").select("doc_id", "digest", "text", "own"), "weighted")


def idf_of(frequencies: Frequencies) -> Idf:
    """Logarithms of the inverse frequencies, but no less than LEAST_WEIGHT of that of rare shingles.

    A large group of near copies makes its own shingles frequent. Without a bound each copy's few edits would weigh more
    than all that the group shares, and the larger the group, the less alike its copies would be.
    """
    rest = max(math.log((frequencies.documents + 1.0) / (frequencies.least - 0.5)), 0.05)
    return Idf(frequencies.hashes, frequencies.counts, frequencies.documents, rest)


def all_shingles(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """Which text and the hash of every shingle where it stands: five words in a row. A text of one to four words is one shingle of them all."""
    at, hashes = g.combined(list(range(SHINGLE)), 0)
    owner = g.owner[at]
    short = np.flatnonzero((g.count > 0) & (g.count < SHINGLE))
    if len(short):
        few = [mix(np.add.reduce(g.words[a : a + n] * np.arange(3, 3 + n, dtype=np.uint64), keepdims=True))[0] for a, n in zip(g.first[short], g.count[short], strict=True)]
        owner, hashes = np.append(owner, short), np.append(hashes, np.array(few, np.uint64))
    return owner, hashes


def shingles(g: Group, idf: Idf, own: list[pa.ListArray] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: which text (ascending), the shingle's hash (ascending in it), its TF-IDF weight: how often it stands in the text times its inverse document frequency."""
    owner, hashes = all_shingles(g)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)])
    owner, hashes, times = owner[first], hashes[first], np.diff(first, append=len(owner))
    return owner, hashes, times * idf.of(hashes, own)


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text that has shingles, SAMPLES samples of 32 bits. Two texts agree in one with the chance of their weighted Jaccard similarity.

    Improved consistent weighted sampling: with r and c from Gamma(2, 1) and beta uniform, all drawn by a hash of
    sample and shingle, t = floor(log(w) / r + beta), log(y) = r (t - beta), and the shingle of the smallest
    log(c) - log(y) - r is sampled, together with its t.
    """
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    counts = np.diff(first, append=len(owner))
    out = np.empty((len(first), SAMPLES), np.uint32)
    log_w = np.log(weights)
    text = np.repeat(np.arange(len(first)), counts)
    low = np.uint64(0xFFFF)
    for k, salt in enumerate(SALTS):
        h = hashes * salt
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        r = GAMMA[(h & low).astype(np.int64)]
        beta = ((h >> np.uint64(32)) & low).astype(np.float64) * 2.0**-16
        t = np.floor(log_w / r + beta)
        a = LOG_C[((h >> np.uint64(16)) & low).astype(np.int64)] - r * (t - beta + 1.0) + (h >> np.uint64(48)).astype(np.float64) * 2.0**-36
        least = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == least[text])
        chosen = np.empty(len(first), np.int64)
        chosen[text[at[::-1]]] = at[::-1]
        out[:, k] = mix(hashes[chosen] + t[chosen].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return out


def signed(docs: DataFrame, shared: Broadcast[Idf]) -> DataFrame:
    """key (of the row), doc_id, digest, same (equal for texts of equal words), signature (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, so_far = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                g = Group(sub.column("text").to_pylist(), LETTERS)
                found = [None] * len(sub)
                owner, hashes, weights = shingles(g, shared.value, [sub.column("own")])
                if len(owner):
                    for k, s in zip(np.unique(owner).tolist(), signatures(owner, hashes, weights), strict=True):
                        found[k] = s.tobytes()
                total = [b"%x.%x.%d" % (int(a), int(b), n) for a, b, n in zip(*sums(g), g.count, strict=True)]
                # texts without words are alike only if their bytes are
                same = [t if n else b"=" + x.encode() for t, n, x in zip(total, g.count, sub.column("digest").to_pylist(), strict=True)]
                keys = pa.array(np.arange(len(sub)) + (key + so_far))
                so_far += len(sub)
                yield pa.RecordBatch.from_arrays([keys, sub.column("doc_id"), sub.column("digest"), pa.array(same, pa.binary()), pa.array(found, pa.binary())], ["key", "doc_id", "digest", "same", "signature"])

    return docs.select("doc_id", "digest", "text", "own").mapInArrow(run, f"key long, doc_id {dict(docs.dtypes)['doc_id']}, digest string, same binary, signature binary")


def sums(g: Group) -> list[np.ndarray]:
    """Two hashes of 64 bits of each text's words in their order."""
    out = []
    place = np.arange(len(g.words), dtype=np.uint64) - g.first[g.owner].astype(np.uint64)
    for salt in (1, 2):
        h = np.append(np.uint64(0), np.cumsum(mix(g.words * np.uint64(2 * salt + 1) + mix(place + np.uint64(salt << 40)))))
        out.append(h[g.first + g.count] - h[g.first])
    return out


def buckets_of(rows: DataFrame) -> DataFrame:
    """key, signature, bucket, size, cell and turn for each band of rows (key, signature); buckets of one row are left out.

    A bucket is worked on in cells of about CELL rows, so a group of copies of any size is spread over many tasks.
    """
    width = 4 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.substring("signature", i * width + 1, F.lit(width)).alias("part")))
    split = rows.select("key", "signature", F.inline(bands))
    split = split.select("key", "signature", F.xxhash64("band", "part").alias("bucket"), F.xxhash64("band", "key").alias("turn"))
    sizes = split.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cells = F.ceil(F.col("size") / F.lit(CELL))
    return split.join(sizes, "bucket").withColumn("cell", F.pmod(F.xxhash64("turn"), cells).cast("long"))


def alike_enough(one: str, other: str) -> Column:
    """Whether LEAST_EQUAL samples of two signatures are equal; a sample has four bytes."""
    same = lambda n, i: n + (F.substring(one, i * 4 + 1, F.lit(4)) == F.substring(other, i * 4 + 1, F.lit(4))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0), same) >= LEAST_EQUAL


def band_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that share a bucket and LEAST_EQUAL samples in all; distinct.

    All pairs of a small bucket are taken. In a large one each row meets the first row of its cell and the NEXT rows, in
    an order that other bands do not share, and the first row of each cell meets that of the bucket; pairs grow with the
    rows of a bucket, never with their square.
    """
    cell = W.partitionBy("bucket", "cell").orderBy("turn", "key")
    who = F.struct("key", "signature")
    near = [F.lead(who, k).over(cell) for k in range(1, NEXT + 1)]
    # in a small bucket the rest of the pairs comes from further leads
    more = [F.when(F.col("size") <= ALL_PAIRS, F.lead(who, k).over(cell)) for k in range(NEXT + 1, ALL_PAIRS)]
    met = buckets.select("key", "signature", F.array(F.first(who).over(cell), *near, *more).alias("met"))
    met = met.select("key", "signature", F.inline(F.transform(F.filter("met", lambda m: m.isNotNull() & (m["key"] != F.col("key"))), lambda m: F.struct(m["key"].alias("other"), m["signature"].alias("other_signature")))))
    firsts = buckets.where(F.col("size") > CELL).groupBy("bucket", "cell").agg(F.min(F.struct("turn", "key", "signature")).alias("first"))
    top = firsts.groupBy("bucket").agg(F.min("first").alias("top"))
    heads = firsts.join(top, "bucket").select("first.key", "first.signature", F.col("top.key").alias("other"), F.col("top.signature").alias("other_signature")).where("key != other")
    both = met.union(heads).where(alike_enough("signature", "other_signature"))
    return both.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def hub_pairs(large: DataFrame, signs: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Further pairs for large buckets whose rows are in several classes so far: each row outside the bucket's largest
    class meets that class's hub, its row with most links. So copies that are only like what they were copied from are
    compared with it, wherever it stands in the order of its buckets."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hubs = degree.join(roots, "node").groupBy("root").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    tied = large.select("key", "signature", "bucket").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = tied.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    top = classes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    top = top.join(hubs.withColumnRenamed("root", "largest"), "largest", "left").withColumn("hub", F.coalesce("hub", "largest"))
    top = top.join(signs.select(F.col("key").alias("hub"), F.col("signature").alias("hub_signature")), "hub")
    met = tied.join(top, "bucket").where((F.col("root") != F.col("largest")) & alike_enough("signature", "hub_signature"))
    return met.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def shingle_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """For each of 2**bits buckets of shingles how often its shingles stand in the texts; added up by Spark in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                at, n = np.unique(all_shingles(Group(sub.column("text").to_pylist(), LETTERS))[1] >> np.uint64(64 - bits), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        for k, block in enumerate(total.reshape(-1, ORDER_BLOCK)):
            at = np.flatnonzero(block)
            if len(at):
                yield pa.RecordBatch.from_arrays(counts_row(k, block), names)

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(ORDER_BLOCK, np.int64)
        for at, n in zip(part.column("at"), part.column("n"), strict=True):
            at, n = np.frombuffer(at.as_py(), np.uint16), n.as_py()
            total[at] += np.frombuffer(n, f"<u{len(n) // len(at)}")
        return pa.table(counts_row(part.column("block")[0].as_py(), total), names)

    # blocks hold their counts that are not zero; a block's parts meet in two steps, so that none of many tasks' is large
    names, schema = ["block", "at", "n"], "block long, at binary, n binary"
    parts = texts.select("text").mapInArrow(run, schema).withColumn("turn", F.spark_partition_id() % F.lit(32))
    some = parts.groupBy("block", "turn").applyInArrow(add, schema)
    out = np.zeros((1 << bits) // ORDER_BLOCK * ORDER_BLOCK, np.uint32).reshape(-1, ORDER_BLOCK)
    # few partitions, as each one is a job of its own
    for r in some.groupBy("block").applyInArrow(add, schema).coalesce(8).toLocalIterator():
        at = np.frombuffer(r["at"], np.uint16)
        out[r["block"], at] = np.frombuffer(r["n"], f"<u{len(r['n']) // len(at)}").clip(max=2**32 - 1)
    return out.ravel()


def counts_row(block: int, counts: np.ndarray) -> list[pa.Array]:
    """A block's places that have a count, two bytes each, and the counts in as few bytes as the largest needs."""
    at = np.flatnonzero(counts)
    kind = np.min_scalar_type(int(counts[at].max()))
    return [pa.array([block], pa.int64()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[at].astype(kind).tobytes()], pa.binary())]


def rare_shingles(texts: DataFrame, shared_idf: Broadcast[Idf], shared_counts: Broadcast[np.ndarray], similar: float) -> DataFrame:
    """shingle, key, root, total, rest, short: the first shingles of each text (key, root, text, own) in the order of their counts.

    `total` is the weight of the text and `rest` that of this shingle and all later ones. Two texts whose similarity is
    at least `similar` share a weight of similar / (1 + similar) times both totals, and all that they share is in the
    rest of both at the first shingle that they share. So that shingle is among those with a rest of similar x total,
    which are returned, and for the text of smaller total among those with 2 x similar / (1 + similar) x total (`short`).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, counts = shared_idf.value, shared_counts.value
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                owner, hashes, weights = shingles(Group(sub.column("text").to_pylist(), LETTERS), idf, [sub.column("own")])
                order = np.lexsort((hashes, counts[(hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], owner))
                owner, hashes, weights = owner[order], hashes[order], weights[order]
                before = np.append(0, np.cumsum(weights))[:-1]
                total = np.bincount(owner, weights=weights, minlength=len(sub))[owner]
                rest = total - (before - before[np.searchsorted(owner, owner)])
                keep = np.flatnonzero(rest >= similar * total * SLACK)
                short = rest >= 2 * similar / (1 + similar) * total * SLACK
                at = pa.array(owner[keep])
                columns = [pa.array(hashes[keep].view(np.int64)), sub.column("key").take(at), sub.column("root").take(at), pa.array(total[keep]), pa.array(rest[keep]), pa.array(short[keep])]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "key", "root", "total", "rest", "short"])

    return texts.select("key", "root", "text", "own").mapInArrow(run, "shingle long, key long, root long, total double, rest double, short boolean")


def joined_pairs(rare: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of rows of different classes that share one of their first shingles and may be alike; distinct.

    Classes meet before rows do, so rows of one class, however large, are never paired with each other.
    """
    classes = rare.groupBy("shingle", "root").agg(F.max("short").alias("short"))
    several = classes.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("any")).where("n > 1 and any").select("shingle")
    classes = classes.join(several, "shingle")
    meet = classes.select("shingle", "root").join(classes.where("short").select("shingle", F.col("root").alias("other_root")), "shingle").where("root != other_root")
    other = rare.where("short").select("shingle", *(F.col(x).alias(f"other_{x}") for x in ("key", "root", "total", "rest")))
    met = rare.select("shingle", "key", "root", "total", "rest").join(meet, ["shingle", "root"]).join(other, ["shingle", "other_root"])
    met = met.where(F.struct("other_total", "other_key") < F.struct("total", "key"))
    met = met.where(F.least("rest", "other_rest") >= F.lit(similar / (1 + similar) * SLACK) * (F.col("total") + F.col("other_total")))
    return met.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")).distinct()


def weighted_jaccard(g: Group, idf: Idf, own: list[pa.ListArray] = ()) -> np.ndarray:
    """Similarities of the texts 0 and 1, 2 and 3, and so on."""
    owner, hashes, weights = shingles(g, idf, own)
    pair = owner // 2
    order = np.lexsort((owner, hashes, pair))
    p, h, w = pair[order], hashes[order], weights[order]
    both = np.flatnonzero((p[1:] == p[:-1]) & (h[1:] == h[:-1]))
    n = len(g.count) // 2
    least = np.bincount(p[both], weights=np.minimum(w[both], w[both + 1]), minlength=n)
    total = np.bincount(p, weights=w, minlength=n)
    return least / np.maximum(total - least, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast[Idf], similar: float) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity, computed from their whole texts, is at least `similar`."""
    one, other = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    full = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b", "own_a", "own_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES // 2, "text_a"):
                texts = [x for both in zip(sub.column("text_a").to_pylist(), sub.column("text_b").to_pylist(), strict=True) for x in both]
                found = weighted_jaccard(Group(texts, LETTERS), shared.value, [sub.column("own_a"), sub.column("own_b")])
                keep = np.flatnonzero(found >= similar)
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([sub.column("a").take(at), sub.column("b").take(at), pa.array(found[keep])], ["a", "b", "similarity"])

    return full.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id, digest (md5 of the text), class_id (smallest id of its class), kept (one row of each class), copies (rows with its words) for every row.

    Words are runs of letters and digits without regard to case. Texts of equal words are one class and are carried by
    one of them; texts without words are alike if equal. Classes are the connected components of verified links. Pairs
    that are verified come from bands of samples (see the constants for the chance to miss a pair): in buckets of up to
    ALL_PAIRS rows all of them, in larger ones each row with the first and the next few, nine times in different orders,
    and then with the hub of the bucket's largest class, until that links nothing new. Rows of large buckets that still
    hold several classes are then joined by their rarest shingles, which finds every pair of them that is alike.

    A null text is empty. Rows that repeat an id keep one row each and one class if alike; rows without an id have class
    null if no row of their class has one. An empty table gives no rows. Texts are fetched by id and digest, so it does
    not matter how another scan of the table is split.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"), F.lower(text_of(text_col)).cast("binary").alias("text"))
    spark = df.sparkSession
    frequencies = document_frequencies(docs)
    docs = with_frequencies(docs, frequencies)
    idf = spark.sparkContext.broadcast(idf_of(frequencies))  # once for all rounds
    rows = stored(signed(docs, idf), "signed")
    # stored before they are joined, so that adaptive execution can split a large group of copies
    alike = stored(rows.groupBy("same").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("copies")), "alike")
    member = stored(rows.select("key", "doc_id", "digest", "same").join(alike, "same").select("key", "doc_id", "digest", "leader", "copies"), "members")
    leaders = rows.where("signature is not null").join(alike.select(F.col("leader").alias("key")), "key", "left_semi").select("key", "signature")
    leaders = stored(leaders, "leaders")

    def texts_of(ends: DataFrame) -> DataFrame:
        few = ends.count() <= MAX_ENDS  # else whole texts are shuffled to the keys
        send = F.broadcast if few else (lambda x: x)
        # a row's key is not in the given table, its id and text are; equal rows give a text twice, which changes nothing
        wanted = member.where("key = leader").join(send(ends), "key", "left_semi").select("key", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        found = docs.select("doc_id", "digest", "text", "own").join(send(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
        return found.select("key", "text", "own")

    def links_of(pairs: DataFrame) -> DataFrame:
        texts = texts_of(gathered(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()))
        return gathered(verified(pairs, texts, idf, similar).select("a", "b"))

    buckets = stored(buckets_of(leaders), "buckets")
    pairs = gathered(band_pairs(buckets))
    links = links_of(pairs)
    roots = components(links)
    large = buckets.where(F.col("size") > ALL_PAIRS)
    while True:  # until the hubs of large buckets link nothing new
        further = gathered(hub_pairs(large, leaders, links, sent(roots)).join(pairs, ["a", "b"], "left_anti"))
        if further.isEmpty():
            break
        new = links_of(further)
        pairs = pairs.union(further)
        if new.isEmpty():
            break
        links = links.union(new)
        roots = merged(roots, new)
    tied = large.select("key", "bucket").join(sent(roots).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_buckets = tied.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    open_rows = gathered(tied.join(open_buckets.select("bucket"), "bucket", "left_semi").select("key", "root").distinct())
    if not open_rows.isEmpty():
        texts = stored(texts_of(open_rows.select("key")).join(open_rows, "key"), "open")
        counts = spark.sparkContext.broadcast(shingle_counts(texts, ORDER_BITS))
        rare = stored(rare_shingles(texts, idf, counts, similar), "rare")
        counts.destroy()
        further = joined_pairs(rare, similar).join(pairs, ["a", "b"], "left_anti")
        one, other = (leaders.select(F.col("key").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab")
        further = gathered(further.join(one, "a").join(other, "b").where(alike_enough("signature_a", "signature_b")).select("a", "b"))
        roots = merged(roots, links_of(further))
    idf.destroy()  # all that needs it is written
    tied = member.join(sent(roots).withColumnRenamed("node", "leader"), "leader", "left").withColumn("root", F.coalesce("root", "leader"))
    tied = stored(tied, "tied")
    named = stored(tied.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")), "classes")
    out = tied.join(named, "root")
    return out.select("doc_id", "digest", "class_id", (F.col("best.key") == F.col("key")).alias("kept"), "copies")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest")
