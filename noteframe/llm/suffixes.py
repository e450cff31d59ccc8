"""Suffix-array deduplication: a distributed difference-cover suffix sort of the phrases that texts share, and exact byte windows at the edges.

Texts are cut into phrases where a hash of K bytes is the least of WINDOW in a row, so that equal bytes are cut alike
wherever they stand. Phrases that stand once cannot lie in a repeat; runs of the others are strings over an alphabet of
phrase hashes. Those are sorted by the difference cover modulo 3 (positions 1 and 2 modulo 3 first, by names of their
triples, recursively; then the rest, by their first phrase and the rank behind it; then merged), and each suffix is
compared with its neighbours. What a repeat of LENGTH bytes must share in whole phrases is known, so the comparison
tells which byte windows can be repeated at all. Those that neighbours do not already prove lie at the ends of what is
shared: all that begin before one phrase start are taken together, and compared with those whose bytes behind it are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import stored, table, text_of
from noteframe.llm.packing import binaries
from noteframe.llm.tokens import BASE, NOT_SPACE, Group, groups, mix, powers, prefix_hashes, span_hashes

#: A string of so many bytes that stands twice is removed.
LENGTH = 400
#: Phrases begin where a hash of K bytes is the least (the first of equals) of WINDOW hashes in a row.
K, WINDOW = 20, 100
#: The last start of such a window inside LENGTH bytes: two equal strings have equal phrases up to the phrase start that it gives.
LAST = LENGTH - K - WINDOW + 1
#: What equal strings have in whole phrases at least.
SHARED = LAST - WINDOW + 1
#: After so many rounds of recursion names stand for nine phrases; see `suffix_ranks`.
ROUNDS = 1
#: Bits of the fixed-size filters for phrases and windows.
FILTER_BITS = 26
GROUP_BYTES = 128_000


def cuts(g: Group) -> np.ndarray:
    """For each place of the group the phrase start that the WINDOW hashes from there give; valid inside a text only."""
    n = len(g.data) - K + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    low = np.uint64((1 << 32) - 1)
    code = (span_hashes(g.prefix, at, at + K) & ~low) | at.astype(np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        code = np.minimum(code[: len(code) - size], code[size:])
        size *= 2
    if size < WINDOW:
        code = np.minimum(code[: len(code) - (WINDOW - size)], code[WINDOW - size :])
    return (code & low).astype(np.int64)


def phrases_of(g: Group, text: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text of LENGTH bytes or more: the phrase start of each of its windows, and all phrase starts (places in the group)."""
    first, size = g.begin[text], g.bytes[text]
    own = places[first : first + size - K - WINDOW + 2]
    return own, own[np.append(True, own[1:] != own[:-1])]


#: Fixed odd numbers that spread keys over a filter, 63 bits.
SPREAD = 0x1E3779B97F4A7C15


def spread(key: Column) -> Column:
    """The upper bits of a product that keeps 63 bits; the same as in `of_keys`."""
    low, high = key.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright(key, 31)
    mixed = (low * F.lit(SPREAD % (1 << 31)) + high * F.lit((SPREAD >> 13) % (1 << 31))).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(mixed, 32)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`, the task and place of each row in this scan. Another scan may be split in another way, so the result is stored and read from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = np.arange(len(batch), dtype=np.int64) + so_far
            so_far += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns], ["key", *batch.schema.names])

    fields = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(run, f"key long, {fields}")


def of_keys(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows of docs (with key) whose keys pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (1 << 31) - 1
        for batch in batches:
            keys = batch.column("key").to_numpy()
            mixed = (((keys & half) * (SPREAD % (1 << 31))) + (keys >> 31) * ((SPREAD >> 13) % (1 << 31))) & half
            yield batch.filter(pa.array(passes(shared.value, (mixed << 32).astype(np.uint64))))

    return docs.mapInArrow(run, docs.schema)


def phrase_table(docs: DataFrame) -> DataFrame:
    """key, n_bytes, sum (md5 of the text), phrases (hashes, eight bytes each) and sizes (one byte each, as WINDOW bounds them) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                g = Group(sub.column("text").to_pylist(), NOT_SPACE)
                places, found, sizes = cuts(g), [], []
                for k, n in enumerate(g.bytes.tolist()):
                    starts = phrases_of(g, k, places)[1] if n >= LENGTH else np.zeros(1, np.int64)
                    found.append((span_hashes(g.prefix, starts[:-1], starts[1:]) >> np.uint64(1)).tobytes())
                    sizes.append(np.diff(starts).astype(np.uint8).tobytes())
                columns = [sub.column("key"), pa.array(g.bytes), sub.column("sum"), pa.array(found, pa.binary()), pa.array(sizes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "sum", "phrases", "sizes"])

    return docs.select("key", "text", F.md5("text").alias("sum")).mapInArrow(run, "key long, n_bytes long, sum string, phrases binary, sizes binary")


def filter_of(values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for each value (column `value`, 63 bits), built by Spark in blocks of 4 KB."""
    bit = F.shiftright("value", 63 - FILTER_BITS)
    blocks = values.groupBy(F.shiftright(bit, 15).alias("block")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values >> np.uint64(63 - FILTER_BITS)
    return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def runs_of(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """key, first (number of its first phrase in the text), phrases, sizes of each run of phrases that may be repeated and has SHARED bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, firsts, parts, lengths = [], [], [], []
            for key, p, s in zip(batch.column("key").to_pylist(), batch.column("phrases").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                hashes, sizes = np.frombuffer(p, np.uint64), np.frombuffer(s, np.uint8).astype(np.int32)
                edge = np.flatnonzero(np.diff(passes(shared.value, hashes).view(np.int8), prepend=0, append=0))
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    if sizes[a:b].sum() >= SHARED:
                        keys.append(key), firsts.append(a), parts.append(hashes[a:b].view(np.int64)), lengths.append(sizes[a:b])
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32))
            join = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind))
            columns = [pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), join(parts, pa.int64()), join(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "first", "phrases", "sizes"])

    return texts.select("key", "phrases", "sizes").mapInArrow(run, "key long, first int, phrases array<long>, sizes array<int>")


# the suffix sort


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df with `n`, the place of each row in the order of its keys, and `zeros`, the rows of side 0 before it.

    Spark sorts by ranges of the keys; a task numbers its own rows, and the counts of the tasks before it are added,
    which are as many numbers as there are tasks. Keys end with the row's own identity, so no range can be heavy.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, zeros = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            m = len(batch)
            side = batch.column("side").to_numpy() == 0
            before = np.cumsum(side) - side + zeros
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part)), pa.array(np.arange(m) + row), pa.array(before)], [*names, "part", "n", "zeros"])
            row, zeros = row + m, zeros + int(side.sum())

    fields = ", ".join(f"{n} {k}" for n, k in df.dtypes)
    out = stored(df.orderBy(*keys).mapInArrow(run, f"{fields}, part long, n long, zeros long"), "sorted")
    counts = out.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("side") == 0).alias("_zeros"))
    ahead = lambda c: (F.sum(c).over(W.orderBy("part")) - F.col(c)).alias(f"{c}_ahead")  # noqa: E731  as many rows as tasks
    placed = out.join(counts.select("part", ahead("_n"), ahead("_zeros")), "part")
    return placed.withColumns({"n": F.col("n") + F.col("_n_ahead"), "zeros": F.col("zeros") + F.col("_zeros_ahead")}).drop("part", "_n_ahead", "_zeros_ahead")


def listed(df: DataFrame, value: str) -> DataFrame:
    """run and the values of its rows (run, i, value) in the order of i, as structs."""
    return df.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))).alias("items"))


def suffix_ranks(strings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """run and ranks of all its suffixes, for strings (run, symbols) of whole numbers from 0.

    Each string ends with symbols of its own below all others, so no two suffixes are equal. Triples at places 1 and 2
    modulo 3 are named in their order and the names' strings are ranked recursively; after `rounds` the triples
    themselves decide, and those that are still alike are taken in any order: they share 3**(rounds + 1) symbols.
    The others are ordered by their first symbol and the rank behind it, and merged by counting, in two sorts, how many
    of the one kind stand before each of the other.
    """
    size = F.size("symbols")
    pad = lambda k: -(F.col("run") * 4 + k) - 1
    padded = strings.withColumn("symbols", F.concat("symbols", F.array(pad(0), pad(1), pad(2)))).withColumn("length", size - 3)
    get = lambda c, i: F.get(F.col(c), i)
    places = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: i % 3 != 0)
    triple = F.transform(places, lambda i: F.struct(i.alias("i"), get("symbols", i).alias("a"), get("symbols", i + 1).alias("b"), get("symbols", i + 2).alias("c")))
    samples = padded.select("run", F.inline(triple))
    if rounds == 0:
        ranked = in_order(samples.withColumn("side", F.lit(0)), "a", "b", "c", "run", "i")
        lists = listed(ranked.select("run", "i", "n"), "n")
        pick = lambda k: F.transform(F.filter("items", lambda x: x["i"] % 3 == k), lambda x: x["v"])
        ranks = lists.select("run", pick(1).alias("r1"), pick(2).alias("r2"))
    else:
        names = in_order(samples.select("a", "b", "c").distinct().withColumn("side", F.lit(0)), "a", "b", "c")
        named = listed(samples.join(names.select("a", "b", "c", F.col("n").alias("name")), ["a", "b", "c"]), "name")
        part = lambda k: F.struct((F.col("run") * 2 + (k - 1)).alias("run"), F.transform(F.filter("items", lambda x: x["i"] % 3 == k), lambda x: x["v"]).alias("symbols"))
        below = stored(named.select(F.inline(F.array(part(1), part(2)))).where(F.size("symbols") > 0), "names")
        found = suffix_ranks(below, rounds - 1)
        mine = lambda k: F.first(F.when(F.col("run") % 2 == k - 1, F.col("ranks")), ignorenulls=True)
        ranks = found.groupBy(F.shiftright("run", 1).alias("run")).agg(mine(1).alias("r1"), mine(2).alias("r2"))
    both = stored(padded.join(ranks, "run", "left"), "ranked")

    def rank(i: Column) -> Column:
        beyond = -(F.col("run") * 4 + (i - F.col("length"))) - 1
        return F.when(i >= F.col("length"), beyond).when(i % 3 == 1, get("r1", F.floor(i / 3).cast("int"))).otherwise(get("r2", F.floor(i / 3).cast("int")))

    def row(i: Column, ahead: int) -> Column:
        side = F.when(i % 3 == 0, 0).otherwise(1)
        own = F.when(i % 3 == 0, F.lit(0)).otherwise(rank(i))
        second = get("symbols", i + 1) if ahead == 2 else F.lit(0).cast("long")
        return F.struct(i.alias("i"), get("symbols", i).alias("a"), second.alias("b"), rank(i + ahead).alias("c"), side.alias("side"), own.alias("own"))

    everywhere = F.sequence(F.lit(0), F.col("length") - 1)
    kind = lambda k: both.select("run", F.inline(F.transform(F.filter(everywhere, lambda i: (i % 3 == 0) | (i % 3 == k)), lambda i: row(i, k))))
    first = in_order(kind(1), "a", "b", "c", "side", "run", "i")
    second = in_order(kind(2), "a", "b", "c", "side", "run", "i")
    sampled = F.col("zeros") + F.col("own")
    counts = first.select("run", "i", F.when(F.col("side") == 0, F.col("n")).otherwise(sampled).alias("v"))
    counts = counts.union(second.select("run", "i", F.when(F.col("side") == 0, F.col("n") - F.col("zeros")).otherwise(sampled).alias("v")))
    # places 0 modulo 3 have two counts, one from each sort, which stand side by side
    where = lambda i: (i + F.floor((i + 2) / 3)).cast("int")
    value = lambda i: F.get(F.col("items"), where(i))["v"] + F.when(i % 3 == 0, F.get(F.col("items"), where(i) + 1)["v"]).otherwise(0)
    total = (F.size("items") - F.floor((F.size("items") + 3) / 4)).cast("int")
    return listed(counts, "v").select("run", F.transform(F.sequence(F.lit(0), total - 1), value).alias("ranks"))


def shared_phrases(runs: DataFrame) -> DataFrame:
    """run, i and `shared`: how many phrases from there, up to LENGTH bytes, stand in the same order elsewhere too. 0 is left out.

    Suffixes in their order, each with the phrases of its first LENGTH bytes, are compared with both neighbours; at the
    ends of tasks with the last and first of the tasks around, which tasks report.
    """
    full = runs.join(suffix_ranks(runs.select("run", F.col("phrases").alias("symbols"))), "run")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat = lambda c: batch.column(c).flatten().to_numpy()
            data, sizes, ranks = flat("phrases"), flat("sizes").astype(np.int64), flat("ranks")
            counts = np.diff(batch.column("phrases").offsets.to_numpy())
            stop = np.repeat(np.cumsum(counts), counts)  # where the run of each phrase ends
            ends = np.append(0, np.cumsum(sizes))
            n = len(data)
            last = np.minimum(np.searchsorted(ends, ends[:-1] + LENGTH), stop)
            width = last - np.arange(n)
            at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(np.arange(n), width)
            own = np.arange(n) - (stop - np.repeat(counts, counts))
            columns = [pa.array(ranks), pa.array(np.repeat(batch.column("run").to_numpy(), counts)), pa.array(own.astype(np.int32)), binaries(data[at], width)]
            yield pa.RecordBatch.from_arrays(columns, ["rank", "run", "i", "prefix"])

    suffixes = full.mapInArrow(prefixes, "rank long, run long, i int, prefix binary").orderBy("rank", "run", "i")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, names = TaskContext.get().partitionId(), None, ["run", "i", "shared", "part", "prefix"]

        def edge(row: tuple, side: int) -> pa.RecordBatch:
            kinds = [pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()), pa.array([0], pa.int32()), pa.array([2 * part + side], pa.int32()), pa.array([row[2]], pa.binary())]
            return pa.RecordBatch.from_arrays(kinds, names)

        for batch in batches:
            if not len(batch):
                continue
            prefix, run, i = batch.column("prefix").to_pylist(), batch.column("run").to_numpy(), batch.column("i").to_numpy()
            if last is None:
                yield edge((int(run[0]), int(i[0]), prefix[0]), 0)
            else:
                prefix, run, i = [last[2], *prefix], np.append(last[0], run), np.append(last[1], i).astype(np.int32)
            n = common(prefix).astype(np.int32)
            keep = np.flatnonzero(n)
            for at in (keep, keep + 1):
                yield pa.RecordBatch.from_arrays([pa.array(run[at]), pa.array(i[at]), pa.array(n[keep]), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names)
            last = (int(run[-1]), int(i[-1]), prefix[-1])
        if last is not None:
            yield edge(last, 1)

    found = stored(suffixes.mapInArrow(compare, "run long, i int, shared int, part int, prefix binary"), "shared")
    edges = sorted(found.where("part is not null").collect(), key=lambda r: r["part"])  # two rows a task
    more = []
    for a, b in zip(edges, edges[1:], strict=False):
        n = int(common([bytes(a["prefix"]), bytes(b["prefix"])])[0])
        if a["part"] % 2 == 1 and n:
            more += [(a["run"], a["i"], n), (b["run"], b["i"], n)]
    out = found.where("part is null").select("run", "i", "shared")
    return out.union(runs.sparkSession.createDataFrame(more, "run long, i int, shared int")) if more else out


def common(prefix: list[bytes]) -> np.ndarray:
    """How many symbols of eight bytes each prefix has in common with the next, from the front."""
    sizes = np.array([len(p) // 8 for p in prefix])
    data, first = np.frombuffer(b"".join(prefix), "<i8"), np.append(0, np.cumsum(sizes))[:-1]
    most = np.minimum(sizes[:-1], sizes[1:])
    out = np.zeros(len(most), np.int64)
    active = np.flatnonzero(most > 0)
    k = 0
    while len(active):
        equal = data[first[active] + k] == data[first[active + 1] + k]
        active = active[equal]
        out[active] += 1
        k += 1
        active = active[most[active] > k]
    return out


# bytes


class Marked:
    """Texts of a group, all of LENGTH bytes at least, with what the suffix array says about them: proven cover, and windows that may be repeated.

    Places are those of the group. `anchor` is the first phrase start of each window that may be repeated.
    """

    def __init__(self, sub: pa.RecordBatch):
        self.group = g = Group(sub.column("text").to_pylist(), NOT_SPACE)
        places = cuts(g)
        ranges = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) + np.repeat(g.begin - (np.cumsum(n) - n), n))
        text, at = ranges(g.bytes - (K + WINDOW - 2))
        own = places[at]
        new = np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))
        starts, owner = own[new], text[new]
        number = np.zeros(len(g.data), np.int64)  # of the phrase start that a place gives
        number[at] = np.cumsum(new) - 1
        first = np.searchsorted(owner, np.arange(len(g.bytes)))
        last = np.append(first[1:], len(owner)) - 1
        marks = sub.column("marks")
        place, n = (marks.flatten().field(c).to_numpy().astype(np.int64) for c in ("place", "shared"))
        shared = np.zeros(len(starts), np.int64)
        np.maximum.at(shared, first[np.repeat(np.arange(len(sub)), np.diff(marks.offsets.to_numpy()))] + place, n)
        reach = starts[np.minimum(np.arange(len(starts)) + shared, last[owner])] - starts
        # suffixes are in order as far as names reach; beyond that a neighbour may share less than another suffix would
        far = np.where(shared >= 3 ** (ROUNDS + 1), g.bytes[owner], reach)
        proven = np.flatnonzero(reach >= LENGTH)
        self.cover = self.within(starts[proven], starts[proven] + reach[proven])
        text, at = ranges(g.bytes - (LENGTH - 1))
        may = far[number[at]] >= places[at + LAST] - places[at]
        self.text, self.may = text[may], at[may]
        self.anchor = places[self.may]
        so_far = np.append(0, np.cumsum(self.cover))
        self.open = so_far[self.may + LENGTH] - so_far[self.may] < LENGTH

    def within(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place of the group whether it lies in one of the spans."""
        edge = np.zeros(len(self.group.data) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge[:-1]) > 0


_OTHER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def hashes_of(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """127 bits of `size` bytes from each place, as two columns."""
    base = (BASE * BASE + 2) % 2**64 | 1
    other = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OTHER[data] * powers(base, len(data)), out=other[1:])
    back = powers(pow(base, -1, 2**64), len(data))
    return span_hashes(prefix, at, at + size) >> np.uint64(1), mix((other[at + size] - other[at]) * back[at])


#: Windows of one anchor begin up to WINDOW - 1 bytes before it, so all of them hold so many bytes from it on.
CORE = LENGTH - WINDOW + 1
#: Anchors of one core that are compared in one task; the windows of more are dealt out by their own hashes.
TOGETHER = 10_000
ANCHORS = "value long, check long, key long, at long, times long, bytes binary"


def anchors_of(marked: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """Runs of windows that may be repeated and have their anchor in common: its core's hash (value, check), key, at (of the first window), times (copies of the text) and their bytes.

    Without `bits` those of which some window is not proven; else all others whose core passes the filter.
    """
    shared = marked.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                m = Marked(sub)
                copies = sub.column("copies").to_numpy()
                first = np.flatnonzero(np.append(True, (m.anchor[1:] != m.anchor[:-1]) | (m.text[1:] != m.text[:-1]))[: len(m.may)])
                if not len(first):
                    continue
                begin, end = m.may[first], m.may[np.append(first[1:], len(m.may)) - 1] + LENGTH
                text, anchor = m.text[first], m.anchor[first]
                asks = np.add.reduceat(m.open, first, dtype=np.int64) > 0
                asks &= copies[text] == 1  # copies are removed whole, but others may be like them
                value, check = hashes_of(m.group.data, m.group.prefix, anchor, CORE)
                keep = np.flatnonzero(asks if shared.value is None else ~asks & passes(shared.value, value))
                text, begin, end = text[keep], begin[keep], end[keep]
                width = end - begin
                at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin, width)
                own = pa.array(text)
                columns = [pa.array(value[keep].view(np.int64)), pa.array(check[keep].view(np.int64)), sub.column("key").take(own), pa.array(begin - m.group.begin[text]), pa.array(copies[text]), binaries(m.group.data[at], width)]
                yield pa.RecordBatch.from_arrays(columns, ["value", "check", "key", "at", "times", "bytes"])

    return marked.select("key", "text", "marks", "copies").mapInArrow(run, ANCHORS)


class Windows:
    """All windows of some anchors' bytes: whose they are, where they begin there, and their hashes. They are hashed some hundred anchors at a time."""

    def __init__(self, anchors: pa.RecordBatch):
        found = [self.of(anchors.slice(a, 500)) for a in range(0, len(anchors), 500)]
        self.owner = np.concatenate([x[0] + 500 * k for k, x in enumerate(found)])
        self.lead, self.value, self.check = (np.concatenate([x[c] for x in found]) for c in (1, 2, 3))

    @staticmethod
    def of(anchors: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = anchors.column("bytes").to_pylist()
        sizes = np.array([len(x) for x in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = sizes - (LENGTH - 1)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), n)
        lead = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        value, check = hashes_of(data, prefix_hashes(data), lead + (np.cumsum(sizes) - sizes)[owner], LENGTH)
        return owner, lead.astype(np.int32), value, check


def repeated_spans(anchors: pa.RecordBatch) -> pa.RecordBatch:
    """key, begin and end of what windows cover that stand twice among the anchors, all of whose cores' anchors are there."""
    w = Windows(anchors)
    times = anchors.column("times").to_numpy()[w.owner]
    order = np.lexsort((w.check, w.value))
    value, check = w.value[order], w.check[order]
    new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (check[1:] != check[:-1]))[: len(order)])
    n = np.add.reduceat(times[order], new) if len(new) else times
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(n, np.diff(new, append=len(order))) > 1
    edge = np.diff((hit * (w.owner + 1)), prepend=0, append=0) != 0  # hits of one anchor that follow each other are one span
    at = np.flatnonzero(edge)
    at = at[:-1][hit[at[:-1]]], (at[1:] - 1)[hit[at[:-1]]]
    own, start = w.owner[at[0]], anchors.column("at").to_numpy()
    return pa.RecordBatch.from_arrays([anchors.column("key").take(pa.array(own)), pa.array(start[own] + w.lead[at[0]]), pa.array(start[own] + w.lead[at[1]] + LENGTH)], ["key", "begin", "end"])


def compared(anchors: DataFrame) -> DataFrame:
    """key, begin, end of repeated bytes in anchors whose cores have TOGETHER anchors at most: those of one core meet in one task, one core after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not part:
                continue
            part = part[0]
            value = part.column("value").to_numpy()
            # some hundred rows at a time, never cutting a core
            new = np.flatnonzero(value[1:] != value[:-1]) + 1
            edges = new[np.flatnonzero(np.diff(new // 500, prepend=0))].tolist()
            last = int(new[-1]) if len(new) else 0
            for a, b in zip([0, *edges], [*edges, last], strict=True):
                if b > a:
                    yield repeated_spans(part.slice(a, b - a))
            rest = part.slice(last)
        if rest is not None and len(rest):
            yield repeated_spans(rest)

    dealt = anchors.repartition("value").sortWithinPartitions("value")
    return dealt.mapInArrow(run, "key long, begin long, end long")


def looked_up(anchors: DataFrame) -> DataFrame:
    """As compared(), for cores with any number of anchors: each window is a row, counted by its own hash, so no two tasks' work depends on the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                w = Windows(part)
                own = pa.array(w.owner)
                begin = part.column("at").to_numpy()[w.owner] + w.lead
                yield pa.RecordBatch.from_arrays([pa.array(w.value.view(np.int64)), pa.array(w.check.view(np.int64)), part.column("key").take(own), pa.array(begin), part.column("times").take(own)], ["value", "check", "key", "begin", "times"])

    rows = stored(anchors.mapInArrow(run, "value long, check long, key long, begin long, times long"), "windows")
    # stored before the join, so that adaptive execution can split a window that many texts share
    twice = stored(rows.groupBy("value", "check").agg(F.sum("times").alias("n")).where("n > 1").select("value", "check"), "twice")
    return rows.join(twice, ["value", "check"], "left_semi").select("key", "begin", (F.col("begin") + LENGTH).alias("end"))


def passing(anchors: DataFrame, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """Anchors whose core's hash passes the filter, or does not."""
    shared = anchors.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column("value").to_numpy().view(np.uint64)) == wanted))

    return anchors.mapInArrow(run, ANCHORS)


OUT = "key long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(marked: DataFrame, bytes_too: bool) -> DataFrame:
    """The bytes that stay of texts with their marks and the spans (`gone`) that proved repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                m = Marked(sub)
                g, gone = m.group, sub.column("gone")
                text = np.repeat(np.arange(len(sub)), np.diff(gone.offsets.to_numpy()))
                begin, end = (gone.flatten().field(c).to_numpy() + g.begin[text] for c in ("begin", "end"))
                cover = m.cover | m.within(begin, end)
                so_far, rise = np.append(0, np.cumsum(cover)), np.append(0, np.cumsum(np.diff(cover.view(np.int8), prepend=0) == 1))
                stay = g.data[~cover].tobytes()
                n = so_far[g.begin + g.bytes] - so_far[g.begin]
                stop = np.cumsum(g.bytes - n + 1) - 1  # each text is followed by a blank that stays
                kept = [stay[b - k : b] for b, k in zip(stop.tolist(), (g.bytes - n).tolist(), strict=True)]
                hashes = [hashlib.sha256(x).hexdigest() for x in kept]
                columns = [sub.column("key"), pa.array(n), pa.array(rise[g.begin + g.bytes] - rise[g.begin]), pa.array(hashes, pa.string()), pa.array(kept, pa.binary()) if bytes_too else pa.nulls(len(sub), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.select("key", "text", "marks", "gone").mapInArrow(run, OUT)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_too: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay; null where all or none do, and without `bytes_too`) of every text.

    Each byte goes that lies in a string of LENGTH bytes which starts anywhere else as well, in the same text or another.
    Of equal texts one takes part, with their number; the others share its result, which is empty from LENGTH bytes on.
    A null text is empty; texts under LENGTH bytes stay. Rows are told apart by keys that are
    written with them once, so ids may repeat or be null. An empty table gives no rows. What is broadcast are filters of fixed size; as they fill they let
    more through, and lose nothing.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    docs = stored(keyed(docs), "keyed")
    phrases = stored(phrase_table(docs), "phrases")
    # stored before it is joined, so that adaptive execution can split a large group of copies
    alike = stored(phrases.groupBy("sum").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "alike")
    texts = phrases.where(F.col("n_bytes") >= LENGTH).join(alike.select("key", "copies"), "key")
    repeated = phrase_rows(texts).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    runs = runs_of(texts, filter_of(repeated)).withColumn("run", F.monotonically_increasing_id())
    runs = stored(runs, "runs")
    shared = shared_phrases(runs).join(runs.select("run", "key", "first"), "run")
    mark = F.struct((F.col("first") + F.col("i")).alias("place"), "shared")
    marks = shared.select("key", mark.alias("mark")).groupBy("key").agg(F.collect_list("mark").alias("marks"))
    marks = stored(marks.join(texts.select("key", "copies"), "key"), "marks")
    some = of_keys(docs.select("key", "text"), filter_of(marks.select(spread(F.col("key")).alias("value"))))
    marked = stored(some.join(marks, "key"), "marked")
    asking = stored(anchors_of(marked), "anchors")
    anchors = asking.union(stored(anchors_of(marked, filter_of(asking.select("value"))), "anchors"))
    cores = anchors.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times")).where("times > 1")
    anchors, many = passing(anchors, filter_of(cores)), filter_of(cores.where(F.col("n") > TOGETHER))
    spans = compared(passing(anchors, many, False))
    if many.any():
        spans = spans.union(looked_up(passing(anchors, many)))
    gone = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    done = removed(marked.where("copies = 1").join(gone, "key", "left").withColumn("gone", F.coalesce("gone", none)), bytes_too)
    whole = phrases.select("key", "n_bytes", "sum").join(alike.select("sum", "copies"), "sum").select("key", "n_bytes", "copies")
    rows = docs.select("key", "doc_id", F.sha2("text", 256).alias("own")).join(whole, "key").join(done, "key", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.when(~gone & (F.col("n_removed") > 0), F.col("kept")).alias("kept"),
    )


def phrase_rows(texts: DataFrame) -> DataFrame:
    """value: every phrase of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("phrases").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values)], ["value"])

    return texts.select("phrases").mapInArrow(run, "value long")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed from every whole text of documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), bytes_too=False).drop("kept")
