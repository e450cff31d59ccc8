"""Benchmark decontamination by spaced seeds: masks over words that ignore some positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.common import digest_of, stored, table, text_of
from noteframe.llm.tokens import LETTERS, Group, combined, groups

#: Fixed masks: words at ones are hashed, words at zeros are ignored. Wherever up to three of 16 words are substituted,
#: one of these masks lies on 16 words without looking at any of them (a test enumerates that).
MASKS = ("111111", "1111011", "10110000000111")
#: Items of fewer words are not looked for, unless `least` says so: a test of the repository holds that an item of two words is not found.
LEAST = 3
#: Test hashes are sent to all tasks in blocks of about so many (some 10 MB); documents meet the blocks one after the other.
MAX_SENT = 500_000
#: The filter of test hashes has two bitmaps of so many bits, whatever the size of the tables: 4 MB are broadcast.
FILTER_BITS = 24
GROUP_BYTES = 256_000
#: Overlays of a text are gathered up to about so many, and compared up to about so many words at a time.
OVERLAYS, CELLS = 200_000, 500_000


def masks_of(size: int, identity: float) -> tuple[str, ...]:
    """Masks of which one lies on `size` words without looking at the substituted ones, as long as `identity` of the words are equal.

    Of n words with k substituted, (n - k) / (k + 1) in a row, rounded up, are left somewhere: a mask of so many ones.
    """
    wrong = max(k for k in range(size) if size - k >= identity * size or k == 0)
    if size == 16 and wrong <= 3:
        return MASKS
    return ("1" * -(-(size - wrong) // (wrong + 1)),)


def salted(mask: str) -> tuple[int, list[int]]:
    """A number for the mask's hashes, and the places of its ones."""
    return int(mask, 2), [i for i, c in enumerate(mask) if c == "1"]


def seeds(df: DataFrame, window: int, identity: float, least: int, most: int) -> DataFrame:
    """Of items (item_id, text as binary): a row for each masked hash (block, item, mask, hash, at) and one for the item's words (block, item, item_id, words).

    `item` is the task and place of a row in this scan, whose result is stored: ids may be null or repeat. A task deals its
    items into blocks of `most` hashes, or one item more than that.
    """
    masks: dict[str, np.ndarray] = {}  # for each mask, for which numbers of words it is taken
    for size in range(max(1, min(least, window)), window + 1):
        for mask in masks_of(size, identity):
            masks.setdefault(mask, np.zeros(window + 1, bool))[size] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, items, made = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                g = Group(sub.column("text").to_pylist(), LETTERS)
                size, found = np.minimum(g.count, window), []
                for mask, sizes in masks.items():
                    salt, offsets = salted(mask)
                    at, hashes = g.combined(offsets, salt)
                    taken = sizes[size[g.owner[at]]]
                    found.append((at[taken], hashes[taken], [mask] * int(taken.sum())))
                at, hashes = (np.concatenate(x) for x in list(zip(*found, strict=True))[:2])
                own = g.owner[at]
                n, item = np.bincount(own, minlength=len(sub)), task + items + np.arange(len(sub))
                block = task + (made + np.cumsum(n) - n) // most
                items, made = items + len(sub), made + len(at)
                mask = pa.array([m for x in found for m in x[2]], pa.string())
                columns = [pa.array(block[own]), pa.array(item[own]), pa.nulls(len(at), sub.column("item_id").type), mask, pa.array(hashes.view(np.int64)), pa.array(at - g.first[own]), pa.nulls(len(at), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                words = [w.tobytes() for w in np.split(g.words, g.first[1:])]
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(item), sub.column("item_id"), pa.nulls(len(words), pa.string()), none, none, pa.array(words, pa.binary())], names)

    names = ["block", "item", "item_id", "mask", "hash", "at", "words"]
    return df.mapInArrow(run, f"block long, item long, item_id {dict(df.dtypes)['item_id']}, mask string, hash long, at long, words binary")


def bitmaps(hashes: DataFrame) -> np.ndarray:
    """Two bitmaps that have a bit for each hash, from its lower and its upper bits; built by Spark in blocks of 4 KB."""
    low = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    high = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = hashes.select(F.explode(F.array(low, high + F.lit(1 << FILTER_BITS))).alias("bit"))
    blocks = bits.groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((2 << FILTER_BITS) // 8, np.uint8)
    for r in blocks.collect():  # 1024 blocks at most
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidates(docs: DataFrame, bits: np.ndarray, masks: list[str]) -> DataFrame:
    """Of documents (doc_id, digest, text as binary) with a hash that passes the filter: row, doc_id, digest, words.

    `row` is the task and place of a row in this scan, whose result is stored: ids may be null or repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.split(shared.value, 2)
        so_far = TaskContext.get().partitionId() << 32
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                g = Group(sub.column("text").to_pylist(), LETTERS)
                rows, hit = np.arange(len(sub)) + so_far, np.zeros(len(sub), bool)
                so_far += len(sub)
                for mask in masks:
                    salt, offsets = salted(mask)
                    at, hashes = g.combined(offsets, salt)
                    for part, shift, keep in ((low, 0, (1 << FILTER_BITS) - 1), (high, 64 - FILTER_BITS, -1)):
                        bit = hashes & np.uint64(keep) if keep > 0 else hashes >> np.uint64(shift)
                        passes = (part[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at, hashes = at[passes], hashes[passes]
                    hit[g.owner[at]] = True
                which = np.flatnonzero(hit)
                if len(which):
                    words = [g.words[g.first[k] : g.first[k] + g.count[k]].tobytes() for k in which]
                    own = [sub.column(c).take(pa.array(which)) for c in ("doc_id", "digest")]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[which]), *own, pa.array(words, pa.binary())], ["row", "doc_id", "digest", "words"])

    return docs.mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, digest string, words binary")


@dataclass(frozen=True)
class Block:
    """Some test items: their ids, their words end to end, and their masked hashes in order, with item and place of each."""

    ids: pa.ChunkedArray
    words: np.ndarray
    first: np.ndarray
    count: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, made: DataFrame, low: int, high: int) -> Block:
        """Of the rows of seeds() whose block lies from `low` to `high`, some MAX_SENT of them."""
        rows = made.where(F.col("block").between(low, high))
        items = rows.where("words is not null").select("item", "item_id", "words").toArrow().sort_by("item")
        found = rows.where("hash is not null").select("item", "hash", "at").toArrow()
        texts = [np.frombuffer(w, "<u8") for w in items.column("words").to_pylist()]
        count = np.array([len(t) for t in texts], np.int64)
        item, hashes, at = (found.column(c).to_numpy() for c in ("item", "hash", "at"))
        hashes = hashes.view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        item = np.searchsorted(items.column("item").to_numpy(), item)
        return cls(items.column("item_id"), np.concatenate(texts), np.cumsum(count) - count, count, hashes[order], item[order], at[order])

    def overlays(self, doc: np.ndarray, masks: list[str], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct items and shifts that some masked hash lays over a text, some OVERLAYS of them at a time (another time again, now and then).

        In a run of equal hashes (text that repeats one word) only `window` places at both ends are looked at: at those
        between them `window` words line up with the same words.
        """
        held, n = [], 0
        for mask in masks:
            salt, offsets = salted(mask)
            at, hashes = combined(doc, offsets, salt)
            low, high = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            at, hashes, low, high = at[hit], hashes[hit], low[hit], high[hit]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1] + 1))
            starts, run, place = np.flatnonzero(new), np.cumsum(new) - 1, np.arange(len(at))
            keep = (place - starts[run] < window) | (np.append(starts[1:], len(at))[run] - place <= window)
            at, low, counts = at[keep], low[keep], (high - low)[keep]
            for part in parts(counts, OVERLAYS):
                c = counts[part]
                seed = np.repeat(low[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                held.append(np.unique((self.item[seed] << 33) + (np.repeat(at[part], c) - self.at[seed] + (1 << 32))))
                n += len(held[-1])
                if n > OVERLAYS:
                    keys, held, n = np.unique(np.concatenate(held)), [], 0
                    yield keys >> 33, (keys & ((1 << 33) - 1)) - (1 << 32)
        if held:
            keys = np.unique(np.concatenate(held))
            yield keys >> 33, (keys & ((1 << 33) - 1)) - (1 << 32)

    def compared(self, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, window: int, identity: float) -> np.ndarray:
        """Items laid over a text: item, matching words, best window's matches, -shift, words compared; without those that fall short."""
        begin, size = np.maximum(0, -shift), np.minimum(window, self.count[item])
        length = np.minimum(self.count[item], len(doc) - shift) - begin
        fits = np.flatnonzero(length >= size)
        out = [np.zeros((5, 0), np.int64)]
        for part in parts(length[fits], CELLS):
            k = fits[part]
            n, first = length[k], np.cumsum(length[k]) - length[k]
            place = np.arange(n.sum()) - np.repeat(first, n)
            equal = doc[np.repeat(begin[k] + shift[k], n) + place] == self.words[np.repeat(self.first[item[k]] + begin[k], n) + place]
            so_far = np.append(0, np.cumsum(equal))
            start = np.flatnonzero(place <= np.repeat(n - size[k], n))  # of each window
            windows = n - size[k] + 1
            best = np.maximum.reduceat(so_far[start + np.repeat(size[k], windows)] - so_far[start], np.cumsum(windows) - windows)
            good = best >= identity * size[k]
            out.append(np.stack([item[k], so_far[first + n] - so_far[first], best, -shift[k], n])[:, good])
        return np.concatenate(out, axis=1)

    def search(self, doc: np.ndarray, masks: list[str], window: int, identity: float) -> np.ndarray:
        """Items that a text holds, as compared() gives them, each where it matches best."""
        best = np.zeros((5, 0), np.int64)
        for item, shift in self.overlays(doc, masks, window):
            found = np.concatenate([best, self.compared(doc, item, shift, window, identity)], axis=1)
            found = found[:, np.lexsort(found[[3, 2, 1, 0]])]
            best = found[:, np.append(found[0, 1:] != found[0, :-1], True)[: found.shape[1]]]
        return best


def parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours of about `most` in all; one that is larger is alone or the last of a slice."""
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
    yield from (slice(a, b) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=False))


def held_items(docs: DataFrame, block: Block, masks: list[str], window: int, identity: float, schema: str) -> DataFrame:
    """Of candidates() and a block of items: row, doc_id, digest, item_id, shift, matched, compared, best; written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = ["row", "doc_id", "digest", "item_id", "shift", "matched", "compared", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES, "words"):
                found = [block.search(np.frombuffer(w, "<u8"), masks, window, identity) for w in sub.column("words").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [f.shape[1] for f in found]))
                item, matched, best, near, n = np.concatenate(found, axis=1)
                ids = [sub.column(c).take(row) for c in names[:3]]
                item_id = block.ids.take(pa.array(item)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*ids, item_id, *(pa.array(x) for x in (-near, matched, n, best))], names)

    out = stored(docs.mapInArrow(run, schema), "held")
    shared.destroy()
    return out


def blocks(made: DataFrame) -> Iterator[tuple[int, int]]:
    """Neighbouring blocks of seeds() taken together, from the first to the last number, as long as they have at most MAX_SENT hashes."""
    low = high = None
    total = 0
    # one row for MAX_SENT hashes, and one a task
    for r in made.groupBy("block").agg(F.count("hash").alias("n")).where("n > 0").orderBy("block").collect():
        if low is not None and total + r["n"] > MAX_SENT:
            yield low, high
            low = None
        if low is None:
            low, total = r["block"], 0
        high, total = r["block"], total + r["n"]
    if low is not None:
        yield low, high


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 16, identity: float = 0.8, least: int = LEAST
) -> DataFrame:
    """Pairs of a document and a test item that it holds: doc_id, digest (md5 of its text), item_id, shift, matched, compared, best.

    Words are runs of letters and digits, without regard to case. A masked hash that stands in both lays the item over
    the document; the pair counts if some `window` words of the item (all, if it has fewer) lie on the document with
    at least `identity` of them equal, so words may be substituted, also at the ignored places. Of several shifts of a
    pair the one with most matches is returned. The masks of an item are such that every overlay that counts has such a
    hash (see masks_of). Items of fewer than `least` words are not looked for. Null and empty texts
    hold nothing; each row is searched by itself, also if its id is null or repeats; an empty table on either side gives
    no rows. Words are compared by hashes of 64 bits.

    Documents are read once. Their hashes meet a filter of fixed size first, and only what passes (true hits, and false
    ones as the filter fills) is written, with its words. The items come to these rows in blocks of a fixed size, each
    sent to all tasks, and a row is searched and verified where it lies: a phrase that many items and many documents
    share is met in every task by itself, and no pair moves before it is verified. A larger benchmark fills
    the filter and makes more blocks, but loses nothing.
    """
    spark = docs.sparkSession
    item_rows = items.select(F.col(item_col).alias("item_id"), F.lower(text_of(item_text_col)).cast("binary").alias("text"))
    made = stored(seeds(item_rows, window, identity, least, max(1, MAX_SENT)), "seeds")
    plain = docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"), F.lower(text_of(text_col)).cast("binary").alias("text"))
    masks = sorted(r["mask"] for r in made.where("mask is not null").select("mask").distinct().collect())  # at most window + 2
    found = stored(candidates(plain, bitmaps(made.where("hash is not null")), masks), "candidates")
    schema = f"row long, doc_id {dict(plain.dtypes)['doc_id']}, digest string, item_id {dict(item_rows.dtypes)['item_id']}, shift long, matched long, compared long, best long"
    held = [held_items(found, Block.of(made, low, high), masks, window, identity, schema) for low, high in blocks(made)]
    pairs = reduce(DataFrame.unionAll, held) if held else spark.createDataFrame([], schema)
    best = F.max(F.struct("matched", "best", (-F.col("shift")).alias("near"), "compared")).alias("m")
    out = pairs.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), best)
    return out.select("doc_id", "digest", "item_id", (-F.col("m.near")).alias("shift"), "m.matched", "m.compared", "m.best")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the overlap in words."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")
