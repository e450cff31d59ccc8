"""Mixture-controlled packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import stored, table, text_of

#: Pieces kept with their ids, so that frequent words are not merged anew: up to so many in a task (about 120 MB), of which
#: those met first, most of them frequent ones, stay when the store is full and for the worker's next task (about 30 MB).
CACHED_WORDS, KEPT_WORDS = 600_000, 150_000
#: Totals of up to so many queues are held by the driver and by every task; the places of more are joined.
MAX_QUEUES = 512
#: Totals of tasks' queues are sent to all tasks up to so many rows (about 5 MB).
MAX_BASES = 100_000
#: Texts are tokenised in groups of about so many characters, and packed in groups of about so many tokens.
GROUP_CHARS, GROUP_TOKENS = 4_000_000, 5_000_000

#: Sentences that tell whether a tokenizer works word by word: white space of all kinds, marks, cases, digits, letters beyond ASCII.
PROBES = (
    "The quick, brown fox. It jumped over the lazy dog, then slept.",
    " THE Quick,fox.It  jumped   over\nthe\tlazy\r\ndog ",
    "don't re-use e.g. 3.14, 1,000 or x_y. (Yes!) [no] a/b \"c\" $5",
    "Ärger über Öl, élan vital. Straße ÇA. \u0130stanbul \u4e2d\u6587 text",
    "",
    " ",
    "a",
    ". , .",
    "mail8 3rd B2B abc.75@D9e isst.%%% (RE$$$) x*y=z; A\u00d7B \u00c0\u00c9\u00df\u00f7\u00e9a 5\u00b5m na\u00cfve't l'\u00c9t\u00e9 \u00bd\u00aaB a\u00a0b caf\u00e9!",
)

#: Kinds of bytes in UTF-8: white space that splits words; letters of Latin-1 (\u00c0 to \u00ff, which are 0xC3 and a second byte, but for
#: the signs of multiplication and division); digits and marks of ASCII but the apostrophe; all others, whose words stay whole.
SPACE, LETTER, MARK, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = MARK
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = LETTER
KINDS[ord("'")], KINDS[[9, 10, 13, 32]] = OTHER, SPACE
#: Bytes of upper case in words of letters and marks; the lower case is 32 above.
UPPER = np.zeros(256, bool)
UPPER[[*range(65, 91), *range(0x80, 0x9F)]] = True


def pieces_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in turn, and how many come before each text's end.

    A word is what stands between white space. Where it has only Latin-1 letters, digits and marks other than the
    apostrophe, its runs of letters, in lower case, and its runs of others are pieces; any other word is one.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8).copy()
    ends = np.cumsum([len(x) + 1 for x in texts])
    kind = KINDS[data]
    sign = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[sign[(data[sign] & 0xDF) == 0x97]] = OTHER
    edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])[: len(kind)])
    own = kind[edge]
    new = np.append(True, own[:-1] == SPACE)[: len(own)]  # the first run of a word
    inside = np.flatnonzero(own != SPACE)
    start, stop, own, new = edge[inside], edge[np.minimum(inside + 1, len(edge) - 1)], own[inside], new[inside]
    word = np.cumsum(new) - 1
    whole = np.zeros(int(word[-1]) + 1 if len(word) else 0, bool)
    whole[word[own == OTHER]] = True
    whole = whole[word]
    upper = np.flatnonzero(UPPER[data])
    data[upper[~whole[np.searchsorted(start, upper, "right") - 1]]] += 32
    kept = np.flatnonzero(new | ~whole)
    start, stop = start[kept], stop[np.append(kept[1:], len(whole))[: len(kept)] - 1]
    return binaries(data[kind != SPACE], stop - start), np.searchsorted(start, ends)


class Words:
    """Ids of whole texts, from a tokenizer that drops white space and never joins across it.

    Such a tokenizer gives the ids of a text as those of its space-separated words in turn. If it also parts letters from
    digits and marks and takes no notice of case, they are those of the pieces of `pieces_of`: within Latin-1 only, where lower case has
    no exceptions, and not in words with an apostrophe, which may belong to the letters behind it. The pieces of a group of texts are numbered by
    Arrow, each different one is looked up once, and only unseen ones are encoded.
    Bare words are encoded many at a time and told apart by the ids that end a word; where the tokenizer's model alone gives
    the ids of bare words (told by the words of its own vocabulary, once a worker), it is asked for these. Texts that hold a special token's
    opening "<|" are encoded whole, as special tokens are found before words are; so are all texts if the tokenizer breaks
    these rules on the sentences of PROBES. A worker process keeps its tokenizer and
    the pieces that it met first: most rarer ones of the next task are new, so they are forgotten at a task's end.
    """

    made: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}  # of pieces, by their bytes
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.kind = "<u2" if len(self.ends) <= 1 << 16 else "<u4"  # what ids are stored as
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_words, self.model_alone, self.shapes = True, False, {}
        probed, said = self.ids(list(PROBES), 0)
        whole = [x + np.array([0], "<u4").tobytes() for x in self.encode(list(PROBES))]
        self.by_words = said == b"".join(whole) and probed.tolist() == [len(x) // 4 for x in whole]
        self.known = {}
        if self.by_words:
            self.model_alone = self.asks_model(vocabulary)

    def asks_model(self, vocabulary: dict[str, int]) -> bool:
        """Whether the model alone gives the ids of bare words: whole words of the vocabulary, two of them in a row for words that are not in it, and letters beyond ASCII among them."""
        if any(x.content.isalpha() for x in self.tokenizer.get_added_tokens_decoder().values()) or self.tokenizer.pre_tokenizer is None:
            return False
        beyond = [c for c in map(chr, range(128, 256)) if c.isalpha() and c.islower()]
        for c in beyond:  # what the model is given for such a letter
            self.shapes[ord(c)] = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
        own = sorted(w for x in vocabulary if (w := x.removesuffix("</w>")).isascii() and w.isalpha() and w.islower())[::7]
        own += [a + b for a, b in zip(own, own[1:], strict=False)]
        own += [a + c + b for c in beyond for a, b in zip(own[::997], own[1::997], strict=False)] + beyond
        return len(own) > len(beyond) and self.by_model(own) == self.encode(own)

    @classmethod
    def at(cls, path: str) -> Words:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def forget(self) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known = dict(islice(self.known.items(), KEPT_WORDS))

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def by_model(self, words: list[str]) -> list[bytes]:
        tokenize, shapes = self.tokenizer.model.tokenize, self.shapes
        ids, ends = [], []
        for word in words:
            ids += [x.id for x in tokenize(word if word.isascii() else word.translate(shapes))]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, unseen: list[bytes]) -> None:
        known, bare, odd = self.known, [], []
        for piece in unseen:
            word = piece.decode()
            (bare if word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0100") else odd).append(word)
        if self.model_alone:
            known.update(zip(map(str.encode, bare), self.by_model(bare), strict=True))
            bare = []
        for at in range(0, len(bare), 1000):
            part = bare[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                known.update((w.encode(), data[4 * a : 4 * b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
            else:
                known.update(zip(map(str.encode, part), self.encode(part), strict=True))
        known.update(zip(map(str.encode, odd), self.encode(odd), strict=True))

    def ids(self, texts: list[str], end: int) -> tuple[np.ndarray, bytes]:
        """How many ids each text has, with `end` behind it; and all of them, four bytes each, end to end."""
        last = np.array([end], "<u4").tobytes()
        if not self.by_words:
            found = [x + last for x in self.encode(texts)]
            return np.array([len(x) // 4 for x in found], np.int64), b"".join(found)
        if len(self.known) > CACHED_WORDS:
            self.forget()
        special = [k for k, x in enumerate(texts) if "<|" in x]
        parts = [x.encode() for x in texts]
        for k in special:
            parts[k] = b""
        pieces, stops = pieces_of(parts)
        numbered = pieces.dictionary_encode()
        different = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([x for x in different if x not in self.known])
        # a text without pieces of its own is given as one, with its end
        closing = np.full(len(texts), len(different))
        closing[special] += np.arange(len(special)) + 1
        values = [*map(self.known.__getitem__, different), last, *(x + last for x in self.encode([texts[k] for k in special]))]
        order = np.insert(numbered.indices.to_numpy(), stops, closing)
        taken = pa.array(values, pa.binary()).take(pa.array(order))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(order) + 1]
        ends = offsets[stops + np.arange(len(texts)) + 1]
        return np.diff(ends, prepend=0).astype(np.int64) // 4, taken.buffers()[2].to_pybytes()[: int(offsets[-1])]


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows are the next counts[k] items of data each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * data.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def tokenize(df: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", queue: Column | None = None) -> DataFrame:
    """doc_id, queue, doc_tokens, ids (two bytes an id, four for vocabularies beyond that), part and ahead: the tokens of the same queue before it in its task."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), (queue if queue is not None else F.lit("")).alias("queue"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, so_far = Words.at(tokenizer), TaskContext.get().partitionId(), {}
        words.forget()  # of a task that did not come to its end
        kind = "<u4" if end >= 1 << 16 else words.kind
        for batch in batches:
            lengths = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
            group = np.cumsum(lengths) // GROUP_CHARS
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(lengths)), strict=True):
                sub = batch.slice(int(a), int(b - a))
                queues, ahead = sub.column("queue").to_pylist(), []
                counts, data = words.ids(sub.column("text").to_pylist(), end)
                for name, n in zip(queues, counts.tolist(), strict=True):
                    ahead.append(so_far.get(name, 0))
                    so_far[name] = ahead[-1] + n
                columns = [
                    sub.column("doc_id"),
                    sub.column("queue"),
                    pa.array(counts),
                    binaries(np.frombuffer(data, "<u4").astype(kind), counts),
                    pa.array([part] * len(counts), pa.int32()),
                    pa.array(ahead, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "doc_tokens", "ids", "part", "ahead"])
        words.forget()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, queue string, doc_tokens long, ids binary, part int, ahead long")


class Schedule:
    """Where each quantum of each queue goes in the one stream of tokens: deficit round-robin in closed form.

    A queue's deficit grows by its share of every token written and falls by what it sends; it sends its next quantum
    when the deficit passes half a quantum. Of a queue of m quanta, quantum c so leaves at time (2c + 1) / 2m of the
    run, ties in the order of the queues. A deficit never exceeds a quantum, whatever windows and partitions the stream
    is cut into, so each window has the target proportions within one quantum of a queue. The place of a quantum is the
    number of tokens that leave before it, which needs the queues' totals only: any task can compute it by itself.
    """

    def __init__(self, totals: dict[str, int], quantum: int):
        self.quantum, self.names = quantum, sorted(totals)
        self.tokens = [totals[x] for x in self.names]
        self.quanta = [-(-n // quantum) for n in self.tokens]
        self.number = {x: i for i, x in enumerate(self.names)}

    def places(self, own: int, quanta: np.ndarray) -> np.ndarray:
        """Tokens that leave before the given quanta (numbers counted from 0) of the queue of that number."""
        c, out = quanta.astype(np.int64) * 2 + 1, 0
        for other, (m, n) in enumerate(zip(self.quanta, self.tokens, strict=True)):
            earlier = times_over(c, m, self.quanta[own], 0 if other < own else 1)
            sent = quanta if other == own else (earlier + 1) // 2
            out = out + np.minimum(sent * self.quantum, n)
        return np.asarray(out, np.int64)


def times_over(c: np.ndarray, m: int, d: int, less: int) -> np.ndarray:
    """(c * m - less) // d for c below 2 * d, exactly: the product may pass 64 bits, no step here does while d is below 2**40."""
    if m * d < 2**61:
        return (c * m - less) // d
    if d >= 2**40:
        return np.array([(int(x) * m - less) // d for x in c], np.int64)
    whole, rest = divmod(m, d)
    upper, lower = c >> 20, c & ((1 << 20) - 1)
    times, left = np.divmod(upper * rest, d)
    return c * whole + (times << 20) + ((left << 20) + lower * rest - less) // d


def token_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about GROUP_TOKENS tokens (doc_tokens) at a time; none is empty."""
    for batch in batches:
        number = np.cumsum(batch.column("doc_tokens").to_numpy()) // GROUP_TOKENS
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(batch)), strict=True):
            yield batch.slice(int(a), int(b - a))


def all_ids(batch: pa.RecordBatch) -> np.ndarray:
    """Ids of the batch's documents end to end, four bytes each, however they are stored."""
    data, n = b"".join(batch.column("ids").to_pylist()), int(batch.column("doc_tokens").to_numpy().sum())
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def pack(docs: DataFrame, schedule: Schedule, window: int) -> DataFrame:
    """Pieces of the tokenised documents (with `start_in_queue`) and the sequences that hold them; ids: four bytes each."""

    def cut(start: np.ndarray, length: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents at `start` of their queues: which one a piece is of, its ends in the queue, its place in the stream."""
        q = schedule.quantum
        first = start // q
        counts = (start + length - 1) // q - first + 1
        doc = np.repeat(np.arange(len(start)), counts)
        quanta = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
        begin, stop, at = np.maximum(quanta * q, start[doc]), np.minimum((quanta + 1) * q, (start + length)[doc]), np.empty(len(doc), np.int64)
        for k in np.unique(queue):
            own = np.flatnonzero(queue[doc] == k)
            at[own] = schedule.places(int(k), quanta[own]) + begin[own] - quanta[own] * q
        room = window - at % window
        over = np.flatnonzero(stop - begin > room)  # a quantum is no longer than a window, so it lies in two at most
        doc, begin, at = np.append(doc, doc[over]), np.append(begin, begin[over] + room[over]), np.append(at, at[over] + room[over])
        stop = np.append(stop, stop[over])
        stop[over] = begin[len(room) :]
        order = np.lexsort((begin, doc))
        doc, begin, stop, at = doc[order], begin[order], stop[order], at[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (stop - begin)[:-1]) | (at[1:] % window == 0))
        piece = np.flatnonzero(new)
        return doc[piece], begin[piece], stop[np.append(piece[1:], len(doc)) - 1], at[piece]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in token_groups(batches):
            start, length = (batch.column(x).to_numpy() for x in ("start_in_queue", "doc_tokens"))
            queue = np.array([schedule.number[x] for x in batch.column("queue").to_pylist()])
            doc, begin, stop, at = cut(start, length, queue)
            # pieces in this order lie end to end in the documents' ids
            ids = all_ids(batch)
            which = pa.array(doc)
            columns = [
                batch.column("doc_id").take(which),
                batch.column("queue").take(which),
                pa.array(begin - start[doc]),
                pa.array(stop - begin),
                binaries(ids, stop - begin),
                batch.column("doc_tokens").take(which),
                pa.array(at // window),
                pa.array(at % window),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "queue", "doc_tokens", "ids", "start_in_queue").mapInArrow(
        run, f"doc_id {kind}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def pack_by_join(docs: DataFrame, quantum: int, window: int) -> DataFrame:
    """As pack(), for any number of queues: docs have `start_in_queue` and their queue's total `_total`.

    Every quantum is one row, made where its first token is, with the time at which it leaves. Rows are sorted by time
    (ties by queue), their tokens added up within tasks and over tasks, and the sums joined to the quanta's pieces.
    """
    stop = F.col("start_in_queue") + F.col("doc_tokens")
    first, last = F.ceil(F.col("start_in_queue") / quantum), F.ceil(stop / quantum) - 1
    begun = docs.where(first <= last).select("queue", "_total", F.explode(F.sequence(first, last)).alias("c"))
    quanta = begun.select("queue", "c", F.least(F.lit(quantum), F.col("_total") - F.col("c") * quantum).alias("n"), ((2 * F.col("c") + 1) / (2 * F.ceil(F.col("_total") / quantum))).alias("time"))
    ranked = stored(quanta.orderBy("time", "queue", "c").withColumn("_m", F.monotonically_increasing_id()), "quanta")
    ranked = ranked.withColumn("_block", F.shiftright("_m", 33))  # the task that it was sorted in
    blocks = ranked.groupBy("_block").agg(F.sum("n").alias("_size"))
    blocks = blocks.select("_block", (F.sum("_size").over(W.orderBy("_block")) - F.col("_size")).alias("_before"))  # a row a task
    within = F.sum("n").over(W.partitionBy("_block").orderBy("_m")) - F.col("n")
    places = ranked.withColumn("_within", within).join(blocks, "_block").select("queue", "c", (F.col("_before") + F.col("_within")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in token_groups(batches):
            start, length = (batch.column(x).to_numpy() for x in ("start_in_queue", "doc_tokens"))
            counts = (start + length - 1) // quantum - start // quantum + 1
            doc = np.repeat(np.arange(len(batch)), counts)
            c = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + (start // quantum)[doc]
            begin, end = np.maximum(c * quantum, start[doc]), np.minimum((c + 1) * quantum, (start + length)[doc])
            which = pa.array(doc)
            columns = [batch.column("doc_id").take(which), batch.column("queue").take(which), pa.array(c), pa.array(begin - c * quantum), pa.array(begin - start[doc]), binaries(all_ids(batch), end - begin), batch.column("doc_tokens").take(which)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "c", "lead", "start", "ids", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    pieces = docs.select("doc_id", "queue", "doc_tokens", "ids", "start_in_queue").mapInArrow(run, f"doc_id {kind}, queue string, c long, lead long, start long, ids binary, doc_tokens long")
    pieces = pieces.join(places, ["queue", "c"]).withColumn("at", F.col("place") + F.col("lead"))
    room, size = F.lit(window) - F.col("at") % window, (F.octet_length("ids") / 4).cast("long")
    part = lambda skip, n: F.struct((F.col("start") + skip).alias("start"), n.alias("length"), F.substring(F.col("ids"), (skip * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"), (F.col("at") + skip).alias("at"))
    two = F.filter(F.array(part(F.lit(0).cast("long"), F.least(size, room)), part(room, size - room)), lambda x: x["length"] > 0)
    cut = pieces.select("doc_id", "queue", "doc_tokens", F.inline(two))
    return cut.select("doc_id", "queue", "start", "length", "ids", "doc_tokens", F.floor(F.col("at") / window).alias("sequence_id"), (F.col("at") % window).alias("offset"))


def pack_documents(
    df: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, quantum: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Pack whole documents, cut where a quantum or a window ends, into sequences of `window` tokens.

    Every window holds the sources in their shares of all tokens, by deficit round-robin with a quantum of `quantum`
    tokens, a window at most (`Schedule`); only the last sequence is not full. A document's ids are those of its text and then `end`, so
    an empty or null text is the one id `end`. A null source is a source of its own. Rows that repeat are packed each
    time. A piece is one row: doc_id, source queue, start, length, ids, doc_tokens, sequence_id, offset.

    Documents are tokenised once, in place, into a table in the shared folder; a queue is read in the order of that
    table's tasks, so texts and ids are not shuffled. The driver holds one total for each of at most MAX_QUEUES
    queues; places in more are found by a sort of all quanta and a join (`pack_by_join`), by the same rule. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    docs = stored(tokenize(df, tokenizer, end, id_col, text_col, name), "tokens")
    parts = docs.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("_n"))
    parts = parts.withColumn("_base", F.sum("_n").over(W.partitionBy("queue").orderBy("part")) - F.col("_n"))
    known = parts.groupBy("queue").agg(F.sum("_n").alias("n")).limit(MAX_QUEUES + 1).collect()
    totals = {r["queue"]: r["n"] for r in known}
    if not totals:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    bases = parts.withColumn("_total", F.sum("_n").over(W.partitionBy("queue"))).drop("_n")
    if parts.count() <= MAX_BASES:  # else joined by a shuffle
        bases = F.broadcast(bases)
    placed = docs.join(bases, ["queue", "part"]).withColumn("start_in_queue", F.col("_base") + F.col("ahead"))
    if len(totals) > MAX_QUEUES:
        return pack_by_join(placed, min(quantum, window), window)
    return pack(placed, Schedule(totals, min(quantum, window)), window)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; one row a piece."""
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")
