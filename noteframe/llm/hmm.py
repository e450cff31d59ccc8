"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.common import stored, table, text_of
from noteframe.llm.tokens import groups

#: Latent states, and rounds of Baum-Welch over all training texts.
STATES, ROUNDS = 8, 3
#: Words that are observed as themselves; all others are observed as one of TAILS classes, by their last two bytes.
OWN_CLASS, TAILS = 4095, 256
#: Words whose counts every task holds, about; the counts of all rarer ones are joined.
FREQUENT = 250_000
#: Distinct words that a task gathers before it passes their counts on.
GATHERED = 300_000
GROUP_BYTES = 2_000_000
#: Texts are run through the model together up to so many tokens.
GROUP_TOKENS = 1_000_000
#: The end of a text as a token: no word is empty.
END = b""


def is_held_out(id_col: str) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is 1 modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(docs: DataFrame) -> DataFrame:
    """word, count over all training texts; a task adds up what it meets before the shuffle."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                texts = sub.column("text").to_pylist()
                counts[END] += len(texts)
                for t in texts:
                    counts.update(t.lower().split())
                if len(counts) > GATHERED:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    found = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "word binary, count long")
    return found.groupBy("word").agg(F.sum("count").alias("count"))


def class_of(word: bytes) -> int:
    """The class of a word that is not observed as itself."""
    return OWN_CLASS + (word[-1] * 31 + word[-2 % len(word)] * 7 + min(len(word), 8)) % TAILS if word else OWN_CLASS


@dataclass
class Vocabulary:
    """Frequent words with their counts and classes, and the totals of all words."""

    words: list[bytes]  # most frequent first
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    class_tokens: np.ndarray
    class_words: np.ndarray

    def classes(self) -> list[int]:
        return [k if k < OWN_CLASS else class_of(w) for k, w in enumerate(self.words)]

    def log_class_size(self) -> np.ndarray:
        """log10 of what counts + 0.5 are divided by within each class; a shared class leaves 0.5 for words never seen."""
        shared = np.arange(len(self.class_words)) >= OWN_CLASS
        return np.log10(np.maximum(self.class_tokens + 0.5 * (self.class_words + shared), 0.5))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all words, and the FREQUENT most frequent words; where the last of them share a count, the first by a hash."""
    spread = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count"))
    totals = counts.agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    least, share, upto = 0, 1.0, 0
    for r in spread.toLocalIterator():  # sorted, and left at the FREQUENT'th word: every row stands for a word at least
        if upto + r["n"] > FREQUENT:
            least, share = r["count"], (FREQUENT - upto) / r["n"]
            break
        upto += r["n"]
    edge = (F.col("count") == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = counts.where((F.col("count") > least) | edge).toArrow()
    words, numbers = rows.column("word").to_pylist(), rows.column("count").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-numbers[k], words[k]))
    words, numbers = [words[k] for k in order], numbers[order] if len(order) else np.zeros(0, np.int64)
    own = words[:OWN_CLASS]
    # totals of the shared classes, over all words but those observed as themselves
    tail = F.when(F.length("word") == 0, F.lit(0)).otherwise(
        (_byte("word", 0) * 31 + F.when(F.length("word") > 1, _byte("word", 1)).otherwise(_byte("word", 0)) * 7 + F.least(F.length("word"), F.lit(8))) % TAILS
    )
    tokens, distinct = np.zeros(OWN_CLASS + TAILS), np.zeros(OWN_CLASS + TAILS)
    for r in counts.groupBy((tail + OWN_CLASS).alias("class")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    for k, w in enumerate(own):
        tokens[class_of(w)] -= numbers[k]
        distinct[class_of(w)] -= 1
        tokens[k], distinct[k] = numbers[k], 1
    return Vocabulary(words, numbers, totals["tokens"] or 0, totals["distinct"] or 0, tokens, distinct)


def _byte(column: str, back: int) -> Column:
    """The value of a binary column's byte, counted from its end."""
    return F.conv(F.hex(F.substring(F.col(column), F.length(column) - back, F.lit(1))), 16, 10).cast("int")


def read_tokens(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row a text (`word` is null): doc_id, held_out, n_tokens, classes (two bytes each), known, logs (sum over
    frequent words of log10(count + 0.5)); and one row for each rarer word of it: key, word, times."""
    table_of = {w: (c, n) for w, c, n in zip(vocab.words, vocab.classes(), np.log10(vocab.counts + 0.5).tolist(), strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast(table_of)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, so_far, part = shared.value, 0, TaskContext.get().partitionId() << 36
        names = ["key", "doc_id", "held_out", "n_tokens", "classes", "known", "logs", "word", "times"]
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                classes, n, hits, logs, rare = [], [], [], [], []
                for k, t in enumerate(sub.column("text").to_pylist()):
                    words = t.lower().split()
                    words.append(END)
                    found = [known.get(w) for w in words]
                    missing = [w for w, f in zip(words, found, strict=True) if f is None]
                    classes.append(np.array([f[0] if f is not None else class_of(w) for w, f in zip(words, found, strict=True)], "<u2").tobytes())
                    n.append(len(words))
                    hits.append(len(words) - len(missing))
                    logs.append(sum(f[1] for f in found if f is not None))
                    if missing:
                        rare.append((k, Counter(missing)))
                keys = np.arange(len(sub)) + part + so_far
                so_far += len(sub)
                nothing = lambda m, kind: pa.nulls(m, kind)
                m = len(sub)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), sub.column("doc_id"), sub.column("held_out"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(hits, pa.int64()), pa.array(logs, pa.float64()), nothing(m, pa.binary()), nothing(m, pa.int64())],
                    names,
                )
                if rare:
                    which = np.repeat([k for k, _ in rare], [len(c) for _, c in rare])
                    m = len(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[which]), pa.nulls(m, sub.column("doc_id").type), nothing(m, pa.bool_()), nothing(m, pa.int64()), nothing(m, pa.binary()), nothing(m, pa.int64()), nothing(m, pa.float64()), pa.array([w for _, c in rare for w in c], pa.binary()), pa.array([x for _, c in rare for x in c.values()], pa.int64())],
                        names,
                    )

    schema = f"key long, doc_id {kind}, held_out boolean, n_tokens long, classes binary, known long, logs double, word binary, times long"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # classes x STATES

    @staticmethod
    def fresh(class_tokens: np.ndarray, seed: int = 3) -> Model:
        """Random but the same each time; states differ in which classes they favour."""
        rng = np.random.default_rng(seed)
        emit = (class_tokens[:, None] + 0.5) * rng.gamma(1.0, 1.0, (len(class_tokens), STATES))
        move = rng.gamma(1.0, 1.0, (STATES, STATES)) + np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Texts:
    """Class sequences side by side: longest first, so that at each step the first so many are still going."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0])
        self.going = np.searchsorted(-self.lengths, -np.arange(steps), side="left")
        self.first = np.append(0, np.cumsum(self.going))
        # step-major: tokens of step 0 of all texts, then of step 1, ...
        text = np.repeat(np.arange(len(sequences)), self.lengths)
        step = np.arange(len(text)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.classes = np.empty(len(text), np.int64)
        self.classes[self.first[step] + text] = np.concatenate([sequences[k] for k in self.order])

    def forward(self, m: Model, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 likelihood of each text (in the order given), and with `keep` the scaled forward variables and scales of all tokens."""
        seen = m.emit[self.classes]
        total = np.zeros(len(self.lengths))
        alphas, scales = (np.empty_like(seen), np.empty(len(seen))) if keep else (None, None)
        alpha = np.tile(m.start, (len(self.lengths), 1))
        for t, n in enumerate(self.going.tolist()):
            a, b = self.first[t], self.first[t] + n
            alpha = (alpha[:n] @ m.move if t else alpha[:n]) * seen[a:b]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
            if keep:
                alphas[a:b], scales[a:b] = alpha, scale
        out = np.empty(len(total))
        out[self.order] = total
        return out, alphas, scales

    def expect(self, m: Model) -> tuple[Model, float]:
        """Expected counts of starts, moves and emissions, and the log10 likelihood of all texts."""
        loglik, alphas, scales = self.forward(m, True)
        seen = m.emit[self.classes] / scales[:, None]
        moves = np.zeros((STATES, STATES))
        beta = np.ones((0, STATES))
        gamma = np.empty_like(alphas)
        for t in range(len(self.going) - 1, -1, -1):
            n, a = int(self.going[t]), int(self.first[t])
            later = len(beta)
            now = np.ones((n, STATES))
            if later:
                c = a + n
                ahead = seen[c : c + later] * beta
                now[:later] = ahead @ m.move.T
                moves += alphas[a : a + later].T @ ahead
            gamma[a : a + n] = alphas[a : a + n] * now
            beta = now
        emit = np.stack([np.bincount(self.classes, weights=gamma[:, k], minlength=len(m.emit)) for k in range(STATES)], axis=1)
        return Model(gamma[: len(self.lengths)].sum(0), moves * m.move, emit), float(loglik.sum())


def sequence_groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and class sequences, texts of like length together, about GROUP_TOKENS tokens at a time."""
    all_of = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("classes").to_pylist()]
    order = np.argsort([-len(s) for s in all_of], kind="stable")
    number = np.cumsum([len(all_of[k]) for k in order]) // GROUP_TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(number)) + 1):
        if len(part):
            yield part, [all_of[k] for k in part]


def baum_welch(texts: DataFrame, model: Model) -> Model:
    """One round over all training texts: tasks compute expected counts, Spark adds them up by cell of the model."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = [np.zeros_like(x) for x in (m.start, m.move, m.emit)]
        for batch in batches:
            for _, sequences in sequence_groups(batch):
                got, _ = Texts(sequences).expect(m)
                for x, y in zip(total, (got.start, got.move, got.emit), strict=True):
                    x += y
        flat = np.concatenate([x.ravel() for x in total])
        seen = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(flat[seen])], ["cell", "n"])

    cells = texts.select("classes").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(model.start.size + model.move.size + model.emit.size)
    for r in cells.collect():  # as many as the model has cells
        flat[r["cell"]] = r["n"]
    start, move, emit = np.split(flat, [STATES, STATES + STATES * STATES])
    move, emit = move.reshape(STATES, STATES) + 0.5, emit.reshape(-1, STATES) + 0.01
    return Model((start + 0.5) / (start + 0.5).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def language_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Tokens are the words of the text with A-Z in lower case, and its end. The model's states emit classes: each of the
    OWN_CLASS most frequent words is one, all others share TAILS classes by how they end; a word's probability within
    its class is its smoothed count. So `score`, the log10 probability of the whole text, is exact: the forward
    recursion over its classes plus that of its words within them. base_score is the unigram score.

    All training texts are counted and all are used in every round of Baum-Welch. Tasks hold the counts of at most
    FREQUENT words; rarer words of a text are joined with their counts, and such a word has few rows by its nature.
    Null and empty texts are the end alone. Without training texts every word is unseen. Repeated rows are scored each.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    counts = stored(word_counts(docs), "counts")
    vocab = vocabulary(counts)
    rows = stored(read_tokens(docs, vocab), "tokens")
    texts = rows.where("word is null").select("key", "doc_id", "held_out", "n_tokens", "classes", "known", "logs")
    model = Model.fresh(vocab.class_tokens)
    for _ in range(rounds):
        model = baum_welch(texts.where(~F.col("held_out")), model)
    shared = spark.sparkContext.broadcast((model, vocab.log_class_size()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sizes = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            for part, sequences in sequence_groups(batch):
                within = np.array([sizes[s].sum() for s in sequences])
                out[part] = Texts(sequences).forward(m, False)[0] - within
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "held_out", "n_tokens", "known", "logs")), pa.array(out)], ["key", "doc_id", "held_out", "n_tokens", "known", "logs", "run"])

    scored = texts.mapInArrow(run, f"key long, doc_id {dict(texts.dtypes)['doc_id']}, held_out boolean, n_tokens long, known long, logs double, run double")
    rare = rows.where("word is not null").select("key", "word", "times").join(counts, "word", "left")
    seen = F.coalesce(F.col("count"), F.lit(0))
    rare = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(seen + 0.5)).alias("rare_logs"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    full = scored.join(rare, "key", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    size = F.log10(F.lit(vocab.tokens + 0.5 * (vocab.distinct + 1)))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * size).alias("base_score"),
        (F.col("run") + logs).alias("score"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden-Markov scores of every whole text of documents."""
    return language_scores(table(spark, sf_dir, "documents"))
