"""Quality classifier: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.common import stored, table, text_of
from noteframe.llm.tokens import NOT_SPACE, Group, groups

#: A passage is so many words in a row; the last of a text may be shorter.
PASSAGE = 64
#: Hashed shares of words that a passage's features hold beside its counts.
BUCKETS = 32
#: Hidden sizes of the passage encoder and of its attention.
ENCODED, ATTENTION = 16, 8
GROUP_BYTES = 256_000

#: Character classes counted in passages, by byte.
KINDS = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "symbol": b"#*$%&|<>@^~_=+\\{}[]",
    "mark": b"!?",
    "stop": b".,;:",
    "letter": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "beyond": bytes(range(128, 256)),
}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, one row each, and the number of passages of each text (one of zeros for a text without words)."""
    g = Group(texts, NOT_SPACE)
    counts = np.maximum(1, -(-g.count // PASSAGE))
    out = np.zeros((int(counts.sum()), 10 + len(KINDS) + BUCKETS), np.float32)
    first = np.cumsum(counts) - counts
    if len(g.words):
        passage = first[g.owner] + (np.arange(len(g.words)) - g.first[g.owner]) // PASSAGE
        n = len(out)
        total = lambda x: np.bincount(passage, weights=x, minlength=n)
        words = np.maximum(total(None), 1)
        size = (g.ends - g.starts).astype(float)
        chars = np.maximum(total(size), 1)
        col = 0
        with_letters = None
        for name, members in KINDS.items():
            of_kind = np.zeros(256, np.int64)
            of_kind[np.frombuffer(members, np.uint8)] = 1
            so_far = np.append(0, np.cumsum(of_kind[g.data]))
            per_word = so_far[g.ends] - so_far[g.starts]
            out[:, col] = total(per_word) / chars
            with_letters = per_word if name == "letter" else with_letters
            col += 1
        again = np.append(False, (g.words[1:] == g.words[:-1]) & (passage[1:] == passage[:-1]))
        order = np.lexsort((g.words, passage))
        new = np.append(True, (g.words[order][1:] != g.words[order][:-1]) | (passage[order][1:] != passage[order][:-1]))
        distinct = np.bincount(passage[order][new], minlength=n)
        lines = np.append(0, np.cumsum(g.data == 10))
        gap = lines[np.append(g.starts[1:], len(g.data))] - lines[g.ends]
        mean = chars / words
        for x in (
            mean / 10,
            np.sqrt(np.maximum(total(size * size) / words - mean * mean, 0)) / 10,
            total(again) / words,
            distinct / words,
            total(with_letters == 0) / words,
            total(size == 1) / words,
            total(gap > 0) / words,
            words / PASSAGE,
            np.log1p(g.count)[np.repeat(np.arange(len(texts)), counts)] / 10,
            np.ones(n),
        ):
            out[:, col] = x
            col += 1
        bucket = (g.words >> np.uint64(59)).astype(np.int64)
        out[:, col:] = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / words[:, None]
    return out, counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Scores a bag of passages: encode each, weigh them by gated attention, and judge the weighted sum."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(size: int, prior: float, rng: np.random.Generator) -> Model:
        draw = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        return Model(
            {
                "encode": draw(size, ENCODED), "encode_b": np.zeros(ENCODED), "v": draw(ENCODED, ATTENTION), "u": draw(ENCODED, ATTENTION),
                "w": rng.normal(0, 0.1, ATTENTION), "out": rng.normal(0, 0.1, ENCODED), "out_b": np.array(np.log(prior / (1 - prior))),
                "mean": np.zeros(size), "scale": np.ones(size),
            }
        )

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(counts) - counts
        x = (x - p["mean"]) / p["scale"]
        e = np.tanh(x @ p["encode"] + p["encode_b"])
        t, s = np.tanh(e @ p["v"]), sigmoid(e @ p["u"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a = a / np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(e * a[:, None], first)
        return {"x": x, "e": e, "t": t, "s": s, "a": a, "z": z, "y": sigmoid(z @ p["out"] + p["out_b"])}

    def gradient(self, f: dict[str, np.ndarray], counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(counts) - counts
        d = (f["y"] - label) / len(label)
        dz = np.repeat(d[:, None] * p["out"], counts, axis=0)
        de = dz * f["a"][:, None]
        da = (dz * f["e"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(da * f["a"], first), counts))
        dts = da[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        de = (de + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["e"] ** 2)
        return {
            "encode": f["x"].T @ de, "encode_b": de.sum(0), "v": f["e"].T @ dt, "u": f["e"].T @ ds,
            "w": (f["t"] * f["s"] * da[:, None]).sum(0), "out": f["z"].T @ d, "out_b": d.sum(),
        }


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Model:
    """Adam on the cross entropy of bag labels; the same bags in the same order give the same model."""
    rng = np.random.default_rng(seed)
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model = Model.fresh(10 + len(KINDS) + BUCKETS, prior, rng)
    if not len(labels):
        return model
    # every text counts once, however many passages it has
    mean = np.mean([b.mean(0, dtype=np.float64) for b in bags], axis=0)
    model.p["mean"], model.p["scale"] = mean, np.sqrt(np.mean([((b - mean) ** 2).mean(0) for b in bags], axis=0)) + 0.02
    names = [k for k in model.p if k not in ("mean", "scale")]
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            part = order[at : at + batch]
            counts = np.array([len(bags[i]) for i in part])
            f = model.forward(np.concatenate([bags[i] for i in part]), counts)
            t += 1
            for k, g in model.gradient(f, counts, labels[part]).items():
                g = g + 1e-4 * model.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                step = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                model.p[k] = model.p[k] - step
    return model


def is_held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is 2 modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, passages: int = 200_000) -> Model:
    """Learn from labelled rows that are not held out, at most `sample` of them, those of the smallest hashes of their ids.

    `sample` and `passages` bound what the driver holds: rows are taken whole, in the order of their hashes, each that
    still fits into `passages` passages in all (40 MB), so only a row that would pass this bound is passed over. Labels that are null or
    without a document are not used; without labels every score is one half. Where ids repeat, each row counts; the
    order does not depend on how the tables are split, so neither does the model.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    chosen = chosen.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text")).join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                x, counts = features(sub.column("text").to_pylist())
                bags = [b.tobytes() for b in np.split(x, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([sub.column("turn"), sub.column("label"), pa.array(counts, pa.int64()), pa.array(bags, pa.binary())], ["turn", "label", "passages", "bag"])

    turn = F.struct(F.xxhash64("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = stored(rows.select(turn.alias("turn"), "label", "text").mapInArrow(run, "turn struct<id: long, text: long>, label double, passages long, bag binary"), "bags")
    key = ["turn", "label"]
    alike = found.groupBy(*key, "passages").count().orderBy(*key).limit(sample).collect()  # numbers only; rows that repeat are taken together
    room, taken = passages, []
    for r in alike:
        if r["passages"] * r["count"] <= room:
            room -= r["passages"] * r["count"]
            taken.append((r["turn"], r["label"]))
    chosen = docs.sparkSession.createDataFrame(taken, found.select(*key).schema)
    found = sorted(found.join(F.broadcast(chosen), key).select(*key, "bag").collect(), key=lambda r: (r["turn"], r["label"]))
    width = 10 + len(KINDS) + BUCKETS
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, width) for r in found], np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted; with `keep` all columns of `docs` and these two (columns of those names are replaced).

    Every whole text is scored where it lies; null and empty texts are one passage of zeros and get a score as well.
    """
    rows = docs.drop("score", "predicted") if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    # a kept text goes to the workers once
    once = keep and dict(rows.dtypes)[text_col] == "string"
    if not once:
        rows = rows.withColumn("_bytes", text_of(text_col).cast("binary"))
    if not keep:
        rows = rows.drop(text_col)
    texts = text_col if once else "_bytes"
    shared = docs.sparkSession.sparkContext.broadcast(model.p)
    names = [c for c in rows.columns if c != "_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES, texts):
                x, counts = features([x or b"" for x in sub.column(texts).cast(pa.binary()).to_pylist()])
                y = own.forward(x, counts)["y"]
                yield pa.RecordBatch.from_arrays([*(sub.column(c) for c in names), pa.array(y, pa.float64())], [*names, "score"])

    rows = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, texts])])
    schema = rows.select(*[F.col(f"`{c}`") for c in names]).schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text of documents, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
