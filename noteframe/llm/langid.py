"""Language identification by compression: zstandard with a raw-content dictionary of each language, the smallest wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import table, text_of
from noteframe.llm.tokens import groups

UNKNOWN = "und"
LEVEL = 6
#: Texts are encoded in blocks of at most so many bytes, each by itself, so the dictionary is what a block is told by and not the text before it.
BLOCK = 512
GROUP_BYTES = 1_000_000


def is_held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is 1 modulo 3 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, the language with the most documents first: it wins where sizes are the same."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Encoded bytes of each text in each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, d in enumerate(self.dictionaries):
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(LEVEL)
            encode = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            for i, t in enumerate(texts):
                blocks = max(1, -(-len(t) // BLOCK))
                step = max(1, -(-len(t) // blocks))
                out[i, k] = sum(len(encode(t[at : at + step])) for at in range(0, len(t), step))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = 256, texts: int = 400, piece: int = 400) -> Languages:
    """Dictionaries from labelled rows that are not held out: at most `texts` pieces of `piece` characters a language.

    Pieces come from distinct texts, those with the smallest hashes, and begin at a place that follows from the hash, so
    neither copies nor the order of rows matter. The three parameters bound what the driver holds and the tasks get
    (42 million characters at most; the `languages` with the most documents are learnt). Rows without a language or a letter are not learnt from.
    """
    text = F.lower(text_of(text_col))
    rows = docs.where(F.col(lang_col).isNotNull() & ~is_held_out(id_col) & text_of(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    if not known:
        return Languages((), ())
    # about eight times as many texts as are taken, by their hashes; all of a language that has few
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 8 * texts / r["d"])) for r in known], "lang string, share double")
    near = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) <= F.col("share") * (1 << 20))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - piece + 1)).cast("int") + 1
    pieces = near.select("lang", "h", F.substring("text", start, F.lit(piece)).alias("piece")).dropDuplicates(["lang", "h"])
    order = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h")  # some thousands of rows a language
    chosen = pieces.withColumn("k", F.row_number().over(order)).where(F.col("k") <= texts)
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in chosen.collect():  # languages * texts pieces at most
        found.setdefault(r["lang"], []).append((r["k"], r["piece"].encode()))
    names = tuple(r["lang"] for r in known)
    return Languages(names, tuple(b"\n".join(p for _, p in sorted(found[n])) for n in names))


def identify(docs: DataFrame, known: Languages, id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.02) -> DataFrame:
    """id, lang_pred, score, rejected: the language whose dictionary encodes the whole text (in lower case) in the fewest bytes.

    The score is the best language's share where each byte more halves a language's weight. A margin of under `narrow` of
    the best size is rejected: `rejected` is true, lang_pred still names the best. Null texts and those without a letter are `und`
    with a score of 0, rejected; so are all texts if no language is known. Ties go to the language with more
    documents. Rows are judged by themselves, where they lie: ids may repeat or be null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_of(text_col)).cast("binary").alias("text"), text_of(text_col).rlike(r"\p{L}").alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["doc_id", "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        langs = np.array([*known.names, UNKNOWN], object)
        for batch in batches:
            for sub in groups(batch, GROUP_BYTES):
                judged = sub.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(known.names)
                best, score, rejected = np.full(len(sub), len(known.names)), np.zeros(len(sub)), np.ones(len(sub), bool)
                if judged.any():
                    sizes = known.sizes(sub.column("text").filter(pa.array(judged)).to_pylist())
                    least = sizes.min(1)
                    best[judged] = sizes.argmin(1)
                    score[judged] = 1 / np.exp2(np.maximum(-60.0, least[:, None] - sizes)).sum(1)
                    second = np.partition(sizes, 1, axis=1)[:, 1] if sizes.shape[1] > 1 else 2 * least
                    rejected[judged] = second - least < narrow * least
                yield pa.RecordBatch.from_arrays([sub.column("doc_id"), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)], names)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
