"""The training-data pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm import classifier, decontaminate, near, packing, secrets
from noteframe.llm.common import digest_of, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that cross to Python at once: batches are held several times outside the heap, by the JVM and by its workers.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """A smaller setting stays; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def same_row() -> Column:
    """Joins a document with decisions (_id, _digest): ids may be null or repeat, so the text's digest counts too."""
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (digest_of("text") == F.col("_digest"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the given documents that are not held out."""
    small_batches(spark)
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.score(docs, model, keep=True).where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id (any with an id before one without)."""
    small_batches(spark)
    kept = near.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.join(kept, same_row())
    # rows of one id and one text are copies of each other: one of them stays, where there are any
    again = docs.groupBy("doc_id", digest_of("text")).count().where("count > 1").isEmpty()
    return (rows if again else rows.dropDuplicates(["doc_id", "_digest"])).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    small_batches(spark)
    pairs = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    bad = pairs.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    return docs.join(bad, same_row(), "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mask; the documents stay."""
    clean = secrets.redact(secrets.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens with the mixture of sources in each: one row a piece of a document."""
    small_batches(spark)
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: No stage but the scan can be told in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
