"""WARC archives: writing pages as records, and reading them back by verified record boundaries."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import cut, fresh_path, table

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
RECORD_ID = "urn:noteframe:page:"
#: Digests that several pages share are sent to all tasks up to so many (about 10 MB).
MAX_SHARED = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1: eight groups of 20 bits, four letters each."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record a row, as text. Of equal payloads the row with the largest id is the response, others revisit it.

    A null payload is empty. Rows without an id revisit the largest id where one shares their payload, else they are
    responses; rows that repeat the largest id are responses each. Payload digests meet only in counts by digest, which
    are pre-aggregated, so any number of pages may share a payload.
    """
    pages = df.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", "%0A").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    shared = pages.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = cut(shared)
    if shared.count() <= MAX_SHARED:  # else payloads are shuffled to the digests
        shared = F.broadcast(shared)
    both = pages.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first")))
    size = F.octet_length("payload").cast("string")
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), size)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(size)),
    ]
    head = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    return both.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n")).alias("record"))


def write_archives(df: DataFrame, path: str, **columns: str) -> None:
    """Uncompressed archives, one or more a task, by Spark's text writer; a record ends with two line ends."""
    records(df, **columns).write.option("lineSep", "\r\n").option("maxRecordsPerFile", 100_000).text(path)


def parse_head(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """Length of the head with its blank line, and the fields by lower-case name; None if it is no record's head."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return end + 4, fields


CANDIDATE = (
    "file string, block long, kind string, at long, succ long, exit long, type string, record_id string, refers_to string, uri string, declared string,"
    " length long, revisit_length long, sha1 string"
)


def candidates(pieces: DataFrame) -> DataFrame:
    """What each task sees in its blocks of the archives: places that look like records, and where they say they end.

    The reader splits files at the magic, so a row is what follows one magic up to the next. Places count from the
    block's first row, in bytes with the magic of every row (`at`: behind the magic). `succ` is the place behind the
    next record's magic if this record is one; `exit` is the first such place outside the block that the chain from here
    leads to, -1 if the chain breaks inside. A record whose payload holds the magic spans rows; it is hashed over them,
    and `sha1` is null where it goes on in the next block. The row of kind `block` carries the block's length.
    """
    magic = MAGIC.encode()

    def finish(key: tuple, rows: list[dict], length: int) -> list[dict]:
        local = {r["at"]: r for r in rows}
        for r in reversed(rows):
            inside = local.get(r["succ"])
            r["exit"] = r["succ"] if r["succ"] >= length else inside["exit"] if inside else -1
            hasher, left = r.pop("open")
            r["sha1"] = base64.b32encode(hasher.digest()).decode() if left == 0 else None
        return [*rows, {"file": key[0], "block": key[1], "kind": "block", "length": length}]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = [(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in CANDIDATE.split(",")]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, place, going = None, [], 0, []
        for batch in batches:
            values = batch.column("value")
            for k, now in enumerate(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if now != key:
                    if key:
                        yield batch_of(finish(key, rows, place))
                    key, rows, place, going = now, [], 0, []
                piece = values[k].as_buffer().to_pybytes() if values[k].is_valid else b""
                for r in going:  # records that hold the magic in their payload
                    hasher, left = r["open"]
                    part = (magic + piece)[:left]
                    hasher.update(part)
                    r["open"] = hasher, left - len(part)
                going = [r for r in going if r["open"][1]]
                if (place or now[1]) and (head := parse_head(piece)):
                    start, f = head
                    length = int(f["content-length"])
                    part = piece[start : start + length]
                    r = {"file": now[0], "block": now[1], "kind": "record", "at": place, "succ": place + start + length + 4 + len(magic), "type": f["warc-type"]}
                    r |= {"record_id": f.get("warc-record-id"), "refers_to": f.get("warc-refers-to"), "uri": f.get("warc-target-uri"), "declared": f.get("warc-payload-digest")}
                    r |= {"length": length, "revisit_length": int(n) if (n := f.get("x-payload-length", "")).isdigit() else None, "open": (hashlib.sha1(part), length - len(part))}
                    rows.append(r)
                    if length > len(part):
                        going.append(r)
                place += len(piece) + len(magic)
        if key:
            yield batch_of(finish(key, rows, place))

    return pieces.mapInArrow(run, CANDIDATE)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def reachable(found: DataFrame) -> DataFrame:
    """Candidates that the chain from their file's start reaches, with absolute places.

    Tasks have followed chains inside blocks, so pointers lead from block to block. Pointer jumping doubles their reach
    each round: what is reached grows by what the present pointers lead to, and each pointer is replaced by that of its
    target. It ends when a round reaches nothing new, after about log2(blocks of a file) rounds. Only places that some
    pointer leads to take part, a few a block. A block's candidates then pass the mark on from the place where the
    chain enters it; that group is bounded by the block.
    """
    blocks = found.where("kind = 'block'").select("file", "block", "length")
    base = F.sum("length").over(W.partitionBy("file").orderBy("block")) - F.col("length")
    bases = blocks.select("file", "block", base.alias("base"))
    all_rows = found.where("kind = 'record'").join(bases, ["file", "block"])
    placed = cut(all_rows.withColumns({"place": F.col("base") + F.col("at"), "exit": F.when(F.col("exit") >= 0, F.col("base") + F.col("exit"))}))
    starts = blocks.select("file", F.lit(len(MAGIC)).cast("long").alias("place")).distinct()
    entries = placed.where("exit is not null").select("file", F.col("exit").alias("place")).union(starts).distinct()
    jump = cut(placed.join(entries, ["file", "place"], "left_semi").where("exit is not null").select("file", "place", "exit"))
    reached, count = starts, -1
    while (now := reached.count()) != count:
        count = now
        onward = reached.join(jump, ["file", "place"]).select("file", F.col("exit").alias("place"))
        reached = cut(reached.union(onward).distinct())
        target = jump.select("file", F.col("place").alias("exit"), F.col("exit").alias("beyond"))
        jump = cut(jump.join(target, ["file", "exit"]).select("file", "place", F.col("beyond").alias("exit")))
    marked = placed.join(reached.withColumn("enters", F.lit(True)), ["file", "place"], "left").select("file", "block", "at", "succ", "enters")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        on = set(group["at"][group["enters"].eq(True)])
        for at, succ in zip(group["at"], group["succ"], strict=True):
            if at in on:
                on.add(succ)
        return group.loc[group["at"].isin(on), ["file", "block", "at"]]

    true = marked.groupBy("file", "block").applyInPandas(walk, "file string, block long, at long")
    return placed.join(true, ["file", "block", "at"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed archives: record_id, type, uri, refers_to, declared digest, payload_bytes, sha1.

    Only records that the chain of boundaries from the file's start reaches count, so a payload may hold anything, whole
    records included. `sha1` is computed from the payload read (base32), for revisits it is null. Records whose payload
    holds the magic and passes from one block to the next are put together from their rows in a second look at those
    files alone. Files end with a whole record; what follows a broken one is not returned.
    """
    found = cut(candidates(pieces_of(spark, path)))
    true = cut(reachable(found))
    split = true.where("sha1 is null").select("file", "block", "at", "place", "succ", "length", F.col("base").alias("_base"))
    if not split.isEmpty():
        true = whole_payloads(spark, path, found, true, split)
    return true.select(
        "record_id",
        "type",
        "uri",
        "refers_to",
        "declared",
        F.when(F.col("type") == "revisit", F.col("revisit_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(F.col("type") != "revisit", F.col("sha1")).alias("sha1"),
    )


def whole_payloads(spark: SparkSession, path: str, found: DataFrame, true: DataFrame, split: DataFrame) -> DataFrame:
    magic = MAGIC.encode()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place = None, 0
        for batch in batches:
            at = []
            for v, *now in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                key, place = now, place if now == key else 0
                at.append(place)
                place += len(v.as_buffer()) + len(magic)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["value", "file", "block", "at"])

    blocks = found.where("kind = 'block'").select("file", "block", "length")
    bases = blocks.select("file", "block", (F.sum("length").over(W.partitionBy("file").orderBy("block")) - F.col("length")).alias("base"))
    # a scan keeps the order of a block's rows, so places are counted before anything is shuffled
    scanned = pieces_of(spark, path).withColumn("value", F.col("value").cast("binary")).mapInArrow(places, "value binary, file string, block long, at long")
    placed = scanned.join(bases, ["file", "block"]).withColumn("piece_at", F.col("base") + F.col("at")).select("file", "piece_at", "value")
    spans = split.select("file", "place", "length", (F.col("_base") + F.col("succ")).alias("until"))
    parts = placed.join(spans, "file").where((F.col("piece_at") >= F.col("place")) & (F.col("piece_at") < F.col("until")))

    def digest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_at")
        data = magic.join(bytes(x) for x in group["value"])
        start = data.find(b"\r\n\r\n") + 4
        sha1 = base64.b32encode(hashlib.sha1(data[start : start + int(group["length"].iloc[0])]).digest()).decode()
        return pd.DataFrame({"file": [group["file"].iloc[0]], "place": [group["place"].iloc[0]], "late": [sha1]})

    late = parts.groupBy("file", "place").applyInPandas(digest, "file string, place long, late string")
    return true.join(late, ["file", "place"], "left").withColumn("sha1", F.coalesce("sha1", "late")).drop("late")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record in archives in the shared folder, read back by boundary chains."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, f"{RECORD_ID}(-?\\d+)>", 1).try_cast("long")
    return found.select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.coalesce("sha1", F.substring_index("declared", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
        "uri",
    )
