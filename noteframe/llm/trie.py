"""Prefix trie of conversations by whole-sequence collapse: equal conversations become one weighted sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.common import attached, running, stored, table

#: Fixed values of the contract: a conversation begins with up to HEADS - 1 turns of the one whose id is the next lower multiple of FAMILY.
FAMILY, HEADS = 5, 9
#: Ids of a sequence are joined to texts of at most so many before they meet.
CHUNK_BITS = 10
KEY = ["depth", "lo", "hi"]
#: Keys with more than one in SHARE of the rows of a join are sent to all tasks; there are fewer than SHARE of them.
SHARE = 1000


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), said (digest of role and text), bytes (of the text): turns in the order of turn, null first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat_ws(":", F.length(role), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")], pos=(F.sum, "one")).select("conv_id", "pos", "said", "bytes")


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, depth, said, bytes) and all conversations (conv_id).

    At most heads - 1 turns of a conversation are copied, into the others of its family.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": h})
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("of_base"))
    convs = stored(convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0)))).drop("of_base"), "conversations")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    head = first.join(convs, "base").where("pos <= head").select("conv_id", F.col("pos").alias("depth"), "said", "bytes")
    # the rest moves up where its head is short; a conversation that is most of the table does not meet in one task
    own = attached(turns, convs, ["conv_id"], F.col("n") * SHARE > turns.count(), "inner")
    tail = own.where("pos > h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "said", "bytes")
    return head.union(tail), convs.select("conv_id")


def list_digests(members: DataFrame, by: list[str], of: str) -> DataFrame:
    """by, digest: lowercase SHA-256 hex of a group's numbers as decimal texts, ascending, joined by commas.

    The numbers are sorted by ranges and joined to texts of about a thousand where they lie; a group's texts then pass
    through one hash in order, so no list is ever held whole.
    """
    rows = stored(members.orderBy(*by, of).withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "ends")
    listed = F.transform(F.array_sort(F.collect_list(of)), lambda x: x.cast("string"))
    chunks = rows.groupBy(*by, "_chunk").agg(F.array_join(listed, ",").alias("ids"))
    names = [*by, "digest"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for frame in frames:
            done = []
            for *new, ids in frame[[*by, "ids"]].itertuples(index=False, name=None):
                if new == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = new, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=names)

    schema = members.select(*by).schema.add("digest", "string")
    return chunks.repartition(*by).sortWithinPartitions(*by, "_chunk").mapInPandas(run, schema)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations' prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A sequence's key is the exclusive or of 128 bits for each of its turns and their places, so keys of whole
    conversations are plain aggregates and those of prefixes running ones. Equal conversations are collapsed first:
    only one of each class, with the class's weight, is expanded into prefixes. A sequence whose key is no node's parent
    is a leaf. What lies under a node is the sum of what follows on the sequences through it: each node's weighted bytes,
    less its bytes once, on the smallest sequence that holds it, and one for each leaf at its end.

    Turns that tie in `turn` are ordered by role, then by a digest of their text; repeated rows are turns of their own. Rows
    without conv_id belong to no conversation. Null roles and texts are empty. An empty table has no node, not even a
    root. Other columns are ignored. Remainders of negative ids have their sign.
    """
    turns, convs = rebuilt_turns(ordered_turns(conversations))
    bits = {f"part_{x}": F.xxhash64(F.lit(x), "depth", "said") for x in ("lo", "hi")}
    turns = stored(turns.withColumns(bits), "rebuilt")
    keys = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), *(F.bit_xor(f"part_{x}").alias(x) for x in ("lo", "hi")))
    whole = stored(convs.join(keys, "conv_id", "left").fillna(0, KEY), "whole")
    sequences = stored(whole.groupBy(KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "sequences")

    weights = sequences.select("conv_id", "weight", F.col("depth").alias("turns"))
    steps = attached(turns, weights, ["conv_id"], F.col("turns") * SHARE > turns.count(), "inner").drop("turns", "said")
    paths = running(steps, "conv_id", [F.col("depth")], lo=(F.bit_xor, "part_lo"), hi=(F.bit_xor, "part_hi"))
    paths = paths.select("conv_id", *KEY, *(F.col(x).bitwiseXOR(F.col(f"part_{x}")).alias(f"parent_{x}") for x in ("lo", "hi")), "bytes", "weight")
    zero = F.lit(0).cast("long")
    roots = sequences.select("conv_id", *(zero.alias(c) for c in (*KEY, "parent_lo", "parent_hi", "bytes")), "weight")
    paths = stored(paths.union(roots), "paths")

    seen = stored(paths.groupBy(KEY).agg(F.min("conv_id").alias("owner"), *(F.first(c).alias(c) for c in ("bytes", "parent_lo", "parent_hi"))), "seen")
    children = seen.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_lo").alias("lo"), F.col("parent_hi").alias("hi")).agg(F.count(F.lit(1)).alias("n_children"))
    children = stored(children, "children")
    leaves = sequences.join(children, KEY, "left_anti").select("conv_id", "depth", F.lit(1).cast("long").alias("leaf"))
    owned = seen.select(F.col("owner").alias("conv_id"), "depth", F.col("bytes").alias("own"))
    paths = paths.join(owned, ["conv_id", "depth"], "left").join(leaves, ["conv_id", "depth"], "left").fillna(0, ["own", "leaf"])
    under = running(paths.withColumn("extra", F.col("weight") * F.col("bytes") - F.col("own")), "conv_id", [F.col("depth").desc()], leaves=(F.sum, "leaf"), saved=(F.sum, "extra"))
    nodes = under.groupBy(KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), *(F.first(c).alias(c) for c in ("parent_lo", "parent_hi"))
    )
    ends = list_digests(whole, KEY, "conv_id")
    nodes = nodes.join(children, KEY, "left").join(ends, KEY, "left").fillna(0, ["n_children"])
    nodes = stored(nodes.withColumn("ends_sha256", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))).drop("digest"), "nodes")

    up = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    found = attached(nodes, up, ["depth", "parent_lo", "parent_hi"], F.col("siblings") * SHARE > nodes.count())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))
