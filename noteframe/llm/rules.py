"""Quality rules: repetition inside a text, from its suffix array over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.common import table, text_of

#: Texts are worked on in groups of about so many bytes; a longer text is a group by itself.
GROUP_BYTES = 2_000_000
SYMBOLS = b"#*$%&|<>"


def ranks_by_doubling(codes: np.ndarray, owner: np.ndarray, most: int) -> list[np.ndarray]:
    """Prefix doubling: the k-th array ranks suffixes by their first 2**k words, no further than their own text.

    The first array holds word codes; the last is the one in which every rank is unique, or ranks 2**k >= `most` words.
    A rank is one more than the number of smaller suffixes, so that equal ranks mean equal words. Only suffixes that
    still share their rank are sorted again.
    """
    n = len(codes)
    levels = [codes.astype(np.int64)]
    # a suffix that ends within its text gets a place of its own, so that texts never run into each other
    alone = n + 1 + np.arange(n, dtype=np.int64)
    step = 1
    shared = np.arange(n)
    while len(shared) and step < most:
        now = levels[-1].copy()
        after = shared + step
        inside = after < n
        inside[inside] = owner[after[inside]] == owner[shared[inside]]
        second = np.where(inside, levels[-1][np.minimum(after, n - 1)], alone[shared] + n)
        order = np.lexsort((second, levels[-1][shared]))
        at, a, b = shared[order], levels[-1][shared][order], second[order]
        fresh = np.append(True, a[1:] != a[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        split = np.append(True, (b[1:] != b[:-1])) | fresh
        within = np.maximum.accumulate(np.where(split, np.arange(len(at)), 0)) - start
        now[at] = a + within
        levels.append(now)
        same = ~split
        pair = same | np.append(same[1:], False)
        shared = np.sort(at[pair])
        step *= 2
    return levels


def first_ranks(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Ranks of single words, in which words of different texts differ."""
    order = np.lexsort((codes, owner))
    a, b = owner[order], codes[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    out = np.empty(len(codes), np.int64)
    out[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
    return out


def repeats(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts: the length of the longest string from there that stands elsewhere in its text too, and
    whether the 8 words from there do.

    Suffixes sorted by the last ranks lie beside those they share most with. The longest common prefix of neighbours is
    summed from the ranks, from the coarsest down: where they agree, both move on by that many words. A suffix's
    longest repeat is the larger of the two to its neighbours: the interval of the array that it belongs to.
    """
    n = len(codes)
    levels = ranks_by_doubling(first_ranks(codes, owner), owner, n)
    order = np.argsort(levels[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    go = levels[0][left] == levels[0][right]
    at, left, right = np.flatnonzero(go), left[go], right[go]
    total = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (left < n) & (right < n)
        safe_l, safe_r = np.minimum(left, n - 1), np.minimum(right, n - 1)
        equal = inside & (levels[k][safe_l] == levels[k][safe_r]) & (left != right)
        jump = equal * (1 << k)
        total, left, right = total + jump, left + jump, right + jump
    common[at] = total
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest, longest >= 8


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def judge(texts: list[bytes], min_repeat: int) -> pd.DataFrame:
    """The counts of each text, by the words of all of them together."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    out = pd.DataFrame({"n_words": sizes})
    out["word_chars"] = np.array([len(b"".join(w).decode("utf-8", "replace")) for w in words], np.int64)
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    repeated_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        repeated_lines.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(repeated_lines, np.int64)
    for name in ("n_repeat_words", "covered_words", "longest_repeat"):
        out[name] = np.zeros(len(texts), np.int64)
    if n:
        owner = np.repeat(np.arange(len(texts)), sizes)
        codes = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0]
        longest, eight = repeats(codes, owner)
        by_text = lambda x: np.bincount(owner[x], minlength=len(texts))
        at = np.flatnonzero(eight)
        out["n_repeat_words"] = by_text(covered(at, np.full(len(at), 8), n))
        at = np.flatnonzero(longest >= min_repeat)
        out["covered_words"] = by_text(covered(at, longest[at], n))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        full = sizes > 0
        out.loc[full, "longest_repeat"] = np.maximum.reduceat(longest, first[full])
    return out


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.2, max_repeat: int = 200
) -> DataFrame:
    """Counts of every text and whether it is kept.

    Base counts: n_words (split at ASCII white space), word_chars, n_symbols, n_dup_lines, n_repeat_words (in 8-word
    windows found twice), base_failed. The method adds covered_words, the words in the union of all maximal repeats of
    at least `min_repeat` words, and longest_repeat in words; a text whose base passes is kept if repeats cover no more
    than `max_covered` of it and none is longer than `max_repeat` words. Null and empty texts have no words and fail the
    base. Each text is judged by itself and whole; rows are never moved. Repeated rows give repeated results.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            group = np.cumsum(lengths) // GROUP_BYTES
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(lengths)), strict=True):
                sub = batch.slice(int(a), int(b - a))
                found = judge(sub.column("text").to_pylist(), min_repeat)
                yield pa.RecordBatch.from_arrays([sub.column("doc_id"), *(pa.array(found[x], pa.int64()) for x in names)], ["doc_id", *names])

    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    fine = (F.col("covered_words") <= F.col("n_words") * max_covered) & (F.col("longest_repeat") <= max_repeat)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition and base counts of every whole text of documents."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"
    )
