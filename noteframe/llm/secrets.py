"""Secret scans in DataFrame functions only: known patterns, and runs of high entropy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.llm.common import table, text_of

#: Fixed values of the contract: the kinds in their order, what they match, and which matches count.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """An alphabet whose maximal runs are candidates, and the entropy in bits from which a window of them is flagged."""

    alphabet: str
    bits: float


#: Windows of so many characters slide over every candidate; a candidate is a run of a class of at least that length.
WINDOW = 20
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (CharClass(DIGITS + "abcdef", 3.2), CharClass(DIGITS + LOWER + UPPER + "+/_=-", 3.8))
#: Candidates that match are not secrets: without both a digit and a letter, UUIDs, paths and slugs of words, documented sample keys.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/_-]?(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[/_-]+(?:[A-Za-z]{2,}|[0-9]{1,4}))*[/_=-]*$",
    r"EXAMPLE",
)
#: The same for the JVM: a group that repeats gives nothing back, so it is matched in a loop and a candidate of any length needs no stack.
ALLOWED_JVM = tuple(p.replace("))*[", "))*+[") for p in ALLOWED)


SPANS = "array<struct<start:int,end:int>>"
#: Matches are placed, and windows slide, in parts of so many: a fold's state then stays small, however long the text or the candidate.
PART = 256
#: Texts are cut into chunks of so many characters before pieces are taken from them, as a place in a text is found by counting from its start.
CHUNK = 4096


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once. An expression that stands inside another's lambda is computed anew at every step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_parts(n: Column) -> Column:
    """Numbers of the parts of n items; n is at least 1."""
    return F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int"))


def located(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Places of a pattern's leftmost non-overlapping matches, as array<struct<start, end>> in code points, end exclusive.

    The text split at the matches gives the gaps between them, so places are running sums of lengths, within parts and
    over parts. `keep` is an array of booleans, one a match; without it all matches count.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast(SPANS)
    zipped = F.arrays_zip(F.transform(hits, F.length).alias("hit"), F.slice(F.transform(gaps, F.length), 1, F.size(hits)).alias("gap"), *([keep.alias("keep")] if keep is not None else []))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        spans = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("end"))))
        if keep is not None:
            spans = F.when(x["keep"], spans).otherwise(acc["spans"])
        return F.struct((start + x["hit"]).alias("at"), spans.alias("spans"))

    def placed(all_: Column) -> Column:
        part = lambda k: F.slice(all_, k * PART + 1, PART)
        sums = F.transform(in_parts(F.size(all_)), lambda k: F.aggregate(part(k), F.lit(0), lambda n, x: n + x["hit"] + x["gap"]))
        ahead = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        each = lambda offsets: F.transform(
            in_parts(F.size(all_)), lambda k: F.aggregate(part(k), F.struct(F.get(offsets, k).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
        )
        return F.flatten(bound(ahead, each))

    return bound(zipped, lambda z: F.when(F.size(z) > 0, placed(z)).otherwise(empty))


#: c * log2(c) in millionths for each count in a window, so that entropies are compared as whole numbers.
LOGS = [0, *(round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1))]


def joined(spans: Column, reach: int) -> Column:
    """Spans that overlap (reach 0) or also those that touch (reach 1) become one; starts and ends may each be sorted by themselves.

    The n-th end in order lies before the next start exactly where all n earlier spans have ended.
    """

    def ends(s: Column) -> Column:
        firsts = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["end"] + reach <= x["start"], F.lit(True)))
        lasts = F.filter(s, lambda x, i: F.coalesce(x["end"] + reach <= F.get(s, i + 1)["start"], F.lit(True)))
        return bound(lasts, lambda e: F.transform(firsts, lambda x, i: F.struct(x["start"].alias("start"), F.get(e, i)["end"].alias("end"))))

    return bound(spans, ends)


def high_entropy(candidate: Column, kind: CharClass) -> Column:
    """Spans in a candidate, where windows of WINDOW characters have at least kind.bits of Shannon entropy; joined where they overlap.

    The window slides by one character: one count goes up, one goes down, and the sum of c * log2(c) is corrected by
    the two differences. Entropy is log2(WINDOW) less that sum over WINDOW. Windows are taken PART at a time, so the work
    grows with the candidate's length and not faster.
    """
    most = F.lit(int(1e6 * WINDOW * (math.log2(WINDOW) - kind.bits)))
    logs = F.array(*map(F.lit, LOGS))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(kind.alphabet), c))
    none = F.array().cast(SPANS)

    def slid(chars: Column, ahead: Column) -> Column:
        """Spans of the windows in one part's characters, which begin `ahead` characters into the candidate."""
        zero = F.struct(F.array_repeat(F.lit(0), len(kind.alphabet) + 1).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("at"), none.alias("spans"))

        def step(acc: Column, enters: Column) -> Column:
            leaving = F.when(acc["at"] >= WINDOW, F.get(chars, acc["at"] - WINDOW)).otherwise(F.lit(-1))
            return bound(leaving, lambda leaves: moved(acc, enters, leaves))

        def moved(acc: Column, enters: Column, leaves: Column) -> Column:
            up, down = F.get(acc["counts"], enters), F.get(acc["counts"], leaves)
            # the order is: leave, then enter; a character that leaves and enters changes nothing
            change = (
                F.when(enters == leaves, 0)
                .when(leaves < 0, F.get(logs, up + 1) - F.get(logs, up))
                .otherwise(F.get(logs, up + 1) - F.get(logs, up) + F.get(logs, down - 1) - F.get(logs, down))
            )
            counts = F.when(enters == leaves, acc["counts"]).otherwise(
                F.transform(acc["counts"], lambda c, i: c + F.when(i == enters, 1).when(i == leaves, -1).otherwise(0))
            )
            return bound(acc["sum"] + change, lambda total: flagged(acc, counts, total))

        def flagged(acc: Column, counts: Column, total: Column) -> Column:
            at = acc["at"] + 1
            last = F.try_element_at(acc["spans"], F.lit(-1))
            start, end = ahead + at - WINDOW, ahead + at
            joined = F.when(
                last.isNotNull() & (last["end"] >= start),
                F.concat(F.slice(acc["spans"], 1, F.size(acc["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end")))),
            ).otherwise(F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))))
            spans = F.when((at >= WINDOW) & (total <= most), joined).otherwise(acc["spans"])
            return F.struct(counts.alias("counts"), total.alias("sum"), at.alias("at"), spans.alias("spans"))

        return F.aggregate(chars, zero, step, lambda acc: acc["spans"])

    def every(all_: Column) -> Column:
        part = lambda k: F.slice(all_, k * PART + 1, PART + WINDOW - 1)
        return F.flatten(F.transform(in_parts(F.size(all_) - (WINDOW - 1)), lambda k: bound(part(k), lambda chars: slid(chars, k * PART))))

    return joined(bound(codes, every), 1)


def entropy_spans(text: Column, kind: CharClass) -> Column:
    """Spans of high entropy in all candidates of a class that the allow-list lets through."""
    pattern = "[" + "".join(f"\\{c}" if c in "+/_=-" else c for c in kind.alphabet) + f"]{{{WINDOW},}}"

    def wanted(x: Column) -> Column:
        return ~reduce(or_, (x.rlike(p) for p in ALLOWED_JVM))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    places = located(text, pattern, F.transform(hits, wanted))  # candidates have WINDOW characters at least
    each = F.transform(
        F.arrays_zip(places.alias("place"), F.filter(hits, wanted).alias("hit")),
        lambda p: F.transform(high_entropy(p["hit"], kind), lambda s: F.struct((p["place"]["start"] + s["start"]).alias("start"), (p["place"]["start"] + s["end"]).alias("end"))),
    )
    none = F.array().cast(SPANS)
    return F.when(F.exists(hits, wanted), F.flatten(each)).otherwise(none)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `secrets`: array<struct<start, rank, end, kind>> sorted by start, then kind as in KINDS; code points, end exclusive.

    Kinds assign, access and hex are the base patterns, entropy is what the sliding windows flag beyond them, per class
    of characters; runs of both classes may overlap and are each reported once. Every row is judged by itself in one
    pass, so nothing is shuffled and no source or group of copies matters. Null and empty texts have no secrets;
    repeated rows are scanned each; other columns pass through (a column named `secrets` is replaced).
    """
    text = text_of(text_col)
    groups = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    staged = df.withColumns(
        {
            "_assign": F.when(F.size(groups) > 0, located(text, ASSIGN, F.transform(groups, lambda g: F.length(g) >= 12))).otherwise(F.array().cast(SPANS)),
            "_access": located(text, ACCESS),
            "_hex": located(text, HEX),
            "_entropy": F.array_distinct(F.concat(*(entropy_spans(text, k) for k in CLASSES))),
        }
    )

    def tagged(rank: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return staged.withColumn("secrets", F.array_sort(F.concat(*(tagged(r, k) for r, k in enumerate(KINDS))))).drop(*(f"_{k}" for k in KINDS))


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every found span (overlapping ones together) by `mask`; expects `secrets` from scan() and drops it."""
    text = text_of(text_col)

    def masked(chunks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """Characters a to b of the text; only its first and last chunk are cut."""
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            head, tail = F.substring(F.get(chunks, first), a - first * CHUNK + 1, F.least(b - a, F.lit(CHUNK))), F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), b - last * CHUNK)
            between = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            return F.when(a >= b, "").when(first == last, head).otherwise(F.concat(head, between, tail))

        def pieces(spans: Column) -> Column:
            before = F.transform(spans, lambda s, i: piece(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]))
            return F.concat(F.array_join(before, mask), F.lit(mask), piece(F.element_at(spans, -1)["end"], F.length(text)))

        order = lambda c: F.array_sort(F.transform("secrets", lambda s: s[c]))
        spans = F.zip_with(order("start"), order("end"), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
        return bound(joined(spans, 0), pieces)

    clean = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), masked)
    return df.withColumn(text_col, F.when(F.size("secrets") > 0, clean).otherwise(F.col(text_col))).drop("secrets")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents: base counts and digest, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(F.filter("secrets", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
