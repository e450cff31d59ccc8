"""Secret scans of very long candidates and texts of many secrets; redaction and the pipeline's stage against plain Python; clashing columns."""

import itertools
import re
import time

import corpus_pipeline
import pytest

from noteframe.llm import packing, secrets, warc
from noteframe.llm.common import fresh_path, table
from tests.llm.test_small_operators import ODD, SF, brute_base, brute_entropy


def plain_redaction(text, mask="[SECRET]"):
    out, at = [], 0
    for a, _, b, _ in sorted(brute_base(text) + brute_entropy(text)):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


LONG = [
    "ab/" * 1500 + "a1", "ab/" * 4000, "a_b-" * 3000, "ab/cd-" * 2000 + "x9", "aGVsbG8/d29y_bGQ9" * 300, "12/" * 2000 + "abc==", "/ab" * 1000 + "1234-", "ab--/12" * 900 + "12345",
    " ".join(f"key{k} AKIA{'Q7' * 10} password='abcdefghi{k:06d}' deadbeefdeadbeef{k}" for k in range(300)),
]


def test_long_candidates_against_brute_force(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(LONG)], "doc_id int, text string")
    for r in secrets.scan(df).collect():
        assert [tuple(x) for x in r.secrets] == sorted(brute_base(r.text) + brute_entropy(r.text)), r.doc_id
    for r in secrets.redact(secrets.scan(df)).collect():
        assert r.text == plain_redaction(LONG[r.doc_id]), r.doc_id


@pytest.mark.parametrize("text,found", [("ab/" * 333_333 + "a1", 0), ("a_b-" * 250_000, 0), ("ab/cd-" * 170_000, 0), ("".join(f"k AKIA{'Q7' * 10} password='abcdefghi{k:06d}' " for k in range(18_000)), 36_000)])
def test_a_million_characters_in_one_row(spark, text, found):
    start = time.time()
    r = secrets.redact(secrets.scan(spark.createDataFrame([(text,)], "text string")).selectExpr("text", "secrets", "size(secrets) as n")).first()
    assert r.n == found and (r.text == text) == (found == 0) and r.text.count("[SECRET]") == found
    assert time.time() - start < 120


def test_both_allow_lists_mean_the_same(spark):
    parts = ["ab", "1", "a", "12345", "/", "-", "--", "=", "+"]
    rows = ["".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n)]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    for plain, jvm in zip(secrets.ALLOWED, secrets.ALLOWED_JVM, strict=True):
        got = {r.c for r in df.where(df.c.rlike(jvm)).collect()}
        assert got == {r for r in rows if re.search(plain, r)}


def test_the_pipelines_secret_stage_against_plain_python(spark):
    odd = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark, SF, "documents").select(corpus_pipeline.COLUMNS).union(odd)
    rows = corpus_pipeline.secret_scan(spark, docs, SF).collect()
    want = sorted(((r.doc_id, plain_redaction(r.text) if r.text is not None else None) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)


def test_clashing_columns_of_archives_and_packing(spark):
    import public_tokenizers

    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k % 2}</p>", "x", 1, "y") for k in range(6)], "page_id long, url string, html string, record_type string, payload_bytes int, file string")
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path)
    got = {r.uri: r.type for r in warc.read_archives(spark, path).collect()}
    assert got == {f"u{k}": "response" if k > 3 else "revisit" for k in range(6)}
    docs = spark.createDataFrame([(k, f"text {k}", "s", 1, 2, "z") for k in range(6)], "doc_id long, text string, source string, start int, length int, queue string")
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in pieces} == set(range(6)) and all(r.start == 0 and r.length == r.doc_tokens for r in pieces)
