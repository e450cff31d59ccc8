"""The suffix sort and the removal of repeats against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteframe.llm import suffixes

SF = "/root/testdata/sf0.001"


def test_suffix_ranks_are_the_suffix_order(spark):
    rng = random.Random(1)
    strings = {k: [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 7, 30, 31, 32]))] for k in range(40)}
    df = spark.createDataFrame(list(strings.items()), "run long, symbols array<long>")
    for rounds in (0, 1, 2, 3):
        got = {r.run: r.ranks for r in suffixes.suffix_ranks(df, rounds).collect()}
        every = [(got[k][i], k, i) for k, s in strings.items() for i in range(len(s))]
        assert all(len(got[k]) == len(s) for k, s in strings.items())
        depth = 3 ** (rounds + 1)
        ordered = [(strings[k][i:] + [-(4 * k) - 1])[:depth] for _, k, i in sorted(every)]
        assert ordered == sorted(ordered)


def brute(texts):
    places = Counter()
    n = suffixes.LENGTH
    for t in texts:
        places.update(t[i : i + n] for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if places[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))[:n]
    shared = prose(3000)
    out = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 9000").collect()]
    out += [None, "", "x" * 399, "x" * 400, "x" * 400, "y" * 401, "y" * 3000 + shared[:700], "ab" * 900, "ab" * 350 + "c" + "ab" * 300]
    for size in (380, 395, 399, 400, 401, 420, 460, 520, 700, 1500, 3000):  # repeats of all lengths, inside and at the ends of texts
        at = rng.randrange(0, 3000 - size + 1)
        out += [prose(300) + shared[at : at + size] + prose(200), shared[at : at + size] + prose(150), prose(90) + shared[at : at + size]]
    near = list(prose(5000))
    for _ in range(12):  # near copies
        for _ in range(6):
            near[rng.randrange(len(near))] = rng.choice("klm")
        out.append("".join(near))
    twice = prose(900)
    out += [twice + prose(40) + twice, shared, shared, "z" + shared]
    return out


def test_removal_against_brute_force(spark, texts):
    df = spark.createDataFrame([(k if k % 7 else None, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3, F.col("text")).cache()
    rows = df.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([(r.text or "").encode() for r in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect())
    assert got - want == Counter() and want - got == Counter()
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("together", [0, 3])
def test_cores_of_many_anchors_give_the_same(spark, texts, monkeypatch, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: x for k, x in enumerate(brute([(t or "").encode() for t in texts]))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, bytes_too=False).collect()}
    assert got == want


def test_keys_do_not_depend_on_how_a_scan_is_split(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    block = " ".join(str(rng.random()) for _ in range(60))
    rows = [(k, " ".join(str(rng.random()) for _ in range(5 + k)) + (block if k % 3 == 0 else "")) for k in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    read = lambda: sorted(map(tuple, suffixes.remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).drop("kept").collect()))
    name, once = "spark.sql.files.maxPartitionBytes", suffixes.stored
    want, before = read(), spark.conf.get(name)

    def then_split_anew(df, what):
        out = once(df, what)
        spark.conf.set(name, "64k")
        return out

    monkeypatch.setattr(suffixes, "stored", then_split_anew)
    try:
        assert read() == want and sum(r[2] > 0 for r in want) == 8
    finally:
        spark.conf.set(name, before)


def test_passages_planted_in_two_documents_are_marked_from_400_bytes_on(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"{rng.randrange(10**7):07d}" for _ in range(n))
    short, long = say(49) + " 1234567", say(50) + " 12"  # 399 and 402 bytes
    texts = [say(80), f"{say(30)}|{short}|{say(40)}", f"{say(50)}<{short}>{say(20)}", f"{say(30)}|{long}|{say(40)}", f"{say(50)}<{long}>{say(20)}", say(200)]
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bytes_too=False).collect()}
    assert (len(short), len(long)) == (399, 402)
    assert got == {0: 0, 1: 0, 2: 0, 3: 402, 4: 402, 5: 0}
