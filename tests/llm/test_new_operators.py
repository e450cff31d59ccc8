"""Prefix trie, collocations and language identification against plain Python, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from noteframe.llm import collocations, langid, trie
from noteframe.llm.common import attached, running

SF = "/root/testdata/sf0.001"


def brute_trie(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            said[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in said.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        ends[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for n, who in members.items():
        under = [m for m in members if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * (len(m[-1][1].encode()) if m else 0) for m in under)
        ids = ",".join(map(str, sorted(ends[n])))
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], sum(not children[m] for m in under), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "extra string, conv_id long, turn long, role string, text string, depth long, lo string"


def trie_of(spark, rows, parts=3):
    df = spark.createDataFrame([("x", *r, 7, "clash") for r in rows], CONVERSATIONS).repartition(parts)
    return sorted((tuple(r) for r in trie.trie(df).collect()), key=str)


def test_trie_of_odd_conversations(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"t{t % 3}") for c in range(12) for t in range(c % 7)]
    rows += [(20, None, None, None), (20, None, "user", None), (20, 1, "user", "ü" * 9), (20, 1, "user", "ü" * 9), (20, 1, "user", "a"), (22, 3, "user", "only"), (-7, 0, "user", "neg"), (-5, 0, "user", "neg"), (None, 1, "user", "nobody")]
    rows += [(31, t, "user", "") for t in range(10)] + [(33, 1, "u", "ser:x"), (34, 1, "us", "er:x")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_groups_of_copies_and_a_long_conversation(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 5) for t in range(3)]
    rows += [(c, t, "user", f"same {t}" if t < 2 else rng.choice("ab")) for c in range(3001, 3040) for t in range(4)]
    rows += [(4000, t, "user", f"long {t}") for t in range(700)] + [(4005, t, "user", f"long {t}") for t in range(699)]
    # the nodes of the long one are checked by their numbers, as the plain version is quadratic
    got = trie_of(spark, rows, 5)
    short = [r for r in rows if r[0] < 4000]
    deep = [r for r in got if r[0] == 4000 and r[1] > 0]
    assert len(deep) == 700 and {r[1]: r[3] for r in deep} == {d: 2 if d < 700 else 1 for d in range(1, 701)}
    assert next(r for r in deep if r[1] == 1)[6] == sum(len(f"long {t}") for t in range(699))
    assert [r[1:] for r in got if r[1] > 0 and r[0] < 4000] == [r[1:] for r in brute_trie(short) if r[1] > 0]
    ids = ",".join(str(c) for c in range(0, 3000, 5))
    assert next(r for r in got if r[0] == 0 and r[1] == 3)[7] == hashlib.sha256(ids.encode()).hexdigest()


def test_list_digests_of_many_chunks(spark):
    members = spark.range(30_000).selectExpr("id % 3 * 0 + if(id < 25000, 1, id) as k", "cast(id * 7919 % 30011 as bigint) as v").repartition(7)
    got = {r.k: r.digest for r in trie.list_digests(members, ["k"], "v").collect()}
    want = defaultdict(list)
    for i in range(30_000):
        want[1 if i < 25_000 else i].append(i * 7919 % 30011)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []


def test_running_over_ranges_and_heavy_keys(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, id % 7, 100) as g", "id as k", "id * 31 % 17 as v").repartition(6)
    got = {(r.g, r.k): (r.s, r.x) for r in running(df, "g", [F.col("k")], s=(F.sum, "v"), x=(F.bit_xor, "v")).collect()}
    s, x, want = Counter(), Counter(), {}
    for k in range(5000):
        g, v = (k % 7 if k % 3 == 0 else 100), k * 31 % 17
        s[g] += v
        x[g] ^= v
        want[g, k] = (s[g], x[g])
    assert got == want
    keyed = spark.createDataFrame([(100, 9), (1, 1), (2, 2)], "g long, n long")
    both = attached(df, keyed, ["g"], F.col("n") > 5)
    assert both.count() == 5000 and both.where("n is null").count() == df.where("g not in (100, 1, 2)").count()


def brute_collocations(rows, support, longest, top, covered):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in counts.items() if a >= support and len(k[1]) > 1}
    longer = Counter()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if longer[lang, w] and 100 * longer[lang, w] >= covered * a:
            continue
        score, _, le, r = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), le, r))
    return sorted((lang, n, p.decode(), -a, le, r, total[lang], -s) for lang, v in out.items() for n, (s, a, p, le, r) in enumerate(sorted(v)[:top], 1))


PHRASES = [
    ("en", "the cat sat. The cat sat! the cat; ran the\tcat sat"), ("en", "a a a a a a"), (None, "x Y z, x y z\nx y z\x0bx y"), ("und", "x y Z"), ("en", None), ("en", ""), ("fr", "É é É é. É é"),
    ("en", "new york city new york city new york times"), ("", "the cat the cat the cat"), ("en", "no-break space no-break space tab\ttab\ttab"), ("de", " .,;:!? "), ("l" * 5000 + "\0", "a b a b a b"),
]


@pytest.mark.parametrize("support,longest,top,covered,shards", [(2, 3, 2000, 50, 4), (3, 4, 5, 80, 2), (1, 2, 3, 50, 5), (3, 3, 2000, 100, 1)])
def test_collocations_against_plain_python(spark, support, longest, top, covered, shards):
    rng = random.Random(support)
    rows = PHRASES * 2 + [("en", " ".join(rng.choice(["the", "cat", "sat", "on", "mat."]) for _ in range(rng.randrange(40)))) for _ in range(60)]
    df = spark.createDataFrame([(1, t, lang, "clash", 2) for lang, t in rows], "size int, text string, lang string, phrase string, f int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, support, longest, top, covered, shards).collect())
    assert got and got == brute_collocations(rows, support, longest, top, covered)


def test_every_frequent_phrase_is_locally_frequent(spark):
    """Ten places spread as evenly as they can be over four shards: three of them are in one."""
    docs = spark.createDataFrame([("en", "rare pair" if k < 10 else f"w{k} v{k}") for k in range(400)], "lang string, text string").repartition(8)
    got = collocations.collocations(docs, 10, 3, 2000, 50, 4).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in got] == [("rare pair", 10, 10, 10, 800)]


def test_scores_beyond_64_bits(spark):
    a, le = 3_000_000_000_000, 3_500_000_000_001
    row = spark.createDataFrame([(a, le, le + 7)], "a long, l long, r long").selectExpr("cast(a as decimal(20,0)) as da", "cast(l as decimal(20,0)) as dl", "cast(r as decimal(20,0)) as dr")
    assert row.selectExpr("(cast(1000000 as decimal(38,0)) * da * da) div (dl * dr) as s").first()["s"] == 1_000_000 * a * a // (le * (le + 7))


def test_collocations_of_nothing_and_of_a_long_text(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    text = "one two three. " * 200_000
    got = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    assert [(r.phrase, r.a, r.n, r.score) for r in got] == [("one two three", 200_000, 600_000, 1_000_000)]


LANGS = {"aa": "kala mana tuku wiri poto lahu", "bb": "strung brotz flick gnarp schwell dritt", "cc": "oue eau ille ètre çon ûre"}


def language_rows(n):
    rng = random.Random(8)
    return [(k, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(12, 60))), lang) for k, lang in enumerate(rng.choices(sorted(LANGS), [5, 3, 2], k=n))]


def test_languages_are_told_apart_and_odd_rows_pass(spark):
    rows = language_rows(300)
    odd = [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, LANGS["bb"] * 3, None), (1003, LANGS["bb"] * 20_000, None), (5, LANGS["cc"].upper() * 4, None), (5, LANGS["cc"].upper() * 4, None)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    known = langid.fit(df)
    assert known.names == ("aa", "bb", "cc")
    got = langid.identify(df, known).collect()
    assert len(got) == len(rows) + len(odd)
    said = defaultdict(list)
    for r in got:
        said[r.doc_id].append(r)
    assert all(said[k][0].lang_pred == lang and 0 <= said[k][0].score <= 1 for k, _, lang in rows if k != 5)
    assert all((said[k][0].lang_pred, said[k][0].score, said[k][0].rejected) == ("und", 0.0, True) for k in (1000, 1001, 1002))
    assert said[None][0].lang_pred == said[1003][0].lang_pred == "bb" and not said[1003][0].rejected
    assert sorted(r.lang_pred for r in said[5])[-2:] == ["cc", "cc"]


def test_predictions_do_not_see_held_out_labels_nor_order(spark):
    rows = language_rows(200)
    held = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    schema = "doc_id long, text string, lang string"
    one = langid.fit(spark.createDataFrame(rows, schema).repartition(5))
    other = langid.fit(spark.createDataFrame([(k, t, "wrong" if k in held else lang) for k, t, lang in reversed(rows)], schema))
    assert one == other


def test_sizes_against_one_call_a_block(spark):
    known = langid.Languages(("a", "b"), (b"hello world " * 50, b"bonjour monde " * 50))
    texts = [b"", b"x", b"hello world, hello " * 90, bytes(range(256)) * 5]
    for t, row in zip(texts, known.sizes(texts), strict=True):
        for d, size in zip(known.dictionaries, row, strict=True):
            blocks = max(1, -(-len(t) // 512))
            step = max(1, -(-len(t) // blocks))
            want = 0
            for at in range(0, len(t), step):
                c = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
                out = c.compress(t[at : at + step])
                want += len(out)
            assert abs(int(size) - want) <= 2 * blocks  # frames may differ by a header byte where the dictionary was prepared


def test_narrow_margins_are_rejected_and_no_language_gives_und(spark):
    df = spark.createDataFrame([(1, "zzqq vvyy"), (2, LANGS["bb"] * 9)], "doc_id long, text string")
    known = langid.Languages(("aa", "bb"), tuple(LANGS[x].encode() * 9 for x in ("aa", "bb")))
    got = {r.doc_id: r for r in langid.identify(df, known).collect()}
    assert got[1].rejected and got[1].lang_pred == "aa" and not got[2].rejected and got[2].lang_pred == "bb"
    none = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in langid.identify(df, none).collect()] == [(1, "und", 0.0, True), (2, "und", 0.0, True)]
    alone = langid.Languages(("aa",), (b"kala mana",))
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.identify(df, alone).collect()] == [("aa", 1.0, False)] * 2


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.op13_language_id(spark, sf).where("held_out").join(docs.where(r"text rlike '\\p{L}' and lang is not null"), "doc_id")
    share = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.98
