"""Null and repeated ids, long texts, many sources, and what bounds must not change."""

import itertools
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noteframe.llm import classifier, decontaminate, hmm, near, packing, secrets, sharding, warc
from noteframe.llm.common import fresh_path, table

SF = "/root/testdata/sf0.001"
RANDOM = string.ascii_letters + string.digits + "+/"


def words(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())


# secrets


def entropy_spans(text):
    found = set()
    for kind in secrets.CLASSES:
        most = int(1e6 * secrets.WINDOW * (math.log2(secrets.WINDOW) - kind.bits))
        for m in re.finditer("[" + re.escape(kind.alphabet) + "]{%d,}" % secrets.WINDOW, text):
            if any(re.search(p, m[0]) for p in secrets.ALLOWED):
                continue
            spans = []
            for i in range(len(m[0]) - secrets.WINDOW + 1):
                window = m[0][i : i + secrets.WINDOW]
                if sum(secrets.LOGS[window.count(c)] for c in set(window)) <= most:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + secrets.WINDOW
                    else:
                        spans.append([i, i + secrets.WINDOW])
            found |= {(m.start() + a, m.start() + b) for a, b in spans}
    return sorted(found)


def test_windows_at_the_edges_of_parts(spark):
    rng = random.Random(1)
    texts = []
    for n in (20, 21, 255, 256, 257, 275, 276, 277, 530, 1500):
        texts.append("é " + "".join(rng.choice(RANDOM) for _ in range(n)) + " y " + "".join(rng.choice("0123456789abcdef") for _ in range(n)))
        texts.append("".join(rng.choice(RANDOM) if k // 37 % 2 else rng.choice("a1") for k in range(n)))
    texts.append(" ".join(f"deadbeef{rng.getrandbits(64):016x}" for _ in range(600)))  # more matches than a part holds
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        assert sorted((x.start, x.end) for x in r.secrets if x.kind == "entropy") == entropy_spans(texts[r.doc_id]), r.doc_id
        assert sorted(x.start for x in r.secrets if x.kind == "hex") == [m.start() for m in re.finditer("[0-9a-f]{16,}", texts[r.doc_id])]


def test_time_in_proportion_to_a_candidate(spark):
    text = "".join(random.Random(2).choice(RANDOM) for _ in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    (row,) = secrets.scan(df).collect()
    assert time.perf_counter() - start < 60
    assert sorted((x.start, x.end) for x in row.secrets if x.kind == "entropy") == entropy_spans(text)


# decontamination


def brute_contaminated(docs, items):
    """Pairs with some 16 words (all of a shorter item) of which four fifths lie on the document's."""
    found = set()
    for (i, text), (k, item) in itertools.product(docs, items):
        a, b = words(text), words(item)
        n = min(16, len(b))
        if n < decontaminate.LEAST:
            continue
        for shift in range(-len(b) + n, len(a) - n + 1):
            low, high = max(0, -shift), min(len(b), len(a) - shift)
            equal = [a[p + shift] == b[p] for p in range(low, high)]
            if any(sum(equal[p : p + n]) >= 0.8 * n for p in range(len(equal) - n + 1)):
                found.add((i, k))
                break
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 12, 16, 17, 24, 40])))) for k in range(12)]
    docs = []
    for n in range(150):
        text = rng.choices(vocabulary, k=rng.randrange(0, 50))
        own = rng.choice(items)[1].split()
        begin = rng.randrange(0, max(1, len(own) - 15))
        part = [w if rng.random() > rng.choice([0, 0.1, 0.2, 0.3]) else "other" for w in own[begin:]]
        docs.append((n, " ".join(text[:20] + part + text[20:])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and len(want) > 50


@pytest.mark.parametrize("sent", [0, 500_000])
def test_decontamination_without_and_with_repeated_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "MAX_SENT", sent)
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, item), (1, item), (1, "clean text of the same id"), (None, "clean text without an id"), (2, f"before {item} after")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got) == [(False, 1, 9), (False, 2, 9), (True, 0, 9)]


@pytest.mark.parametrize("sent", [20_000, 500_000])
def test_a_phrase_of_many_items_and_many_documents(spark, monkeypatch, sent):
    """All items and all documents share one phrase; only the item that a document holds is found, in one block of items or in many."""
    monkeypatch.setattr(decontaminate, "MAX_SENT", sent)
    phrase = "what is the value of the"
    items = [(k, f"{phrase} " + " ".join(f"i{k}x{j}" for j in range(12))) for k in range(1500)]
    docs = [(k, f"before {phrase} day " + (items[k][1] if k % 3 == 0 else "and so on") + f" {phrase}") for k in range(1500)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(0, 1500, 3)]
    assert {(r.shift, r.matched, r.compared, r.best) for r in found} == {(8, 18, 18, 16)}


def test_overlays_in_small_parts_against_brute_force(monkeypatch):
    """Every item's best overlay, whatever the sizes of the parts that are compared together."""
    rng = np.random.default_rng(11)
    items = [rng.integers(1, 9, n).astype(np.uint64) for n in (3, 5, 16, 17, 40)]
    made = [(decontaminate.combined(t, decontaminate.salted(m)[1], decontaminate.salted(m)[0]), k) for k, t in enumerate(items) for m in decontaminate.masks_of(min(16, len(t)), 0.8)]
    hashes, at, item = (np.concatenate(x) for x in zip(*[(h, a, np.full(len(a), k)) for (a, h), k in made], strict=True))
    order, count = np.argsort(hashes, kind="stable"), np.array([len(t) for t in items])
    block = decontaminate.Block(None, np.concatenate(items), np.cumsum(count) - count, count, hashes[order], item[order], at[order])
    masks = sorted({m for t in items for m in decontaminate.masks_of(min(16, len(t)), 0.8)})
    for n in (0, 2, 3, 30, 300):
        doc, want = rng.integers(1, 9, n).astype(np.uint64), {}
        doc = np.concatenate([doc, items[4][5:33], doc])
        for k, t in enumerate(items):
            size = min(16, len(t))
            for shift in range(-len(t) + size, len(doc) - size + 1):
                low, high = max(0, -shift), min(len(t), len(doc) - shift)
                equal = [int(doc[p + shift] == t[p]) for p in range(low, high)]
                best = max(sum(equal[p : p + size]) for p in range(len(equal) - size + 1)) if len(equal) >= size else 0
                if best >= 0.8 * size:
                    want[k] = max(want.get(k, (-1,)), (sum(equal), best, -shift, high - low))
        for together in (1, 7, 100_000):
            monkeypatch.setattr(decontaminate, "OVERLAYS", together)
            monkeypatch.setattr(decontaminate, "CELLS", together)
            got = {int(r[0]): tuple(int(x) for x in r[1:]) for r in block.search(doc, masks, 16, 0.8).T}
            assert got == want and 4 in got


def test_items_of_one_and_two_words_where_they_are_asked_for(spark):
    items = spark.createDataFrame([("one", "alone"), ("two", "short item"), (None, "no id at all"), ("none", " ")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "A short item."), (2, "short, no item"), (3, "ALONE"), (4, "with no id at all"), (5, None), (6, "")], "doc_id int, text string")
    for least, more in ((3, set()), (2, {(1, "two")}), (1, {(1, "two"), (3, "one")})):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, least=least).collect()}
        assert got == {(4, None)} | more


# the pipeline


def test_stages_without_and_with_repeated_ids(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    copied, other, alone, twice = say(60), say(60), say(60), say(60)
    texts = [(0, copied), (1, other), (1, copied), (None, alone), (None, copied), (None, f"{say(9)} {item} {say(9)}"), (2, twice), (2, twice), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stay = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in stay.collect()) == Counter([(0, copied), (1, other), (None, alone), (None, texts[5][1]), (2, twice), (None, None)])
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for k, x in enumerate(texts) if k != 5)
    scanned = corpus_pipeline.secret_scan(spark, docs, SF)
    assert scanned.count() == len(texts)
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in pieces) == len(texts)


# packing


def test_many_sources_keep_their_own_queues(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(0, 900))), f"s{k % 11}" if k % 7 else "hot") for k in range(160)]
    rows.append((None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("queue", packing.F.lit("clash"))
    window, quantum = 512, 64
    path = public_tokenizers.path("word_bpe_49k.json")
    joined = packing.pack_documents(df, path, window, quantum=quantum).collect()
    monkeypatch.setattr(packing, "MAX_QUEUES", 512)
    whole = packing.pack_documents(df, path, window, quantum=quantum).collect()
    for pieces in (joined, whole):
        ids = defaultdict(dict)
        for r in pieces:
            assert r.length * 4 == len(r.ids) and r.offset + r.length <= window
            ids[r.doc_id][r.start] = bytes(r.ids)
        texts = {k: b"".join(v for _, v in sorted(x.items())) for k, x in ids.items()}
        assert all(sum(len(y) // 4 for y in ids[r.doc_id].values()) == r.doc_tokens for r in pieces)
        filled = Counter()
        for r in pieces:
            filled[r.sequence_id] += r.length
        assert sorted(filled) == list(range(len(filled))) and all(filled[k] == window for k in range(len(filled) - 1))
        pieces_of = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
        assert all(a[:2] != b[:2] and (a[0] != b[0] or a[1] + a[2] == b[1]) for a, b in itertools.pairwise(pieces_of))
        if pieces is joined:
            want = texts
            shares = Counter()
            for r in pieces:
                shares[r.queue] += r.length
            total = sum(shares.values())
            for k in range(len(filled) - 1):  # every window has the mixture, within one quantum of each queue at either end
                own = Counter()
                for r in pieces:
                    if r.sequence_id == k:
                        own[r.queue] += r.length
                assert all(abs(own[q] - window * n / total) <= 2 * quantum for q, n in shares.items())
        else:
            assert texts == want


def test_ids_beyond_two_bytes_are_kept(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "some words", "s")], "doc_id long, text string, source string")
    (piece,) = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), end=70_000).collect()
    assert np.frombuffer(piece.ids, "<u4")[-1] == 70_000


# language model, classifier, shards, archives


@pytest.mark.parametrize("frequent", [0, 1, 5, 40])
def test_bounds_of_frequent_words_change_no_count(spark, monkeypatch, frequent):
    rows = [(k, " ".join(f"a{j}" for j in range(k % 9)) + " tie1 tie2") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in hmm.language_scores(df).collect()}
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in hmm.language_scores(df).collect()} == want


def slow_score(model, text):
    """The classifier in plain Python from the features of each passage alone."""
    found = text.split() if text else []
    passages = [found[k : k + classifier.PASSAGE] for k in range(0, len(found), classifier.PASSAGE)] or [[]]
    x, counts = classifier.features([(text or "").encode()])
    assert counts.tolist() == [len(passages)] and len(x) == len(passages)
    for row, part in zip(x, passages, strict=True):
        chars = "".join(part).encode()
        for col, members in enumerate(classifier.KINDS.values()):
            assert abs(row[col] - (sum(b in members for b in chars) / max(1, len(chars)) if part else 0)) < 1e-5
    p, encoded, weights = model.p, [], []
    for row in x:
        z = (row - p["mean"]) / p["scale"]
        e = [math.tanh(sum(z[i] * p["encode"][i][j] for i in range(len(z))) + p["encode_b"][j]) for j in range(classifier.ENCODED)]
        gate = lambda name, e=e: [sum(e[i] * p[name][i][j] for i in range(len(e))) for j in range(classifier.ATTENTION)]
        weights.append(sum(math.tanh(v) / (1 + math.exp(-u)) * w for v, u, w in zip(gate("v"), gate("u"), p["w"], strict=True)))
        encoded.append(e)
    share = [math.exp(w - max(weights)) for w in weights]
    total = sum(share)
    bag = [sum(s / total * e[j] for s, e in zip(share, encoded, strict=True)) for j in range(classifier.ENCODED)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(bag, p["out"], strict=True)) - float(p["out_b"])))


def test_classifier_against_plain_python(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = classifier.fit(docs, labels)
    again = classifier.fit(docs.repartition(7, "lang"), labels.repartition(3))
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    got = {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    for r in docs.where("n_chars < 3000").limit(60).collect():
        assert abs(got[r.doc_id] - slow_score(model, r.text)) < 1e-6
    few = classifier.fit(docs, labels, passages=100)
    assert not np.array_equal(few.p["encode"], model.p["encode"]) and np.isfinite(few.p["encode"]).all()


def test_long_texts_are_learnt_from_and_only_the_bound_on_passages_leaves_rows_out(spark, monkeypatch):
    seen = []
    learn = classifier.train
    monkeypatch.setattr(classifier, "train", lambda bags, y: seen.append((sorted(len(b) for b in bags), sorted(y))) or learn(bags, y))
    rows = [(k, "word " * 64 * n) for k, n in ((1, 1), (3, 3000), (4, 2), (5, 150), (6, 1), (6, 1), (9, 40))]
    used = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 3, 4, 5, 6, 9, 77)], "doc_id long, quality int")
    sizes = [len(t.split()) // 64 for k, t in rows if k in used]
    classifier.fit(docs, labels)
    assert seen.pop() == (sorted(sizes), sorted(float(k % 2) for k in used)) and 3000 in sizes
    classifier.fit(docs, labels, passages=200)
    assert sum(seen[-1][0]) <= 200 and 3000 not in seen[-1][0] and seen.pop()[0].count(1) >= sizes.count(1) - 1
    classifier.fit(docs, labels, passages=0)
    assert seen.pop() == ([], [])


def test_rows_without_ids_are_shuffled_and_clashing_columns_pass(spark):
    rows = [(None, f"t{k}", "s", -1, -1) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot int")
    out = sharding.interleave(df, 7)
    assert len({r._key for r in df.withColumn("_key", sharding.seeded(sharding.F.concat(sharding.F.lit("null"), sharding.F.xxhash64(*df.columns).cast("string")), 7)).collect()}) == 300
    sizes = Counter(r.shard for r in out.collect())
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    pages = spark.createDataFrame([(k, "u", f"<p>{k % 2}</p>", "x") for k in range(6)], "page_id long, url string, html string, record_type string")
    assert warc is not None and pages.count() == 6 and fresh_path(spark, "x")


def test_recall_of_near_copies_in_a_large_group(spark):
    """Copies of one text with a few words replaced: all pairs at 0.8 and more are in one class, by the plain measure."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(120))) for k in range(300)]
    for k in range(300, 900):
        own = list(base)
        for place in rng.sample(range(200), rng.randrange(0, 4)):
            own[place] = f"x{k}y{place}"
        rows.append((k, " ".join(own)))
    cls = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert Counter(cls.values()).most_common(1)[0] == (300, 600) and sum(cls[k] == k for k in range(300)) == 300


def test_places_beyond_64_bits():
    """Totals of 100 TB of text: the two steps give what whole numbers of any size give."""
    rng = random.Random(4)
    for top in (10**6, 2**31, 2**35, 2**39, 2**41):
        for _ in range(20):
            m, d, less = rng.randrange(1, top), rng.randrange(1, top), rng.randrange(2)
            c = np.array([1, 2 * d - 1, *(2 * rng.randrange(d) + 1 for _ in range(50))], np.int64)
            assert packing.times_over(c, m, d, less).tolist() == [(int(x) * m - less) // d for x in c]
    schedule = packing.Schedule({"a": 10**13 + 7, "b": 3 * 10**13, "c": 5}, 256)
    quanta = np.array([0, 1, 10**9, schedule.quanta[0] - 1])
    at = schedule.places(0, quanta)
    assert at.dtype == np.int64 and (np.diff(at) > 0).all() and abs(at[-1] - 4 * 10**13) < 2048


def test_tokenizers_that_join_across_words_encode_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.Words(path).by_words
    joined = Tokenizer.from_file(path)
    joined.normalizer = normalizers.Replace(", ", " comma ")  # a rule that looks across white space
    joined.save(str(tmp_path / "joined.json"))
    store, texts = packing.Words(str(tmp_path / "joined.json")), ["One, two.", "", "three, Four five"]
    assert not store.by_words
    counts, data = store.ids(texts, 2)
    expected = [[*joined.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert counts.tolist() == [len(x) for x in expected] and np.frombuffer(data, "<u4").tolist() == [i for x in expected for i in x]


def test_packing_words_kept_or_forgotten_give_the_same_ids(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHED_WORDS", 6)
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    store = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    groups = [["The quick, brown fox.", "", "a1 don't $$$ Ärger"], ["fox the QUICK brown, jumped", "<|x|> over\nlines\t\r."], ["quick quick, over a1 the Brown fox."] * 2]
    for texts in groups * 2:
        counts, data = store.ids(texts, 2)
        expected = [[*store.tokenizer.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert counts.tolist() == [len(x) for x in expected]
        assert np.frombuffer(data, "<u4").tolist() == [i for x in expected for i in x]
        store.forget()
        assert len(store.known) <= 3


def test_shingles_beyond_those_that_tasks_hold_keep_their_frequencies(spark, monkeypatch):
    rng = random.Random(8)
    common = [[f"c{k}w{i}" for i in range(30)] for k in range(6)]
    rows = []
    for k in range(240):  # frequent parts of different frequencies, and copies with a few words of them or of their own edited
        base = common[k % 2] + common[2 + k % 4] + [f"r{k // 4}x{i}" for i in range(30)]
        for _ in range(k % 4 * 2):
            base[rng.randrange(len(base))] = f"e{rng.random()}"
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = lambda: sorted((r.doc_id, r.class_id) for r in near.near_duplicates(docs).collect())
    keyed = docs.select("doc_id", F.md5("text").alias("digest"), F.col("text").cast("binary").alias("text"))

    def signs():
        found = near.document_frequencies(keyed)
        shared = spark.sparkContext.broadcast(near.idf_of(found))
        return {r.doc_id: r.signature for r in near.signed(near.with_frequencies(keyed, found), shared).collect()}, found

    classes, (held, found) = seen(), signs()
    monkeypatch.setattr(near, "MAX_FREQUENT", 60)
    joined, fewer = signs()
    assert found.more is None and len(fewer.hashes) <= 60 and fewer.more.count() + len(fewer.hashes) == len(found.hashes)
    assert joined == held and seen() == classes


def test_kept_texts_are_scored_as_they_are(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "some words here, 12", "c"), (4, "\u00e4 \u4e2d x " * 50, None)]
    docs, model = spark.createDataFrame(rows, "doc_id long, text string, lang string"), classifier.Model.fresh(10 + len(classifier.KINDS) + classifier.BUCKETS, 0.4, np.random.default_rng(1))
    bare = {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    kept = classifier.score(docs, model, keep=True).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in kept) == rows and {r.doc_id: r.score for r in kept} == bare


def test_bare_words_by_the_model_are_those_of_the_tokenizer(tmp_path):
    import public_tokenizers

    store = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    words = ["the", "quickest", "zzyzxq", "antidisestablishmentarianism", "a" * 300, "\u00e4rger", "The", "Fox,", "don't", "x"]
    counts, data = store.ids([" ".join(words), "zzyzxq. THE quickest"], 2)
    whole = [x + np.array([2], "<u4").tobytes() for x in store.encode([" ".join(words), "zzyzxq. THE quickest"])]
    assert store.model_alone and data == b"".join(whole) and counts.tolist() == [len(x) // 4 for x in whole]


def test_pieces_of_words_have_the_ids_of_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, stops = packing.pieces_of([x.encode() for x in ["The FOX,isst.%%% 3rd", "", "don't L'ÉTÉ ÉTÉ! A×B Ωb.c"]])
    assert [x.decode() for x in pieces.to_pylist()] == ["the", "fox", ",", "isst", ".%%%", "3", "rd", "don't", "L'ÉTÉ", "été", "!", "A×B", "Ωb.c"]
    assert stops.tolist() == [7, 7, 13]
    store, rng = packing.Words(path), random.Random(6)
    letters = "aAbZsStTlLvVrReEéÉßÀ×÷ÿªº½²'’,.;:!?$%&_-<>|0123456789  \n\t\r\x0b\x1c\x85\xa0́İıŁΣσД中😀​\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 15))) for _ in range(4000)]
    for at in range(0, len(texts), 1000):
        counts, data = store.ids(texts[at : at + 1000], 2)
        whole = [x + np.array([2], "<u4").tobytes() for x in store.encode(texts[at : at + 1000])]
        assert data == b"".join(whole) and counts.tolist() == [len(x) // 4 for x in whole]
    assert store.by_words and store.model_alone
    # words of the same letters in either case, with marks behind them, are one piece to the store
    store.known = {}
    store.ids(["fox Fox FOX, fox. fox$$$ (fox)"], 2)
    assert sorted(store.known) == [b"$$$", b"(", b")", b",", b".", b"fox"]
    # a tokenizer that joins digits to letters is given whole texts
    joined = Tokenizer.from_file(path)
    joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.BertPreTokenizer(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    joined.save(str(tmp_path / "joined.json"))
    store = packing.Words(str(tmp_path / "joined.json"))
    assert not store.by_words and store.ids(["abc123 x"], 2)[1] == store.encode(["abc123 x"])[0] + np.array([2], "<u4").tobytes()
