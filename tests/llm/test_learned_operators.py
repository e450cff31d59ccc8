"""Classifier, decontamination, language model, near-duplicates and the pipeline against brute force or held-out rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from noteframe.llm import classifier, decontaminate, graph, hmm, near
from noteframe.llm import queries as llm
from noteframe.llm.common import stored, table
from noteframe.llm.tokens import LETTERS, Group

SF = "/root/testdata/sf0.001"
ODD = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "!!!"), (900_005, "!!!"), (900_006, "word"), (900_007, "word"), (900_008, "a " * 20_000), (None, "no id at all here"), (900_009, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "de", "s", 0, 0.5, "kept", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, key int")


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source")).cache()


def words(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def test_every_operator_is_registered():
    assert [sum(x.startswith(f"op{n}_") for x in llm.queries()) for n in range(1, 11)] == [1] * 10
    assert set(llm.oracle_sql()) <= set(llm.queries())


def test_classifier_on_held_out_rows(spark, odd):
    folder = "/root/testdata/sf0.01"
    got = classifier.op4_quality(spark, folder).join(table(spark, folder, "labels"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    labels = spark.createDataFrame([(900_006, 1), (None, 0), (900_007, None), (5, 0)], "doc_id long, quality int")
    model = classifier.fit(odd, labels)
    scored = classifier.score(odd, model, keep=True)
    assert scored.count() == len(ODD) and set(scored.columns) == set(odd.columns)
    assert classifier.score(odd.limit(0), classifier.fit(odd.limit(0), labels.limit(0))).count() == 0


def test_attention_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    model = classifier.Model.fresh(7, 0.4, rng)
    x, counts, label = rng.normal(size=(9, 7)), np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(label * np.log(y := model.forward(x, counts)["y"]) + (1 - label) * np.log(1 - y))
    grads = model.gradient(model.forward(x, counts), counts, label)
    for name, g in grads.items():
        p = model.p[name]
        for at in list(np.ndindex(p.shape))[:5]:
            old, eps = p[at].copy(), 1e-6
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - np.asarray(g)[at]) < 1e-5, name


def test_decontamination_finds_exact_and_substituted_items(spark, docs):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"), (2, "short item"), (3, None), (4, "a " * 30), (5, "")]
    text = items[0][1].split()
    spoilt = " ".join("other" if k in (4, 9) else w for k, w in enumerate(text))
    broken = " ".join("other" if k % 3 == 0 else w for k, w in enumerate(text))
    rows = [(1, "Before. " + items[0][1].upper() + "! after"), (2, "x y z " + spoilt), (3, broken), (4, "nothing here"), (5, "short item")] + [(k, "hot " + items[0][1]) for k in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.where("doc_id >= 900001 or doc_id is null").select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 1), (2, 1), (900_008, 4), *((k, 1) for k in range(10, 40))}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    found = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontamination(spark, SF).collect()}
    whole = {r.item_id: " " + " ".join(words(r.text)) + " " for r in table(spark, SF, "benchmark").collect()}
    inside = {(r.doc_id, k) for r in table(spark, SF, "documents").collect() for k, v in whole.items() if v in " " + " ".join(words(r.text)) + " "}
    assert inside and inside <= found


def test_language_model_counts_and_likelihood(spark, docs):
    got = hmm.language_scores(docs).collect()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in docs.collect()}
    train = Counter(w for k, v in tokens.items() if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1 for w in v)
    total, distinct = sum(train.values()), len(train)
    assert len(got) == len(ODD) + table(spark, SF, "documents").count()
    for r in got:
        v = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(v), sum(train[w] > 0 for w in v), total)
        want = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in v)
        assert abs(want - r.base_score) < 1e-8 * max(1, abs(want)) and r.score < 0
    seen = [r for r in got if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert hmm.language_scores(docs.limit(0)).count() == 0
    assert hmm.language_scores(docs.where("doc_id = 900006 or doc_id = 900001")).count() == 2


def test_forward_recursion_and_expectations_are_exact():
    rng = np.random.default_rng(2)
    k, c = hmm.STATES, 5
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    texts = [np.array(x) for x in ([0, 1, 4], [2], [3, 3, 1])]
    got = hmm.Texts(texts).forward(m, False)[0]
    for text, value in zip(texts, got, strict=True):
        total = sum(
            m.start[path[0]] * np.prod([m.emit[o, s] for o, s in zip(text, path, strict=True)]) * np.prod([m.move[a, b] for a, b in itertools.pairwise(path)])
            for path in itertools.product(range(k), repeat=len(text))
        )
        assert abs(math.log10(total) - value) < 1e-9
    counts, loglik = hmm.Texts(texts).expect(m)
    assert abs(counts.start.sum() - 3) < 1e-9 and abs(counts.move.sum() - 4) < 1e-9 and abs(counts.emit.sum() - 7) < 1e-9
    assert abs(loglik - got.sum()) < 1e-9
    better = hmm.Model((counts.start + 1e-9) / counts.start.sum(), counts.move / counts.move.sum(1, keepdims=True), counts.emit / counts.emit.sum(0))
    assert hmm.Texts(texts).forward(better, False)[0].sum() > got.sum()


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    equal, want = [], []
    for _ in range(60):
        base = rng.integers(1, 2**62, 200, dtype=np.uint64)
        other = base.copy()
        other[: rng.integers(0, 80)] += np.uint64(1)
        weights = rng.gamma(2.0, 2.0, 200)
        rows = []
        for hashes in (base, other):
            order = np.argsort(hashes)
            rows.append((hashes[order], weights[order]))
        a, b = (dict(zip(h.tolist(), w.tolist(), strict=True)) for h, w in rows)
        want.append(sum(min(a[x], b[x]) for x in a.keys() & b.keys()) / sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys()))
        signs = near.signatures(np.repeat([0, 1], 200), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        equal.append((signs[0] == signs[1]).mean())
    assert abs(np.mean(equal) - np.mean(want)) < 0.04


def test_near_duplicates_against_all_pairs(spark, docs):
    got = near.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    rows = docs.collect()
    texts = [(r.text or "").lower().encode() for r in rows]
    idf = near.idf_of(near.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text binary")))
    g = Group(texts, LETTERS)
    owner, hashes, weights = near.shingles(g, idf)
    bags = [dict(zip(hashes[owner == k].tolist(), weights[owner == k].tolist(), strict=True)) for k in range(len(texts))]
    cls = {r.doc_id: r.class_id for r in got}
    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = bags[i], bags[j]
        common = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
        similar = common / (sum(a.values()) + sum(b.values()) - common) >= 0.8 if a and b else texts[i] == texts[j]
        if similar:
            links += 1
            assert cls[rows[i].doc_id] == cls[rows[j].doc_id]
    assert links > 10 and cls[900_001] == cls[900_002] == 900_001 and cls[900_004] == cls[900_005] and cls[900_003] == 900_003
    kept = Counter(r.class_id for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.class_id for r in got}
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_masks_hit_every_accepted_substitution():
    for size in range(1, 17):
        masks = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.masks_of(size, 0.8)]
        looks = [{p + i for i in m} for m in masks for p in range(size - m[-1])]
        wrong = size - math.ceil(size * 4 / 5)
        assert all(any(not look & set(c) for look in looks) for c in itertools.combinations(range(size), wrong)), size


def test_decontamination_finds_short_and_much_substituted_items(spark):
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(3, 17)]
    docs = []
    for n, text in items:
        wrong = n - math.ceil(n * 4 / 5)
        for places in itertools.combinations(range(n), wrong):
            changed = [f"z{k}" if k in places else w for k, w in enumerate(text.split())]
            docs.append((1000 * n + len(docs), "before it " + " ".join(changed) + " and after", n))
    docs.append((1, "a " * 1000, 90))  # an item whose only equal words are a run of one word
    bench = spark.createDataFrame([*items, (90, "x " + "a " * 8 + "y")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df.drop("item_id"), bench).collect()}
    assert got == {(i, n) for i, _, n in docs}


def test_near_pairs_that_share_one_template(spark):
    """Pairs alike at 0.8 and a little more, in hundreds of documents that share 0.7 of them with each other."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(140)])
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    template, rows = " ".join(vocabulary), []
    for k in range(400):
        own = say(30)
        rows.append((2 * k, f"{template} {own} {say(10)}"))
        rows.append((2 * k + 1, f"{template} {own} {say(10)}"))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cls = {r.doc_id: r.class_id for r in got}
    assert [k for k in range(400) if cls[2 * k] != cls[2 * k + 1]] == [] and len(set(cls.values())) == 400


def test_large_groups_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = [(k, " ".join(base)) for k in range(150)]
    for k in range(150, 300):
        own = list(base)
        own[int(rng.integers(0, 300))] = f"v{k}"
        rows.append((k, " ".join(own)))
    rows += [(k, " ".join(f"u{x}" for x in rng.integers(0, 5000, 100))) for k in range(300, 340)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter(r.class_id for r in got)
    assert sizes[0] == 300 and sum(n == 1 for n in sizes.values()) == 40


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark, odd):
    docs = stored(table(spark, SF, "documents").unionByName(odd.select(*corpus_pipeline.COLUMNS)), "docs")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "secret scan", "packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "stage")
        assert out.columns == corpus_pipeline.COLUMNS
        rows = out.collect()
        assert len(rows) == len({r.doc_id for r in rows}) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        if name == "near duplicates":
            classes = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
            assert Counter(classes[r.doc_id] for r in rows) == Counter(set(classes.values()))
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(docs, table(spark, SF, "benchmark")).collect()}
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - bad
        if name == "secret scan":
            assert len(rows) == docs.count() and all(r.text == before[r.doc_id] or "[SECRET]" in r.text for r in rows)
        docs = out
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_components_of_few_links_take_few_tasks(spark):
    """Rounds over a small table cost by their tasks, whose figures the driver keeps: partitions of the shuffles must not multiply with rounds."""
    n, sc, found = 300, spark.sparkContext, None
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, n)], "a long, b long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 100)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tracker = sc.statusTracker()
        known = set(tracker.getJobIdsForGroup(None))
        labels = graph.components(links)
        labels = graph.merged(labels, spark.createDataFrame([(5, 1007), (5000, 5001)], "a long, b long"))
        found = {r.node: r.root for r in labels.collect()}
        stages = [tracker.getStageInfo(s) for j in set(tracker.getJobIdsForGroup(None)) - known for s in tracker.getJobInfo(j).stageIds]
        tasks = sum(s.numCompletedTasks for s in stages if s)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 0 for i in range(n)}, 5000: 5000, 5001: 5000}
    assert tasks < 2000, tasks
