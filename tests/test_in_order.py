"""What happens one after the other, against plain Python that does just that: change logs, registration, usernames, streams; lists of any size."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from noteframe.functions import text as T
from noteframe.operators import accounts, changes, library
from noteframe.operators.ordered import numbered, running
from noteframe.plans import maintenance_queries as M
from noteframe.plans import registry
from noteframe.plans.fixtures import Tables
from noteframe.streaming import stream

SF = "/root/testdata/sf0.001"


def shuffled(spark, rows, schema, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(5)


def test_patches_in_order(spark):
    rng = random.Random(4)
    notes = [{"id": k, "owner_id": k % 3, "title": f"t{k}", "structured_text": None, "subject": "s", "topic": None, "tags": "a"} for k in range(60)]
    log = []
    for seq in range(900):
        k = 7 if seq % 3 == 0 else rng.randrange(60)  # a third of all changes is about one note
        patch = {c: rng.choice([None, "", f"v{seq}"]) for c in rng.sample([*changes.PATCHABLE, "status"], rng.randrange(4))}
        log.append((k, k % 3 if rng.random() < 0.9 else 9, patch, seq))
    for k, owner, patch, _ in log:
        if notes[k]["owner_id"] == owner:
            notes[k] |= {c: v for c, v in patch.items() if c in changes.PATCHABLE}
    start = spark.createDataFrame([(k, k % 3, f"t{k}", None, "s", None, "a") for k in range(60)], "id long, owner_id long, title string, structured_text string, subject string, topic string, tags string")
    got = changes.patch_notes(start, shuffled(spark, log, "id long, owner_id long, patch map<string,string>, seq long")).collect()
    assert sorted((r.asDict() for r in got), key=lambda r: r["id"]) == notes


def test_tokens_summaries_and_categories_in_order(spark):
    rng = random.Random(6)
    fields = "id long, owner_id long, share_token string, ai_summary string, subject string, topic string, tags string"
    rows = [(k, k % 2, rng.choice([None, "", "own"]), None, "s", "t", "g") for k in range(30)]
    notes = {r[0]: dict(zip(("id", "owner_id", "share_token", "ai_summary", "subject", "topic", "tags"), r, strict=True)) for r in rows}
    log = [(rng.randrange(30), rng.randrange(2), f"x{seq}" if rng.random() < 0.8 else None, seq) for seq in range(200)]
    for k, owner, x, _ in log:
        n = notes[k]
        if n["owner_id"] == owner:
            if x is not None:
                n["share_token"] = n["share_token"] or x
                n["ai_summary"] = x
            n |= {"subject": x, "topic": "same", "tags": None}
    df = shuffled(spark, log, "id long, owner_id long, x string, seq long")
    out = changes.share_notes(spark.createDataFrame(rows, fields), df.withColumnRenamed("x", "token"))
    out = changes.store_summary(out, df.withColumnRenamed("x", "summary"))
    out = changes.store_categories(out, df.selectExpr("id", "owner_id", "x as subject", "'same' as topic", "cast(null as string) as tags", "seq"))
    assert {r.id: r.asDict() for r in out.collect()} == notes


def test_changes_without_numbers_leave_one_row_an_object(spark):
    books = spark.createDataFrame([(1, 1, "a", "c"), (2, 1, "b", "d")], "id long, owner_id long, name string, color string").withColumn("updated_at", M.as_of())
    patches = spark.createDataFrame([(1, 1, "x", None), (1, 1, "y", "z"), (1, 1, None, None)], "id long, owner_id long, name string, color string")
    assert sorted((r.id, r.name, r.color) for r in changes.patch_notebooks(books, patches, M.as_of()).select("id", "name", "color").collect()) == [(1, "y", "z"), (2, "b", "d")]


def test_sets_made_again_in_one_batch(spark):
    sets = spark.createDataFrame([(5, 1, 1, "old"), (6, 2, 1, "old")], "id long, note_id long, owner_id long, title string").withColumn("created_at", M.as_of())
    cards = spark.createDataFrame([(1, 5, "q", "a")], "id long, set_id long, question string, answer string")
    card = "array<struct<question:string,answer:string>>"
    made = spark.createDataFrame([(1, 1, f"n{seq}", again, [("q", str(seq))], seq) for seq, again in enumerate([True, False, True, False])] + [(2, 1, "m", False, [("q", "m")], 9)], f"note_id long, owner_id long, note_title string, regenerate boolean, cards {card}, seq long")
    new, kept = changes.replace_flashcards(made, sets, cards, M.as_of())
    assert sorted(r.title for r in new.collect()) == ["Flashcards for m", "Flashcards for n2", "Flashcards for n3", "old"]
    assert sorted(r.answer for r in kept.collect()) == ["2", "3", "m"]


def one_by_one(candidates, users):
    mails, names, out = {u[0] for u in users if u[0] is not None}, {u[1] for u in users if u[1] is not None}, {}
    for k, mail, name in sorted(candidates):
        out[k] = "email_taken" if mail in mails else "username_taken" if name in names else "ok"
        if out[k] == "ok":
            mails |= {mail} - {None}
            names |= {name} - {None}
    return out


@pytest.mark.parametrize("n,mails,names", [(10_000, 4000, 3000), (2000, 60, 2000), (40, 3, 3)])
def test_registration_in_order(spark, n, mails, names):
    rng = random.Random(n)
    pick = lambda p, m: rng.choice([None, f"{p}0", f"{p}{rng.randrange(m)}", f"{p}{rng.randrange(m)}", f"{p}{rng.randrange(m)}"])
    candidates = [(k, pick("m", mails), pick("n", names)) for k in range(n)]
    users = [("m1", "n1"), ("m2", None), (None, "n3"), ("#3", "=4")]
    got = accounts.check_registration(shuffled(spark, candidates, "candidate_id long, email string, username string"), spark.createDataFrame(users, "email string, username string")).collect()
    assert {r.candidate_id: r.outcome for r in got} == one_by_one(candidates, users) and len(got) == n


def test_registration_down_a_chain(spark):
    """Each candidate is refused only if the one before is not."""
    candidates = [(k, f"m{k // 2}", f"n{(k + 1) // 2}") for k in range(24)]
    got = accounts.check_registration(spark.createDataFrame(candidates, "candidate_id long, email string, username string"), spark.createDataFrame([], "email string, username string")).collect()
    assert {r.candidate_id: r.outcome for r in got} == one_by_one(candidates, [])
    assert accounts.check_registration(spark.createDataFrame([], "candidate_id long, email string, username string"), spark.createDataFrame([("a", "b")], "email string, username string")).collect() == []


def names_one_by_one(logins, users):
    taken, out = set(users), {}
    for k, slug in sorted(logins):
        name, n = slug, 1
        while name in taken:
            name, n = f"{slug}_{n}", n + 1
        taken.add(name)
        out[k] = name
    return out


@pytest.mark.parametrize("seed", range(6))
def test_usernames_in_order(spark, seed):
    rng = random.Random(seed)
    slugs = ["a", "a_1", "a_2", "a_1_1", "b", "b_01", "b_1", "c_9999999999999999999", "a_"][: 4 + seed]
    logins = [(k, rng.choice(slugs)) for k in rng.sample(range(1000), 60)]
    users = {rng.choice(slugs) + rng.choice(["", "_1", "_2", "_5", "_01"]) for _ in range(6)}
    new = shuffled(spark, [(k, slug, None) for k, slug in logins], "login_id long, name string, email string")
    got = {r.login_id: r.username for r in accounts.assign_usernames(new, spark.createDataFrame([(u,) for u in users], "username string")).collect()}
    assert got == names_one_by_one(logins, users)


def test_usernames_of_one_slug_and_many_taken(spark):
    logins = [(k, "user") for k in range(2000)]
    users = {f"user_{k}" for k in range(1, 3000, 3)} | {"user"}
    new = spark.createDataFrame([(k, s, None) for k, s in logins], "login_id long, name string, email string").repartition(6)
    got = {r.login_id: r.username for r in accounts.assign_usernames(new, spark.createDataFrame([(u,) for u in users], "username string")).collect()}
    assert got == names_one_by_one(logins, users)


def test_running_sums_and_places_over_ranges(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, cast(id % 7 as string), null) as g", "id as k", "id % 5 as v").repartition(6)
    got = {(r.g, r.k): (r.s, r.turn) for r in numbered(running(df.na.fill("-"), ["g"], [F.col("k")], s="v"), ["g"], [F.col("k").desc()]).collect()}
    want, sums, counts = {}, {}, {}
    key = lambda k: str(k % 7) if k % 3 == 0 else "-"
    for k in range(4000):
        sums[key(k)] = sums.get(key(k), 0) + k % 5
        want[key(k), k] = sums[key(k)]
    for k in reversed(range(4000)):
        counts[key(k)] = counts.get(key(k), 0) + 1
        want[key(k), k] = (want[key(k), k], counts[key(k)])
    assert got == want


def test_a_large_notebook_is_many_pages(spark):
    notes = spark.range(2500).selectExpr("id", "1L as owner_id", "concat('n', id) as title", "'completed' as status", "timestamp_ntz '2024-01-01 00:00:00' + (id % 50) * interval '1' hour as created_at").repartition(7)
    books = spark.createDataFrame([(1, 1, "b", "c"), (2, 1, "e", "c")], "id long, owner_id long, name string, color string").withColumn("updated_at", M.as_of())
    bridge = notes.selectExpr("id as note_id", "1L as notebook_id")
    pages = sorted(library.notebook_notes(books, bridge, notes).collect(), key=lambda r: r.page)
    assert [len(r.notes) for r in pages] == [100] * 25 and {r.note_count for r in pages} == {2500}
    order = sorted(range(2500), key=lambda k: (k % 50, k), reverse=True)
    assert [n.note_id for r in pages for n in r.notes] == order


def test_notes_outside_are_those_of_requests(spark):
    t = Tables(spark, SF)
    ask = spark.createDataFrame([(3, 3), (3, 3), (4, 5), (999_999, 1)], "notebook_id long, owner_id long")
    got = library.notes_not_in_notebook(ask, t.notebooks, t.note_notebooks, t.notes, 2)
    inside = {r.note_id for r in t.note_notebooks.where("notebook_id = 3").collect()}
    assert sorted((r.notebook_id, r.note_id) for r in got.collect()) == sorted((3, r.id) for r in t.notes.where("owner_id = 3").collect() if r.id not in inside)


def test_notes_outside_name_their_owner(spark):
    rows = registry.queries()["notes_not_in_notebook"](spark, SF)
    owner = {r.id: r.owner_id for r in Tables(spark, SF).notes.collect()}
    assert rows.columns == ["notebook_id", "note_id", "owner_id", "title"]
    assert all(r.owner_id == owner[r.note_id] for r in rows.collect()) and not rows.isEmpty()


def test_each_page_is_an_image_file(spark):
    got = registry.queries()["image_files"](spark, SF).collect()
    size = {r.page_id: len((r.html or "").encode()) + 1 for r in Tables(spark, SF).pages.collect()}
    assert len(got) == len(size) and {r.page_id: r.length for r in got} == size


def test_a_batch_that_runs_again_keeps_its_ids(spark, tmp_path):
    notes = spark.createDataFrame([(41, 2, "old")], "id long, owner_id long, title string")
    table, page = f"{tmp_path}/notes", '{"page_layout": "mixed", "raw_text": "hello", "elements": [{"type": "label", "content": "hello"}]}'
    stream.start_notes(notes, table)
    stream.start_notes(notes.withColumn("id", F.lit(7).cast("long")), table)  # what is there stays
    (tmp_path / "landing").mkdir()
    for k in range(3):
        for x in "ba":
            (tmp_path / "landing" / f"{k}{x}.json").write_text(page)
        if k == 2:  # the last batch was written, but its end was not recorded
            for name in ("1", ".1.crc"):
                (tmp_path / "checkpoint" / "commits" / name).unlink()
        stream.stream_digitize(stream.page_files(spark, f"{tmp_path}/landing"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", table, 5, M.as_of()).awaitTermination()
    got = sorted((r.id, (r.image_filename or "old")[-7:], r.batch) for r in stream.read_notes(spark, table).collect())
    assert got == [(41, "old", -1), (42, "0a.json"[-7:], 0), (43, "0b.json", 0), (44, "1a.json", 1), (45, "1b.json", 1), (46, "2a.json", 2), (47, "2b.json", 2)]


def test_formulas_and_tags_against_regular_expressions(spark):
    rng = random.Random(2)
    shown, inline = r"\$\$([\s\S]*?)\$\$", "(?<!\\$)\\$(?!\\$)((?:[^$\\\\]|\\\\[^\n\r  ])+?)\\$(?!\\$)"
    rows = ["".join(rng.choice("$$$\\\\\nab\x01  ") for _ in range(rng.randrange(26))) for _ in range(6000)]
    tags = ["".join(rng.choice("<>ab \n") for _ in range(rng.randrange(20))) for _ in range(6000)]
    df = spark.createDataFrame(list(zip(range(6000), rows, tags, strict=True)), "k int, c string, t string")
    for r in df.select("k", T.extract_formulas("c").alias("f"), T.without_tags(F.col("t"), "_").alias("t")).collect():
        found = re.findall(shown, rows[r.k]) + re.findall(inline, re.sub(shown, "", rows[r.k]))
        assert r.f == [x.strip(T.WHITE) for x in found] and r.t == re.sub("<[^>]+>", "_", tags[r.k])


@pytest.mark.parametrize(
    "text,formulas,plain",
    [
        ("$5 " + "word " * 200_000 + "$7", 1, None), ("$" + "\\$" * 500_000, 0, None), ("$a" * 300_000, 150_000, None), ("$" + "\\\\" * 500_000 + "$", 1, None), ("$$" * 300_000, 150_000, None),
        ("<" * 1_000_000, 0, "<" * 1_000_000), ("<b>" * 300_000, 0, ""), ("<>" * 300_000, 0, "<>" * 300_000),
    ],
)
def test_a_million_characters_in_one_text(spark, text, formulas, plain):
    start = time.time()
    r = spark.createDataFrame([(text,)], "c string").select(F.size(T.extract_formulas("c")).alias("n"), T.strip_html("c").alias("s")).first()
    assert r.n == formulas and (plain is None or r.s == plain) and time.time() - start < 30
