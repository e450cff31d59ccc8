"""Membership by owner: as pair by pair, and no pair is shuffled."""

from noteframe.operators import changes, library
from noteframe.plans import maintenance_queries as M

NOTES = "id long, owner_id long, title string"


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark):
    notes = spark.range(300).selectExpr("id", "case when id % 7 = 0 then 2 else 1 end as owner_id", "case when id % 5 > 0 then concat('t', id) end as title")
    books = spark.range(60).selectExpr("id", "case when id % 6 = 0 then 2 when id = 59 then 3 else 1 end as owner_id", "timestamp_ntz '2020-01-01 00:00:00' as updated_at")
    bridge = spark.range(60).selectExpr("id as notebook_id", "explode(sequence(0, 290, cast(1 + id % 4 as int))) as n").selectExpr("cast(n as long) as note_id", "notebook_id")
    return notes, books, bridge.union(bridge.where("note_id < 5"))


def test_by_owner_is_as_pair_by_pair(spark):
    notes, books, bridge = made(spark)
    asked_notes = spark.range(0, 400, 3).selectExpr("id as note_id", "cast(1 + id % 3 as long) as owner_id").union(spark.range(0, 400, 2).selectExpr("id", "2"))
    asked_notes = asked_notes.union(spark.range(0, 300, 3).selectExpr("id", "1"))  # some twice, some of strangers, some of nobody
    asked_books = spark.range(0, 70, 2).selectExpr("id as notebook_id", "case when id % 6 = 0 then 2 else 1 end as owner_id").union(spark.range(59, 60).selectExpr("id", "3"))
    asked_books = asked_books.union(asked_books.limit(9))
    requests = asked_notes.join(asked_books, "owner_id")
    one = changes.add_members(requests, books, notes, bridge, M.as_of())
    by_owner = changes.add_every_member(asked_notes, asked_books, books, notes, bridge, M.as_of())
    assert pairs(one[0]) == pairs(by_owner[0]) and pairs(one[1]) == pairs(by_owner[1])
    one = changes.remove_members(requests, books, bridge, M.as_of())
    by_owner = changes.remove_every_member(asked_notes, asked_books, books, bridge, M.as_of())
    assert pairs(one[0]) == pairs(by_owner[0]) and pairs(one[1]) == pairs(by_owner[1])


def test_blocks_and_groups_of_any_size_give_the_same_pairs(spark):
    notes, books, bridge = made(spark)
    mine, own = notes.withColumnRenamed("id", "note_id"), books.selectExpr("id as notebook_id", "owner_id")
    every = own.join(mine, "owner_id").join(bridge, ["note_id", "notebook_id"], "left_anti").select("notebook_id", "owner_id", "note_id", "title")
    for block, group in ((7, 3), (1, 100), (1000, 1)):
        assert pairs(library.pairs_but(own, mine, bridge, block, group)) == pairs(every)


def shuffled(df, what="shuffleRecordsWritten"):
    """What the exchanges of a plan wrote, and its rows."""
    rows = df._jdf.queryExecution().executedPlan().execute().count()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            nodes.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply(what).value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return total, rows


def test_pairs_are_not_shuffled(spark):
    """2,000 notes and 1,000 notebooks of one owner: 500,000 pairs were shuffled many times, or rows for each notebook and block with the notes of the block."""
    notes = spark.range(2000).selectExpr("id", "1L as owner_id", "concat('t', id) as title")
    books = spark.range(1000).selectExpr("id", "1L as owner_id", "timestamp_ntz '2020-01-01 00:00:00' as updated_at")
    bridge = spark.range(1000).selectExpr("id as note_id", "id as notebook_id")
    asked = notes.where("id % 4 = 0").selectExpr("id as note_id", "owner_id"), books.selectExpr("id as notebook_id", "owner_id")
    added = changes.add_every_member(*asked, books, notes, bridge, M.as_of())
    for df, n in ((added[1], 500_000 + 750), (added[0], 1000), (changes.remove_every_member(*asked, books, bridge, M.as_of())[1], 750)):
        moved, rows = shuffled(df)
        assert rows == n and 0 < moved < 30_000


def test_notes_come_to_notebooks_once_a_block(spark):
    """The lists of notes were shuffled once for each notebook: 2,000 notes and 1,000 notebooks made some 80 MB."""
    notes = spark.range(2000).selectExpr("id", "1L as owner_id", "concat('a title of some length ', id) as title")
    books = spark.range(1000).selectExpr("id", "1L as owner_id")
    bridge = spark.range(1000).selectExpr("id as note_id", "id as notebook_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        df = library.notes_not_in_notebook(books.selectExpr("id as notebook_id", "owner_id"), books, bridge, notes)
        size, rows = shuffled(df, "dataSize")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert rows == 2_000_000 - 1000 and 0 < size < 3_000_000
