"""Every registered query against its DuckDB statement, properties of change sets, and what plans must not hold."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from noteframe.operators import accounts, changes, layout, library
from noteframe.plans import maintenance_queries as M
from noteframe.plans.define import ORACLES, QUERIES
from noteframe.plans.fixtures import Tables
from noteframe.streaming import stream

SF = "/root/testdata/sf0.001"
STREAMS = {"stream_digitize", "stream_notes", "stream_study"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("documents", "pages", "conversations", "events", "customer", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in STREAMS:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|LocalTableScan.*NestedLoop", plan)
        assert name in {"create_notebooks", "append_explanations", "replace_flashcards", "replace_flashcards_cards"} or "NestedLoop" not in plan
        assert name == "enriched_notes" or not re.search("Python|Pandas|Arrow", plan)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert rows
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(range(len(columns)), key=columns.__getitem__)
        assert rows == sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=str)


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_adding_twice_is_adding_once(tables):
    request = M._adds(tables)
    books, bridge = changes.add_members(request, tables.notebooks, tables.notes, tables.note_notebooks, M.as_of())
    later = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    again, twice = changes.add_members(request, books, tables.notes, bridge, later)
    assert pairs(twice) == pairs(bridge) and again.where(F.col("updated_at") == later).isEmpty()


def test_notes_in_and_not_in_a_notebook_are_all(tables):
    inside = library.members(tables.notebooks, tables.note_notebooks, tables.notes).select("notebook_id", "note_id")
    requests = tables.notebooks.selectExpr("id as notebook_id", "owner_id")
    outside = library.notes_not_in_notebook(requests, tables.notebooks, tables.note_notebooks, tables.notes).select("notebook_id", "note_id")
    every = tables.notebooks.selectExpr("id as notebook_id", "owner_id").join(tables.notes.selectExpr("id as note_id", "owner_id"), "owner_id").select("notebook_id", "note_id")
    assert inside.intersect(outside).isEmpty() and pairs(inside.union(outside)) == pairs(every)


def test_bands_partition_elements_whatever_the_partitions(tables):
    one = layout.assign_bands(layout.reading_order(tables.ocr_elements)).select("page_id", "ord", "band")
    other = layout.assign_bands(layout.reading_order(tables.ocr_elements.repartition(7))).select("page_id", "ord", "band")
    assert pairs(one) == pairs(other) and one.count() == tables.ocr_elements.count()


def test_sharing_is_stable(tables):
    request = tables.notes.selectExpr("id", "owner_id", "concat('a', id) as token")
    once = changes.share_notes(tables.notes, request)
    twice = changes.share_notes(once, request.withColumn("token", F.lit("b")))
    assert pairs(once.select("id", "share_token")) == pairs(twice.select("id", "share_token"))


def test_usernames_that_look_like_candidates(spark):
    users = spark.createDataFrame([("a",), ("b_1",), ("c",), ("c_1",)], "username string")
    new = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a_1", None), (4, "b", None), (5, "b", None), (6, "c", None), (7, None, "D@x.y")], "login_id long, name string, email string")
    got = {r.login_id: r.username for r in accounts.assign_usernames(new, users).collect()}
    assert len(set(got.values())) == 7 and not set(got.values()) & {"a", "b_1", "c", "c_1"}
    assert got[4] == "b" and got[5] == "b_2" and got[6] == "c_2" and got[7] == "d" and got[1] == "a_1"


def test_new_ids_follow_the_old_ones(spark):
    new, old = spark.range(1000).selectExpr("id as k").repartition(9), spark.createDataFrame([(41,)], "id long")
    got = [r.id for r in changes.next_ids(new, old, "k").orderBy("k").collect()]
    assert got == list(range(42, 1042))


def test_stream_of_page_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"page_layout": "mixed", "raw_text": "hello", "elements": [{"type": "label", "content": "hello"}]}')
    (landing / "b.json").write_text("not json")
    for _ in range(2):  # the second run finds nothing new
        stream.stream_digitize(stream.page_files(spark, str(landing)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.page_id[-6:]: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a.json": "completed", "b.json": "failed"}
