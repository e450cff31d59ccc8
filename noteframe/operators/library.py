"""Library queries over many owners at once: listing, search, classification, membership, facets and views.

Tables are notes, notebooks, note_notebooks (the bridge), users, flashcard_sets, flashcards and ai_explanations. Every
join is an equi join on keys; nothing is collected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.functions import text as T
from noteframe.operators.ordered import numbered

SEARCHED = ("title", "raw_text", "subject", "topic", "tags")
NOTE_TYPES = ("default", "lecture", "meeting")
#: What users are told about an upload.
FEEDBACK = {
    "failed": "Text extraction failed — see details in the note.",
    "recovered": "We recovered some text, but processing also reported an error. Please review this note carefully.",
    "no_text": "We couldn't extract any text from this image. Try uploading a clearer photo.",
    "incomplete": "We extracted some text, but it looks incomplete. Please review it before relying on it.",
    "success": "🐵 Note peeled successfully!",
}


# filters and projections


def for_owner(df: DataFrame, owner_id: int) -> DataFrame:
    return df.where(F.col("owner_id") == owner_id)


def get_notes(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested (id, owner_id) pairs with the note's title and `found`; a note of another owner is not found."""
    own = notes.select("id", "owner_id", "title", F.lit(True).alias("found"))
    return requests.join(own, ["id", "owner_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def search_notes(notes: DataFrame, q: str | None = None, subject: str | None = None, topic: str | None = None) -> DataFrame:
    """Notes with q in any searched column, without regard to case; % and _ are wildcards. Newest first, without a limit."""
    if q:
        notes = notes.where(reduce(or_, (F.col(c).ilike(T.like_pattern(q)) for c in SEARCHED)))
    if subject:
        notes = notes.where(F.col("subject") == subject)
    if topic:
        notes = notes.where(F.col("topic") == topic)
    return newest_first(notes)


def search_client(notes: DataFrame, q: str) -> DataFrame:
    """The plain substring search over title, subject and tags."""
    return notes.where(reduce(or_, (F.instr(F.lower(T.filled(c)), q.lower()) > 0 for c in ("title", "subject", "tags"))))


def with_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains(T.split_tags("tags"), tag))


def newest_first(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_first(), F.col("id").desc())


def list_notes(notes: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return newest_first(notes).offset(skip).limit(limit)


def page_per_owner(notes: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """The same page of every owner's notes."""
    order = W.partitionBy("owner_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
    return notes.withColumn("position", F.row_number().over(order)).where(F.col("position").between(skip + 1, skip + limit))


def list_notebooks(notebooks: DataFrame) -> DataFrame:
    return newest_first(notebooks, "updated_at")


def list_view(notes: DataFrame) -> DataFrame:
    return notes.select("id", "owner_id", "title", "subject", "topic", "tags", public_status().alias("status"), "image_filename", "created_at")


def full_view(notes: DataFrame) -> DataFrame:
    return notes.select("id", "owner_id", "title", "raw_text", "structured_text", "ai_summary", "subject", "topic", "tags", public_status().alias("status"), "image_filename", "share_token", "created_at")


def text_view(notes: DataFrame) -> DataFrame:
    return notes.select("id", "title", "raw_text", "structured_text", public_status().alias("status"))


def enrichable(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("raw_text").isNotNull() & (F.col("raw_text") != ""))


def validate_note_type(c: Column) -> Column:
    return F.when(c.isin(*NOTE_TYPES), c).otherwise("default")


# classification of rows


def has_text() -> Column:
    return (T.trim_ws("raw_text") != "") | (T.trim_ws("structured_text") != "")


def public_status() -> Column:
    return F.when((F.col("status") == "failed") & has_text(), "needs_review").otherwise(F.col("status"))


def extracted_text() -> Column:
    return T.strip_html(F.coalesce(T.first_filled(T.trim_ws("raw_text"), T.trim_ws("structured_text")), F.lit("")))


def is_likely_incomplete(text: Column) -> Column:
    return (text != "") & (F.length(text) < 120) & (T.ascii_word_count(text) < 18)  # words of short texts only are counted


def upload_feedback(notes: DataFrame) -> DataFrame:
    """id, kind, message and timeout of what an upload led to; a stored status `failed` may come with text."""
    rows = notes.withColumn("_text", extracted_text())
    failed, none = F.col("status") == "failed", F.col("_text") == ""
    case = F.when(failed & none, "failed").when(failed, "recovered").when(none, "no_text").when(is_likely_incomplete(F.col("_text")), "incomplete").otherwise("success")
    kind = F.when(F.col("case").isin("failed", "success"), F.col("case")).otherwise("warning")
    messages = F.create_map(*(F.lit(x) for pair in FEEDBACK.items() for x in pair))
    timeout = F.when(F.col("case") == "success", 3000).otherwise(5000)
    return rows.withColumn("case", case).select("id", kind.alias("kind"), messages[F.col("case")].alias("message"), timeout.alias("timeout_ms"))


def should_reprocess(notes: DataFrame) -> DataFrame:
    """id, reprocess (worth showing) and the class of the reason."""
    thin, failed = is_likely_incomplete(extracted_text()), F.col("status") == "failed"
    reason = F.when(failed & has_text(), "unreliable").when(failed, "failed").when(thin, "thin").otherwise("optional")
    shown = F.col("image_filename").isNotNull() & (F.col("image_filename") != "") & (failed | thin)
    return notes.select("id", shown.alias("reprocess"), reason.alias("reason"))


def display_body(empty: str = "") -> Column:
    """Structured text, else raw text; text without tags gets breaks for its new lines."""
    body = F.coalesce(T.first_filled("structured_text", "raw_text"), F.lit(empty))
    return F.when((F.instr(body, "<") > 0) & (F.instr(body, ">") > 0), body).otherwise(T.newline_to_br(body))


# joins


def count_members(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("notebook_id").agg(F.count("note_id").alias("note_count"))


def notebook_counts(notebooks: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every notebook with its number of notes, 0 where it has none: one aggregate, one join."""
    counts = count_members(bridge).withColumnRenamed("notebook_id", "id")
    return notebooks.join(counts, "id", "left").withColumn("note_count", F.coalesce("note_count", F.lit(0)))


def members(notebooks: DataFrame, bridge: DataFrame, notes: DataFrame) -> DataFrame:
    """(notebook, note) rows of the same owner, with the notebook's columns as a struct `notebook`."""
    books = notebooks.select(F.col("id").alias("notebook_id"), "owner_id", F.struct("id", "name", "color", "updated_at").alias("notebook"))
    own = notes.withColumnRenamed("id", "note_id")
    return bridge.join(books, "notebook_id").join(own, ["note_id", "owner_id"])


def notebook_notes(notebooks: DataFrame, bridge: DataFrame, notes: DataFrame, page_size: int = 100) -> DataFrame:
    """Every notebook that has notes of its owner, as pages of up to `page_size` notes, newest first: page (from 0), notes, and the notebook's note_count.

    Notes are placed by a sort over ranges, so a notebook of any size is many rows, and no task holds its list.
    """
    rows = members(notebooks, bridge, notes).select("notebook_id", "owner_id", F.col("notebook.name").alias("name"), "created_at", "note_id", "title", "status")
    placed = numbered(rows, ["notebook_id"], [F.col("created_at").desc(), F.col("note_id").desc()], "place")
    item = F.struct("place", "created_at", "note_id", "title", "status")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("place"))
    page = F.floor((F.col("place") - 1) / page_size).cast("long")
    pages = placed.groupBy("notebook_id", page.alias("page")).agg(F.first("owner_id").alias("owner_id"), F.first("name").alias("name"), listed.alias("notes"))
    counts = placed.groupBy("notebook_id").agg(F.count(F.lit(1)).alias("note_count"))
    return pages.join(counts, "notebook_id").select("notebook_id", "owner_id", "name", "page", "notes", "note_count")


def notes_not_in_notebook(requests: DataFrame, notebooks: DataFrame, bridge: DataFrame, notes: DataFrame) -> DataFrame:
    """(notebook_id, note_id, owner_id, title) for every note of the owner of a requested notebook (notebook_id, owner_id) that is not in it.

    A request for another owner's notebook gives nothing. What comes out is as long as the answer; see `pairs_but` for the rest.
    """
    books = notebooks.select(F.col("id").alias("notebook_id"), "owner_id")
    asked = requests.select("notebook_id", "owner_id").distinct().join(books, ["notebook_id", "owner_id"], "left_semi")
    return pairs_but(asked, notes.select(F.col("id").alias("note_id"), "owner_id", "title"), bridge).select("notebook_id", "note_id", "owner_id", "title")


def pairs_but(books: DataFrame, notes: DataFrame, bridge: DataFrame, block: int = 1024, group: int = 4096) -> DataFrame:
    """Every notebook of books (notebook_id, owner_id) with every one of its owner's notes (note_id, owner_id and more) that the bridge does not have in it.

    An owner's notes are dealt by a hash into blocks of some `block`, the owner's notebooks into groups of some `group`. A
    notebook first gets what it has in each block, then the notes of the block come to it as one list, so the pairs
    themselves are made last and are never shuffled: what moves is a row for each notebook and block, and each note once a
    group. An owner of any size is many blocks and groups, and no task holds more than a list of one block.
    """
    sizes = notes.groupBy("owner_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    sizes = sizes.join(books.groupBy("owner_id").agg(F.ceil(F.count(F.lit(1)) / group).alias("_groups")), "owner_id")
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = [c for c in notes.columns if c != "owner_id"]
    lists = notes.join(sizes, "owner_id").groupBy("owner_id", of("note_id", "_blocks").alias("_block"), "_groups").agg(F.array_sort(F.collect_list(F.struct("note_id", *(c for c in own if c != "note_id")))).alias("_all"))
    lists = lists.select("owner_id", "_block", "_all", each("_groups").alias("_group"))
    dealt = books.join(sizes, "owner_id").select("notebook_id", "owner_id", of("notebook_id", "_groups").alias("_group"), "_blocks")
    inside = bridge.select("notebook_id", "note_id").join(dealt.select("notebook_id", "_blocks"), "notebook_id")
    inside = inside.groupBy("notebook_id", of("note_id", "_blocks").alias("_block")).agg(F.collect_set("note_id").alias("_inside"))
    asked = dealt.select("notebook_id", "owner_id", "_group", each("_blocks").alias("_block")).join(inside, ["notebook_id", "_block"], "left")
    left = F.when(F.col("_inside").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda n: ~F.array_contains("_inside", n["note_id"])))
    return asked.join(lists, ["owner_id", "_group", "_block"]).select("notebook_id", "owner_id", F.inline(left))


def membership_to_add(requests: DataFrame, notebooks: DataFrame, notes: DataFrame, bridge: DataFrame) -> DataFrame:
    """Requests (owner_id, notebook_id, note_id), each once, with the outcome: add, no_notebook, no_note or member."""
    books = notebooks.select(F.col("id").alias("notebook_id"), "owner_id", F.lit(1).alias("_book"))
    own = notes.select(F.col("id").alias("note_id"), "owner_id", F.lit(1).alias("_note"))
    have = bridge.select("note_id", "notebook_id").distinct().withColumn("_have", F.lit(1))
    rows = requests.select("owner_id", "notebook_id", "note_id").distinct()
    rows = rows.join(books, ["notebook_id", "owner_id"], "left").join(own, ["note_id", "owner_id"], "left").join(have, ["note_id", "notebook_id"], "left")
    outcome = F.when(F.col("_book").isNull(), "no_notebook").when(F.col("_note").isNull(), "no_note").when(F.col("_have").isNotNull(), "member").otherwise("add")
    return rows.select("owner_id", "notebook_id", "note_id", outcome.alias("outcome"))


def shared_view(notes: DataFrame, users: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Shared notes (of the given tokens, if any) with the owner's name, whoever asks."""
    shared = notes.where(F.col("share_token").isNotNull())
    if tokens is not None:
        shared = shared.join(tokens.select("share_token"), "share_token", "left_semi")
    owners = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_name"))
    return shared.join(owners, "owner_id", "left").select("share_token", "id", "title", "owner_name", display_body("<em>No content</em>").alias("body"), T.split_tags("tags").alias("tags"))


def flashcard_sets_nested(sets: DataFrame, cards: DataFrame) -> DataFrame:
    """Every set with its cards by id as a list; sets without cards have an empty one."""
    listed = cards.groupBy(F.col("set_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "question", "answer"))).alias("cards"))
    empty = F.array().cast("array<struct<id:bigint,question:string,answer:string>>")
    return sets.join(listed, "id", "left").withColumn("cards", F.coalesce("cards", empty))


# aggregates


def facets(notes: DataFrame) -> DataFrame:
    """Sorted distinct subjects and topics of each owner; empty ones do not count."""
    seen = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return notes.groupBy("owner_id").agg(seen("subject").alias("subjects"), seen("topic").alias("topics"))


def tag_counts(notes: DataFrame) -> DataFrame:
    tags = notes.select("owner_id", "id", F.explode(F.array_distinct(T.split_tags("tags"))).alias("tag"))
    return tags.groupBy("owner_id", "tag").agg(F.count("id").alias("note_count"))


def tag_facet(notes: DataFrame) -> DataFrame:
    tags = notes.select("owner_id", F.explode(T.split_tags("tags")).alias("tag"))
    return tags.groupBy("owner_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def explanations_for_note(explanations: DataFrame) -> DataFrame:
    """Explanations of each note with their position, newest first."""
    order = W.partitionBy("owner_id", "note_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
    return explanations.withColumn("position", F.row_number().over(order))


def batch_outcome(notes: DataFrame, batch: Column) -> DataFrame:
    """Uploaded n of m for each batch; an upload that failed is skipped, the rest counts."""
    ok = F.count_if(F.col("status") != "failed")
    return notes.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("total"), ok.alias("uploaded"))


def remove_rows(df: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def prepend_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    return new.unionByName(df, allowMissingColumns=True)
