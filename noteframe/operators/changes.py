"""Change sets: old snapshot and changes to new snapshot. Absent and null are told apart where the rules need it.

A batch may change one object many times. Changes carry a sequence number `seq`; they are folded by key, as they would have
been applied one after the other, before they meet the snapshot, so an object stays one row. Folds are aggregates, partial
ones first, so an object that most changes are about is no burden to one task. Changes with the same number, or without
any, count in the order of what they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from noteframe.functions import text as T
from noteframe.operators import library
from noteframe.sources.storage import kept

PATCHABLE = ("title", "structured_text", "subject", "topic", "tags")
#: Fixed value: the colour of a notebook that names none.
COLOR = "#FFC107"


def set_audit(df: DataFrame, as_of: Column, *columns: str) -> DataFrame:
    """Stamp time columns with a given time, so that a run can be repeated."""
    return df.withColumns({c: as_of for c in columns})


def next_ids(new: DataFrame, old: DataFrame, order: str) -> DataFrame:
    """Number new rows on from the largest old id, in the given order; rows that tie in it by their other columns.

    Rows are sorted by ranges of the order; a row's number is its place in its range and the counts of the ranges before.
    The sorted rows are written to a shared folder, as numbers and counts have to come from the same ranges, also when
    an executor is lost.
    """
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    ties = [f.name for f in new.schema.fields if f.name != order and not isinstance(f.dataType, Ty.MapType | Ty.VariantType)]
    ranked = kept(new.orderBy(order, *ties).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    block = F.shiftright("_m", 33)
    sizes = ranked.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(W.orderBy("_block")) - F.col("_size")).drop("_size")
    rows = ranked.withColumn("_block", block).join(before, "_block")  # as many rows as tasks
    place = F.col("_m") - F.shiftleft("_block", 33)
    return rows.withColumn("id", F.lit(top) + F.col("_before") + place + 1).drop("_m", "_block", "_before")


def begin_notes(notes: DataFrame, uploads: DataFrame, as_of: Column) -> DataFrame:
    """New rows for uploads (upload_id, title, image_filename, owner_id), numbered on from the notes in the order of upload_id: processing, without a text."""
    rows = next_ids(uploads, notes, "upload_id")
    return rows.select("id", "upload_id", T.note_title("title", "image_filename").alias("title"), F.coalesce(T.first_filled("image_filename"), F.lit("uploaded_image")).alias("image_filename"), "owner_id", F.lit("processing").alias("status"), as_of.alias("created_at"))


def finish_notes(began: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Rows of begin_notes with what their extraction gave (upload_id, raw_text, structured_text, error).

    With an error they are failed and hold it as their message, without a text or time; else they are completed. A row
    without a result is still processing.
    """
    got = results.select("upload_id", "raw_text", "structured_text", F.nullif("error", F.lit("")).alias("_error"), F.lit(True).alias("_got"))
    rows = began.join(got, "upload_id", "left")
    failed, done = F.col("_error").isNotNull(), F.col("_got") & F.col("_error").isNull()
    return rows.withColumns(
        {
            "status": F.when(failed, "failed").when(done, "completed").otherwise(F.col("status")),
            "error_message": F.col("_error"),
            "processed_at": F.when(done, as_of),
            "raw_text": F.when(done, F.col("raw_text")),
            "structured_text": F.when(done, F.col("structured_text")),
        }
    ).drop("_error", "_got")


def insert_notes(notes: DataFrame, uploads: DataFrame, results: DataFrame, as_of: Column, categories: DataFrame | None = None) -> DataFrame:
    """Notes with those of new uploads: begun, finished, and categorised (upload_id, subject, topic, tags) where that worked.

    Only completed notes take categories, and whether they get any never changes a status.
    """
    new = finish_notes(begin_notes(notes, uploads, as_of), results, as_of)
    if categories is not None:
        made = new.where("status = 'completed'").select("id", "owner_id", "upload_id").join(categories, "upload_id").drop("upload_id")
        bare = new.withColumns({c: F.lit(None).cast("string") for c in ("subject", "topic", "tags")})
        new = store_categories(bare, made)
    return notes.unionByName(new.drop("upload_id"), allowMissingColumns=True)


def _turn(changes: DataFrame, *said: Column) -> Column:
    """Sorts a change among those of its object."""
    return F.struct((F.col("seq") if "seq" in changes.columns else F.lit(0)).alias("seq"), *said)


def fold_patches(patches: DataFrame) -> DataFrame:
    """Patches (id, owner_id, patch, seq) as one patch a note: for each field that any of them names, its last value, null included."""
    turn = lambda c: F.when(F.map_contains_key("patch", c), _turn(patches, F.try_element_at("patch", F.lit(c)).alias("value")))
    last = patches.groupBy("id", "owner_id").agg(*(F.max(turn(c)).alias(c) for c in PATCHABLE))
    entries = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"{c}.value").alias("value"))) for c in PATCHABLE))
    return last.select("id", "owner_id", F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("patch"))


def patch_notes(notes: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (id, owner_id, patch: map<string,string>, seq) set the fields that they name, to null too; only an owner's patch counts."""
    rows = notes.join(fold_patches(patches), ["id", "owner_id"], "left")
    empty = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("patch", F.coalesce("patch", empty))
    return rows.withColumns({c: T.patched(F.col("patch"), c, F.col(c)) for c in PATCHABLE}).drop("patch")


def accept_reprocess(notes: DataFrame, results: DataFrame) -> DataFrame:
    """Write the structured text of accepted results (id, owner_id, structured_text, seq), the last of a note's; the transcript stays as it was."""
    patch = F.create_map(F.lit("structured_text"), F.col("structured_text"))
    return patch_notes(notes, results.select(patch.alias("patch"), *(c for c in ("id", "owner_id", "seq") if c in results.columns)))


def patch_notebooks(notebooks: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Patches (id, owner_id, name, color, seq): null leaves a field as it is; the notebook counts as updated in any case."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), _turn(patches, F.col(c).alias("value"))))["value"].alias(f"_{c}")
    p = patches.groupBy("id", "owner_id").agg(last("name"), last("color"), F.lit(True).alias("_hit"))
    rows = notebooks.join(p, ["id", "owner_id"], "left")
    changed = {"name": F.coalesce("_name", "name"), "color": F.coalesce("_color", "color"), "updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))}
    return rows.withColumns(changed).drop("_name", "_color", "_hit")


def create_notebooks(notebooks: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    rows = next_ids(new, notebooks, "name").withColumn("color", F.coalesce(T.first_filled("color"), F.lit(COLOR)))
    return notebooks.unionByName(rows.withColumn("updated_at", as_of), allowMissingColumns=True)


def touched(notebooks: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    hit = ids.select(F.col("notebook_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return notebooks.join(hit, "id", "left").withColumn("updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))).drop("_hit")


def add_members(requests: DataFrame, notebooks: DataFrame, notes: DataFrame, bridge: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New (notebooks, bridge): a membership that exists is left alone and touches nothing."""
    added = library.membership_to_add(requests, notebooks, notes, bridge).where("outcome = 'add'").select("note_id", "notebook_id")
    return touched(notebooks, added, as_of), bridge.select("note_id", "notebook_id").union(added)


def remove_members(requests: DataFrame, notebooks: DataFrame, bridge: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New (notebooks, bridge): an owner's notebook is touched whether the note was in it or not."""
    own = requests.join(notebooks.select(F.col("id").alias("notebook_id"), "owner_id"), ["notebook_id", "owner_id"], "left_semi")
    return touched(notebooks, own, as_of), bridge.join(own, ["note_id", "notebook_id"], "left_anti").select("note_id", "notebook_id")


def _valid(asked: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Asked rows (key, owner_id), each once, that are rows of the owner in the table."""
    return asked.select(key, "owner_id").distinct().join(table.select(F.col("id").alias(key), "owner_id"), [key, "owner_id"], "left_semi")


def add_every_member(asked_notes: DataFrame, asked_books: DataFrame, notebooks: DataFrame, notes: DataFrame, bridge: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """As add_members, for requests by owner: each asked note (note_id, owner_id) goes into each of the asked notebooks (notebook_id, owner_id) of its owner.

    The pairs are not listed to be checked: notes and notebooks are checked by themselves, and a notebook is touched if it
    has fewer of the asked notes than there are.
    """
    mine, books = _valid(asked_notes, "note_id", notes), _valid(asked_books, "notebook_id", notebooks)
    added = library.pairs_but(books, mine, bridge).select("note_id", "notebook_id")
    have = bridge.select("note_id", "notebook_id").distinct().join(books, "notebook_id").join(mine, ["note_id", "owner_id"])
    lacking = books.join(mine.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_asked")), "owner_id").join(have.groupBy("notebook_id", "owner_id").agg(F.count(F.lit(1)).alias("_have")), ["notebook_id", "owner_id"], "left")
    return touched(notebooks, lacking.where(F.col("_asked") > F.coalesce("_have", F.lit(0))), as_of), bridge.select("note_id", "notebook_id").union(added)


def remove_every_member(asked_notes: DataFrame, asked_books: DataFrame, notebooks: DataFrame, bridge: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """As remove_members, for requests by owner: each asked note (note_id, owner_id) leaves each of the asked notebooks (notebook_id, owner_id) of its owner."""
    mine = asked_notes.select("note_id", "owner_id").distinct()
    books = _valid(asked_books, "notebook_id", notebooks).join(mine.select("owner_id").distinct(), "owner_id", "left_semi")
    gone = bridge.join(books, "notebook_id").join(mine, ["note_id", "owner_id"], "left_semi").select("note_id", "notebook_id")
    return touched(notebooks, books, as_of), bridge.join(gone, ["note_id", "notebook_id"], "left_anti").select("note_id", "notebook_id")


def share_notes(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, owner_id, token, seq): a note that has a token keeps it, else it takes the first one."""
    first = requests.where("token is not null").groupBy("id", "owner_id").agg(F.min(_turn(requests, F.col("token")))["token"].alias("token"))
    rows = notes.join(first, ["id", "owner_id"], "left")
    token = F.when(F.col("token").isNotNull(), F.coalesce(T.first_filled("share_token"), F.col("token"))).otherwise(F.col("share_token"))
    return rows.withColumn("share_token", token).drop("token")


def unshare_notes(notes: DataFrame, requests: DataFrame) -> DataFrame:
    hit = requests.select("id", "owner_id").distinct().withColumn("_hit", F.lit(True))
    rows = notes.join(hit, ["id", "owner_id"], "left")
    return rows.withColumn("share_token", F.when(F.col("_hit").isNull(), F.col("share_token"))).drop("_hit")


def delete_notes(keys: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the notes of keys (id, owner_id) and without all that depends on them; cards go with their sets."""
    gone = tables["notes"].join(keys, ["id", "owner_id"], "left_semi").select(F.col("id").alias("note_id"))
    out = dict(tables) | {"notes": tables["notes"].join(gone.withColumnRenamed("note_id", "id"), "id", "left_anti")}
    for name in ("note_notebooks", "flashcard_sets", "ai_summaries", "ai_explanations"):
        if name in tables:
            out[name] = tables[name].join(gone, "note_id", "left_anti")
    if "flashcards" in tables:
        sets = tables["flashcard_sets"].join(gone, "note_id", "left_semi").select(F.col("id").alias("set_id"))
        out["flashcards"] = tables["flashcards"].join(sets, "set_id", "left_anti")
    return out


def delete_notebooks(keys: DataFrame, notebooks: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (notebooks, bridge); notes stay."""
    gone = notebooks.join(keys, ["id", "owner_id"], "left_semi").select("id")
    return notebooks.join(gone, "id", "left_anti"), bridge.join(gone.withColumnRenamed("id", "notebook_id"), "notebook_id", "left_anti")


def replace_flashcards(made: DataFrame, sets: DataFrame, cards: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New (sets, cards) from made sets (note_id, owner_id, note_title, regenerate, cards, seq): older sets go only where regenerate is set.

    Sets of the same batch with a smaller number than a note's last regenerated one are older, too.
    """
    if "seq" in made.columns:
        latest = made.where("regenerate").groupBy("note_id", "owner_id").agg(F.max("seq").alias("_latest"))
        made = made.join(latest, ["note_id", "owner_id"], "left").where(F.coalesce(F.col("seq") >= F.col("_latest"), F.lit(True))).drop("_latest")
    again = made.where("regenerate").select("note_id", "owner_id").distinct()
    old = sets.join(again, ["note_id", "owner_id"], "left_semi").select(F.col("id").alias("set_id"))
    kept_sets = sets.join(old.withColumnRenamed("set_id", "id"), "id", "left_anti")
    kept_cards = cards.join(old, "set_id", "left_anti")
    new = next_ids(made, sets, "note_id").withColumns({"title": T.set_title("note_title"), "created_at": as_of})
    listed = new.select(F.col("id").alias("set_id"), F.posexplode("cards").alias("place", "card")).select("set_id", "place", "card.question", "card.answer")
    new_cards = next_ids(listed.withColumn("_at", F.struct("set_id", "place")), cards, "_at").drop("place", "_at")
    return kept_sets.unionByName(new.select(sets.columns)), kept_cards.unionByName(new_cards.select(cards.columns))


def store_summary(notes: DataFrame, made: DataFrame) -> DataFrame:
    """Write summaries (id, owner_id, summary, seq) over what the notes had, the last of each note's."""
    last = made.where("summary is not null").groupBy("id", "owner_id").agg(F.max(_turn(made, F.col("summary")))["summary"].alias("_new"))
    rows = notes.join(last, ["id", "owner_id"], "left")
    return rows.withColumn("ai_summary", F.coalesce("_new", "ai_summary")).drop("_new")


def append_explanations(explanations: DataFrame, made: DataFrame, as_of: Column) -> DataFrame:
    """Keep explanations of highlights that belong to a note; others are answered but not stored."""
    rows = next_ids(made.where("note_id is not null"), explanations, "note_id").withColumn("created_at", as_of)
    return explanations.unionByName(rows.select(explanations.columns))


def store_categories(notes: DataFrame, made: DataFrame) -> DataFrame:
    """Write subject, topic and tags (id, owner_id, subject, topic, tags, seq) where an owner's note got them, the last of each note's; the status stays."""
    fields = ("subject", "topic", "tags")
    last = made.groupBy("id", "owner_id").agg(F.max(_turn(made, *map(F.col, fields))).alias("_new"))
    rows = notes.join(last, ["id", "owner_id"], "left")
    return rows.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fields}).drop("_new")
