"""Queries over notes, notebooks and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.functions import text as T
from noteframe.operators import library as L
from noteframe.plans.define import query
from noteframe.plans.fixtures import Tables

#: Expressions that the statements share.
BLANK = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
HAS_TEXT = f"({BLANK.format('raw_text')} <> '' or {BLANK.format('structured_text')} <> '')"
PUBLIC = f"case when status = 'failed' and {HAS_TEXT} then 'needs_review' else status end"
STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '\s+', ' ', 'g'))"
EXTRACTED = STRIPPED.format(f"coalesce(nullif({BLANK.format('raw_text')}, ''), nullif({BLANK.format('structured_text')}, ''), '')")
ASCII_WORDS = f"len(regexp_extract_all(t, '{T.ASCII_WORD.replace(chr(39), chr(39) * 2)}'))"
THIN = f"(t <> '' and {ASCII_WORDS} < 18 and length(t) < 120)"
TAGS = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
BODY = "coalesce(nullif(structured_text, ''), nullif(raw_text, ''), '{0}')"
DISPLAY = f"case when contains({BODY}, '<') and contains({BODY}, '>') then {BODY} else replace({BODY}, chr(10), '<br>') end"


def _search(q: str) -> str:
    return " or ".join(f"{c} ilike '%{q}%' escape '\\'" for c in L.SEARCHED)


@query(f"select id, owner_id, title, subject, topic, tags, {PUBLIC} as status, image_filename, created_at from notes where {_search('the')}")
def search_notes(t: Tables) -> DataFrame:
    return L.list_view(L.search_notes(t.notes, "the"))


@query(f"select id, title, subject, topic from notes where ({_search('_nd%')}) and subject = 'en' and topic = 'src1'")
def search_notes_subject(t: Tables) -> DataFrame:
    return L.search_notes(t.notes, "_nd%", "en", "src1").select("id", "title", "subject", "topic")


@query("select id, title, subject, tags from notes where contains(lower(coalesce(title, '')), 'e 1') or contains(lower(coalesce(subject, '')), 'e 1') or contains(lower(coalesce(tags, '')), 'e 1')")
def search_client(t: Tables) -> DataFrame:
    return L.search_client(t.notes, "E 1").select("id", "title", "subject", "tags")


@query(f"select id, tags from notes where list_contains({TAGS}, 'long')")
def notes_with_tag(t: Tables) -> DataFrame:
    return L.with_tag(t.notes, "long").select("id", "tags")


@query(f"select id, owner_id, title, {PUBLIC} as status, created_at from notes order by created_at desc nulls first, id desc limit 100 offset 100")
def list_notes_page(t: Tables) -> DataFrame:
    return L.list_view(L.list_notes(t.notes, 100, 100)).select("id", "owner_id", "title", "status", "created_at")


@query("select id, owner_id, position from (select id, owner_id, cast(row_number() over (partition by owner_id order by created_at desc nulls first, id desc) as int) as position from notes) where position between 3 and 12")
def notes_page_per_owner(t: Tables) -> DataFrame:
    return L.page_per_owner(t.notes, 2, 10).select("id", "owner_id", "position")


@query("select id, name, owner_id, color, updated_at from notebooks where owner_id = 7")
def list_notebooks(t: Tables) -> DataFrame:
    return L.list_notebooks(L.for_owner(t.notebooks, 7)).select("id", "name", "owner_id", "color", "updated_at")


@query("select r.id, r.owner_id, n.title, n.id is not null as found from (select id, (id + case when id % 4 = 0 then 1 else 0 end) % 50 as owner_id from notes where id % 3 = 0) r left join notes n on n.id = r.id and n.owner_id = r.owner_id")
def get_notes(t: Tables) -> DataFrame:
    requests = t.notes.where("id % 3 = 0").selectExpr("id", "(id + case when id % 4 = 0 then 1 else 0 end) % 50 as owner_id")
    return L.get_notes(t.notes, requests).select("id", "owner_id", "title", "found")


@query(f"select {PUBLIC} as status, count(*) as notes from notes group by 1")
def public_status_counts(t: Tables) -> DataFrame:
    return t.notes.select(L.public_status().alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("notes"))


_CASE = f"case when status = 'failed' and t = '' then 'failed' when status = 'failed' then 'recovered' when t = '' then 'no_text' when {THIN} then 'incomplete' else 'success' end"
_KIND = "case when c in ('failed', 'success') then c else 'warning' end"
_MESSAGE = "case c " + " ".join("when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in L.FEEDBACK.items()) + " end"


@query(f"select {_KIND} as kind, {_MESSAGE} as message, case when c = 'success' then 3000 else 5000 end as timeout_ms, count(*) as notes from (select {_CASE} as c from (select status, {EXTRACTED} as t from notes)) group by all")
def upload_feedback_counts(t: Tables) -> DataFrame:
    return L.upload_feedback(t.notes).groupBy("kind", "message", "timeout_ms").agg(F.count(F.lit(1)).alias("notes"))


@query(f"select id, t as extracted, {THIN} as incomplete from (select id, {EXTRACTED} as t from notes)")
def likely_incomplete(t: Tables) -> DataFrame:
    rows = t.notes.select("id", L.extracted_text().alias("extracted"))
    return rows.withColumn("incomplete", L.is_likely_incomplete(F.col("extracted")))


@query(
    f"select id, image_filename is not null and image_filename <> '' and (status = 'failed' or {THIN}) as reprocess, "
    f"case when status = 'failed' and h then 'unreliable' when status = 'failed' then 'failed' when {THIN} then 'thin' else 'optional' end as reason "
    f"from (select id, status, image_filename, {HAS_TEXT} as h, {EXTRACTED} as t from notes)"
)
def should_reprocess(t: Tables) -> DataFrame:
    return L.should_reprocess(t.notes)


@query("select owner_id, coalesce(list_sort(list_distinct(list(nullif(subject, '')))), []) as subjects, coalesce(list_sort(list_distinct(list(nullif(topic, '')))), []) as topics from notes group by owner_id".replace("list(nullif(subject, ''))", "list(subject) filter (subject <> '')").replace("list(nullif(topic, ''))", "list(topic) filter (topic <> '')"))
def facets_subject_topic(t: Tables) -> DataFrame:
    return L.facets(t.notes)


@query(f"select owner_id, list_sort(list_distinct(list(tag))) as tags from (select owner_id, unnest({TAGS}) as tag from notes) group by owner_id")
def tag_facet(t: Tables) -> DataFrame:
    return L.tag_facet(t.notes)


@query(f"select owner_id, tag, count(*) as note_count from (select owner_id, unnest(list_distinct({TAGS})) as tag from notes) group by owner_id, tag")
def tag_counts(t: Tables) -> DataFrame:
    return L.tag_counts(t.notes)


@query("select id, list_transform(string_split(coalesce(tags, ''), ',')[1:2], lambda x: trim(x)) as preview from notes")
def tag_preview(t: Tables) -> DataFrame:
    return t.notes.select("id", T.tag_preview("tags").alias("preview"))


@query("select b.id, b.name, b.owner_id, count(m.note_id) as note_count from notebooks b left join note_notebooks m on m.notebook_id = b.id group by b.id, b.name, b.owner_id")
def notebook_counts(t: Tables) -> DataFrame:
    return L.notebook_counts(t.notebooks, t.note_notebooks).select("id", "name", "owner_id", "note_count")


@query(
    "select notebook_id, owner_id, name, (place - 1) // 5 as page, list(note_id order by place) as note_ids, any_value(n) as note_count from (select b.id as notebook_id, b.owner_id, b.name, n.id as note_id, count(*) over (partition by b.id) as n, "
    "row_number() over (partition by b.id order by n.created_at desc, n.id desc) as place from note_notebooks m join notebooks b on m.notebook_id = b.id join notes n on m.note_id = n.id and n.owner_id = b.owner_id) group by all"
)
def notebook_notes(t: Tables) -> DataFrame:
    """Pages of five notes."""
    rows = L.notebook_notes(t.notebooks, t.note_notebooks, t.notes, 5)
    return rows.select("notebook_id", "owner_id", "name", "page", F.col("notes.note_id").alias("note_ids"), "note_count")


@query("select b.id as notebook_id, n.id as note_id, b.owner_id, n.title from notebooks b join notes n on n.owner_id = b.owner_id where not exists (select 1 from note_notebooks m where m.note_id = n.id and m.notebook_id = b.id)")
def notes_not_in_notebook(t: Tables) -> DataFrame:
    """Every notebook is asked for, some also by a stranger."""
    requests = t.notebooks.selectExpr("id as notebook_id", "owner_id").union(t.notebooks.where("id % 3 = 0").selectExpr("id", "owner_id + 1"))
    return L.notes_not_in_notebook(requests, t.notebooks, t.note_notebooks, t.notes)


@query(
    f"select n.share_token, n.id, n.title, u.username as owner_name, {DISPLAY.format('<em>No content</em>')} as body, {TAGS} as tags "
    "from notes n left join users u on u.id = n.owner_id where n.share_token is not null"
)
def shared_view(t: Tables) -> DataFrame:
    return L.shared_view(t.notes, t.users)


@query(f"select id, owner_id, title, raw_text, structured_text, ai_summary, subject, topic, tags, {PUBLIC} as status, image_filename, share_token, created_at from notes")
def full_view(t: Tables) -> DataFrame:
    return L.full_view(t.notes)


@query(f"select id, title, raw_text, structured_text, {PUBLIC} as status from notes")
def text_view(t: Tables) -> DataFrame:
    return L.text_view(t.notes)


@query(f"select id, {DISPLAY.format('')} as body from notes")
def display_body(t: Tables) -> DataFrame:
    return t.notes.select("id", L.display_body().alias("body"))


@query("select s.id, s.note_id, s.owner_id, s.title, coalesce(list(c.question order by c.id) filter (c.id is not null), []) as questions from flashcard_sets s left join flashcards c on c.set_id = s.id group by all")
def flashcard_sets_nested(t: Tables) -> DataFrame:
    rows = L.flashcard_sets_nested(t.flashcard_sets, t.flashcards)
    return rows.select("id", "note_id", "owner_id", "title", F.col("cards.question").alias("questions"))


@query("select id, note_id, owner_id, cast(row_number() over (partition by owner_id, note_id order by created_at desc nulls first, id desc) as int) as position from (select id, note_id % 40 as note_id, owner_id, created_at from ai_explanations)")
def explanations_for_note(t: Tables) -> DataFrame:
    rows = t.ai_explanations.withColumn("note_id", F.col("note_id") % 40)
    return L.explanations_for_note(rows).select("id", "note_id", "owner_id", "position")


@query("select owner_id as batch, count(*) as total, count(*) filter (status <> 'failed') as uploaded from notes group by owner_id")
def batch_outcome(t: Tables) -> DataFrame:
    return L.batch_outcome(t.notes, F.col("owner_id"))


@query("select id, case when lang in ('default', 'lecture', 'meeting') then lang else 'default' end as note_type from (select doc_id as id, case doc_id % 4 when 0 then 'lecture' when 1 then 'meeting' when 2 then 'poem' end as lang from documents)")
def note_types(t: Tables) -> DataFrame:
    asked = F.expr("case doc_id % 4 when 0 then 'lecture' when 1 then 'meeting' when 2 then 'poem' end")
    return t.documents.select(F.col("doc_id").alias("id"), L.validate_note_type(asked).alias("note_type"))


@query("select id, title from notes where id % 10 <> 3 union all select id + 1000000, title from notes where id % 10 = 4")
def replaced_rows(t: Tables) -> DataFrame:
    kept = L.remove_rows(t.notes.select("id", "title"), t.notes.where("id % 10 = 3"))
    return L.prepend_rows(kept, t.notes.where("id % 10 = 4").selectExpr("id + 1000000 as id", "title"))


@query(
    "select r.owner_id, r.notebook_id, r.note_id, case when b.id is null then 'no_notebook' when n.id is null then 'no_note' when m.note_id is not null then 'member' else 'add' end as outcome "
    "from (select distinct n.owner_id, b.id as notebook_id, n.id + case when n.id % 5 = 0 then 1 else 0 end as note_id from notes n join notebooks b on b.id = (n.id % 40) + n.owner_id where n.id % 2 = 0) r "
    "left join notebooks b on b.id = r.notebook_id and b.owner_id = r.owner_id left join notes n on n.id = r.note_id and n.owner_id = r.owner_id "
    "left join note_notebooks m on m.note_id = r.note_id and m.notebook_id = r.notebook_id"
)
def membership_requests(t: Tables) -> DataFrame:
    n, b = t.notes.where("id % 2 = 0"), t.notebooks.select(F.col("id").alias("notebook_id"))
    requests = n.withColumn("notebook_id", F.col("id") % 40 + F.col("owner_id")).join(b, "notebook_id")
    requests = requests.selectExpr("owner_id", "notebook_id", "id + case when id % 5 = 0 then 1 else 0 end as note_id")
    return L.membership_to_add(requests, t.notebooks, t.notes, t.note_notebooks)
