"""Queries over texts, HTML and model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.functions import modeljson as J
from noteframe.functions import text as T
from noteframe.operators import enrich
from noteframe.plans.define import query
from noteframe.plans.fixtures import Tables
from noteframe.sources import export

WORD, ASCII_WORD = (w.replace("'", "''") for w in (T.WORD, T.ASCII_WORD))
WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"select doc_id, len(regexp_extract_all(text, '{WORD}')) as words, len(regexp_extract_all(text, '{ASCII_WORD}')) as ascii_words from documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count("text").cast("long").alias("words"), T.ascii_word_count("text").cast("long").alias("ascii_words"))


@query(r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as tokens, length(text) as chars from documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_count("text").cast("long").alias("tokens"), T.char_count("text").cast("long").alias("chars"))


@query("select page_id, " + WS.format("regexp_replace(replace(replace(replace(replace(html, '<br>', ' '), '<br/>', ' '), '<br />', ' '), '&nbsp;', ' '), '<[^>]+>', ' ', 'g')") + " as text from pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.html_to_text("html").alias("text"))


@query("select note_id, " + WS.format("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g')") + " as text from html_notes")
def strip_html(t: Tables) -> DataFrame:
    return t.html_notes.select("note_id", T.strip_html("html").alias("text"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#039;') as escaped from pages")
def escape_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.escape_html("html").alias("escaped"))


_LATE = r"string_split(x, '\')[-1]"
_INNER = f"case when contains({_LATE}, chr(1) || 'b') then substr({_LATE}, instr({_LATE}, chr(1) || 'b') + 2) else '' end"
_BLANKS = " || ".join(f"chr({ord(c)})" for c in T.WHITE)


@query(
    "with doubled as (select note_id, string_split(html, '$$') as p from html_notes), "
    "shown as (select note_id, list_filter(p[1:len(p) - 1], lambda x, i: i % 2 = 0) as shown, array_to_string(list_filter(p, lambda x, i: i % 2 = 1), '') || case when len(p) % 2 = 0 then '$$' || p[-1] else '' end as rest from doubled), "
    r"signs as (select *, array_to_string(list_transform(string_split(replace(rest, chr(1), chr(1) || 'a'), '$'), lambda x: x || case when (length(x) - length(rtrim(x, '\'))) % 2 = 1 then chr(1) || 'b' else '$' end), '') as coded from shown), "
    r"segments as (select *, string_split(regexp_replace(replace(case when ends_with(coded, '$') then coded[:-2] else coded[:-3] end, '\\', chr(1) || 'd'), '\\([^\n\r\x{2028}\x{2029}])', chr(1) || 'c\1', 'g'), '$') as s from signs), "
    "judged as (select *, list_transform(s[1:len(s) - 1], lambda x, i: case when s[i + 1] = '' and i + 1 < len(s) then 'x' "
    rf"when i > 1 and x <> '' and (i = 2 or s[i - 1] <> '') and not ends_with(s[i - 1], chr(1) || 'b') and not contains(x, '\') then case when {_INNER} <> '' then 'N' else 'A' end when {_INNER} <> '' then 'M' else 'x' end) as letters from segments), "
    r"settled as (select *, replace(regexp_replace(array_to_string(letters, ''), '([MN])A', '\1x', 'g'), 'AA', 'Ax') as f from judged), "
    f"found as (select *, list_transform(s[1:len(s) - 1], lambda x, i: case when f[i] = 'A' or (f[i] = 'N' and f[i - 1] = 'x') then x when f[i] <> 'x' then {_INNER} end) as inline from settled) "
    r"select note_id, list_transform(list_concat(shown, list_transform(list_filter(inline, lambda x: x is not null), lambda x: replace(replace(replace(replace(x, chr(1) || 'd', '\\'), chr(1) || 'c', '\'), chr(1) || 'b', '$'), chr(1) || 'a', chr(1)))), "
    f"lambda x: trim(x, {_BLANKS})) as formulas from found"
)
def formulas(t: Tables) -> DataFrame:
    return t.html_notes.select("note_id", T.extract_formulas("html").alias("formulas"))


_SPAN = r"""(?is)<span[^>]*style=["''](background[^"''>]*)["''][^>]*>(.*?)</span>"""
_CLEAR = r"(?i)background(-color)?:\s*(transparent|rgba\(0,\s*0,\s*0,\s*0\))"


@query(
    "select note_id, list_filter(texts, lambda x, i: x <> '' and list_position(texts, x) = i) as highlights from (select note_id, list_transform(list_filter(list_zip(styles, inner_html), "
    f"lambda z: not regexp_matches(z[1], '{_CLEAR}')), lambda z: trim(regexp_replace(regexp_replace(regexp_replace(z[2], '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '\\s+', ' ', 'g'))) as texts "
    f"from (select note_id, regexp_extract_all(html, '{_SPAN}', 1) as styles, regexp_extract_all(html, '{_SPAN}', 2) as inner_html from html_notes))"
)
def highlights(t: Tables) -> DataFrame:
    return t.html_notes.select("note_id", T.extract_highlights("html").alias("highlights"))


@query(
    "select note_id, case when spot > 0 then substr(raw, greatest(1, spot - 300), spot + length(h) + 300 - greatest(1, spot - 300)) else substr(raw, 1, 600) end as context from "
    "(select note_id, raw, h, instr(lower(raw), lower(h)) as spot from (select e.note_id, coalesce(n.raw_text, '') as raw, case when e.note_id % 2 = 0 then substr(coalesce(n.raw_text, ''), 401, 9) else 'no such text' end as h from ai_explanations e join notes n on n.id = e.note_id))"
)
def highlight_context(t: Tables) -> DataFrame:
    rows = t.ai_explanations.select("note_id").join(t.notes.select(F.col("id").alias("note_id"), "raw_text"), "note_id")
    h = F.expr("case when note_id % 2 = 0 then substr(coalesce(raw_text, ''), 401, 9) else 'no such text' end")
    return rows.select("note_id", T.highlight_context("raw_text", h).alias("context"))


@query(
    "select id, coalesce(nullif(title, ''), case when k > 1 then concat(image_filename, ' (+', k - 1, ' pages)') else image_filename end) as note_title, concat('Flashcards for ', coalesce(title, 'None')) as set_title, "
    "case when length(raw_text) > 80 then concat(substr(raw_text, 1, 80), '...') else raw_text end as short, case when contains(coalesce(image_filename, ''), '.') then regexp_extract(image_filename, '[^.]*$') else 'jpg' end as ext, "
    "strftime(created_at, '%b %-d, %Y') as created, strftime(created_at, '%b %-d, %Y, %-I:%M %p') as created_time, strftime(created_at, '%B %-d, %Y') as created_long from (select *, id % 3 as k from notes)"
)
def titles(t: Tables) -> DataFrame:
    return t.notes.select(
        "id",
        T.note_title("title", "image_filename", F.col("id") % 3).alias("note_title"),
        T.set_title("title").alias("set_title"),
        T.ellipsis("raw_text", 80).alias("short"),
        T.file_ext("image_filename").alias("ext"),
        T.fmt_date("created_at").alias("created"),
        T.fmt_date("created_at", "time").alias("created_time"),
        T.fmt_date("created_at", "long").alias("created_long"),
    )


_SQL = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_BODY = "coalesce(nullif(structured_text, ''), nullif(raw_text, ''), '')"
_SHOWN = f"case when contains({_BODY}, '<') and contains({_BODY}, '>') then {_BODY} else replace({_BODY}, chr(10), '<br>') end"
_HEAD = "<!DOCTYPE html>\n<html>\n<head>\n  <title>"
_STYLE = "</title>\n  <style>\n    body { font-family: Georgia, serif; max-width: 800px; margin: 40px auto; padding: 20px; line-height: 1.75; }\n    h1 { color: #5D4037; }\n  </style>\n</head>\n<body>\n  <h1>"
_FOOT = "</div>\n</body>\n</html>"


@query(
    r"select id, regexp_replace(regexp_replace(regexp_replace(body, '(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '(?i)&nbsp;', ' ', 'g') as txt, "
    f"concat({_SQL(_HEAD)}, coalesce(nullif(title, ''), 'Note'), {_SQL(_STYLE)}, coalesce(nullif(title, ''), 'Untitled Note'), {_SQL('</h1>' + chr(10) + '  <div>')}, body, {_SQL(_FOOT)}) as html from (select *, {_SHOWN} as body from notes)"
)
def exported_notes(t: Tables) -> DataFrame:
    """The files that the exports write, as rows."""
    return t.notes.select("id", export.export_text().alias("txt"), export.export_page().alias("html"))


_S = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '^\s+|\s+$', '', 'g'), '^```(json)?\s*', ''), '\s*```$', ''), '^\s+|\s+$', '', 'g')"
_REPAIR = (
    r"case when starts_with(s, '[') and not ends_with(s, ']') then case when regexp_extract(s, '(?s)^(.*\})', 1) <> '' then concat(regexp_extract(s, '(?s)^(.*\})', 1), ']') else '[]' end "
    r"when starts_with(s, '{') and not ends_with(s, '}') then concat(regexp_replace(s, '[,\s]+$', ''), '}') else s end"
)


@query(f"select conv_id, {_REPAIR} as repaired from (select conv_id, {_S} as s from model_responses)")
def repair_json(t: Tables) -> DataFrame:
    return t.model_responses.select("conv_id", J.repair_json("response").alias("repaired"))


@query(
    "select note_id, cast(k - 1 as int) as place, coalesce(json_extract_string(a, concat('$[', k - 1, '].question')), '') as question, coalesce(json_extract_string(a, concat('$[', k - 1, '].answer')), '') as answer from "
    "(select note_id, a, unnest(range(1, 1 + cast(json_array_length(a) as int))) as k from (select conv_id as note_id, case when kind in (0, 1) then j when kind = 2 then json_extract(j, '$.cards') when kind = 3 then json_extract(j, '$.items') end as a from "
    f"(select conv_id, kind, case when kind < 4 then cast({_REPAIR} as json) end as j from (select conv_id, kind, {_S} as s from model_responses))) where a is not null)"
)
def parse_flashcards(t: Tables) -> DataFrame:
    return enrich.read_flashcards(t.model_responses.withColumnRenamed("conv_id", "note_id"))


@query(
    "select conv_id as note_id, s as subject, case when conv_id % 3 = 0 then '' else 'maths' end as topic, case when conv_id % 3 = 0 then '' else 'a, b' end as tags from (select conv_id, regexp_replace(response, '[^A-Za-z ]', '', 'g') as s from model_responses)"
)
def parse_categories(t: Tables) -> DataFrame:
    s = "regexp_replace(response, '[^A-Za-z ]', '')"
    made = t.model_responses.selectExpr("conv_id as note_id", f"""concat('```json\n{{"subject": "', {s}, case when conv_id % 3 = 0 then '"' else '", "topic": "maths", "tags": ["a", "b"]}}\n```' end) as response""")
    return enrich.read_categories(made)



@query(
    f"select id as note_id, 'flashcards' as kind, {_SQL(enrich.SYSTEM['flashcards'])} as system, concat({_SQL(enrich.ASK['flashcards'])}, substr(raw_text, 1, 4000)) as \"user\" from notes where raw_text is not null and raw_text <> '' "
    f"union all select id, 'summary', {_SQL(enrich.SYSTEM['summary'])}, concat({_SQL(enrich.ASK['summary'])}, substr(raw_text, 1, 4000)) from notes where raw_text is not null and raw_text <> '' "
    f"union all select id, 'explain', {_SQL(enrich.SYSTEM['explain'])}, concat('Explain this: ''', substr(title, 1, 500), '''', chr(10), chr(10), 'Context from the note:', chr(10), substr(coalesce(raw_text, ''), 1, 2000)) from notes where title is not null"
)
def build_requests(t: Tables) -> DataFrame:
    from noteframe.operators.library import enrichable

    explain = t.notes.where("title is not null").select("id", F.col("title").alias("highlighted_text"), F.col("raw_text").alias("context"))
    found = [enrich.build_requests(enrichable(t.notes), kind) for kind in ("flashcards", "summary")]
    return found[0].union(found[1]).union(enrich.build_requests(explain, "explain"))


@query(
    "select id as note_id, 'categories' as kind, case when n % 7 <> 0 then concat('{\"subject\": \"len ', n, '\", \"topic\": \"\", \"tags\": []}') end as response, case when n % 7 = 0 then 3 else 1 end as attempts, "
    f"case when n % 7 = 0 then 'model unavailable' end as error from (select id, {len(enrich.ASK['categories'])} + least(4000, length(raw_text)) as n from notes where raw_text is not null)"
)
def enriched_notes(t: Tables) -> DataFrame:
    """The whole batch with a stand-in for the model that fails on every third note's first try and always on some."""
    requests = enrich.build_requests(t.notes.where("raw_text is not null"), "categories")
    return enrich.enrich(requests, _stub, wait=0.0).select("note_id", "kind", "response", "attempts", "error")


def _stub(system: str, user: str) -> str:
    if len(user) % 7 == 0:
        raise ValueError("model unavailable")
    return f'{{"subject": "len {len(user)}", "topic": "", "tags": []}}'


@query("select id, array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ', ') as tags from notes")
def joined_tags(t: Tables) -> DataFrame:
    return t.notes.select("id", T.join_tags(T.split_tags("tags")).alias("tags"))


@query(
    "select n.note_id, list_filter(every, lambda x, i: list_position(every, x) = i) as highlights from (select h.note_id, list_concat(h.texts, coalesce(e.texts, [])) as every from "
    f"(select note_id, list_filter(list_transform(list_filter(list_zip(regexp_extract_all(html, '{_SPAN}', 1), regexp_extract_all(html, '{_SPAN}', 2)), lambda z: not regexp_matches(z[1], '{_CLEAR}')), "
    "lambda z: trim(regexp_replace(regexp_replace(regexp_replace(z[2], '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') as texts from html_notes) h "
    "left join (select note_id, list(highlighted_text order by id) as texts from ai_explanations group by note_id) e on e.note_id = h.note_id) n"
)
def all_highlights(t: Tables) -> DataFrame:
    """Highlights that a note has now, then those that were explained before and are no longer marked."""
    stored = t.ai_explanations.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "highlighted_text"))), lambda x: x["highlighted_text"]).alias("cached"))
    rows = t.html_notes.join(stored, "note_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("note_id", enrich.all_highlights(T.extract_highlights("html"), F.coalesce("cached", none)).alias("highlights"))
