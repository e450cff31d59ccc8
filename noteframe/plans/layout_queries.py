"""Queries over the elements of pages and over extraction passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.functions import text as T
from noteframe.operators import extract as E
from noteframe.operators import layout as L
from noteframe.plans.define import query
from noteframe.plans.fixtures import Tables
from noteframe.sources import pages
from noteframe.sources.storage import shared_folder, write_files

WORD = T.WORD.replace("'", "''")
META = L.METADATA
CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
TEXT = CLEAN.format("content")
WORDS = f"len(regexp_extract_all({TEXT}, '{WORD}'))"
IS_META = f"({TEXT} <> '' and (regexp_matches(lower({TEXT}), '{META}') or (contains(region, 'right') and y_percent <= 22 and width_percent <= 18 and {WORDS} <= 3)))"
ORDERED = "select *, cast(row_number() over (partition by page_id order by y_percent, x_percent, ord) - 1 as int) as place from ocr_elements"
BANDED = (
    "select *, cast(sum(opens) over (partition by page_id order by place rows unbounded preceding) as int) as band from (select *, case when y_percent >= "
    f"max(y_percent + height_percent) over (partition by page_id order by place rows between unbounded preceding and 1 preceding) + 5 then 1 else 0 end as opens from ({ORDERED}))"
)
STATS = (
    f"select page_id, band, count(*) as elements, count(*) filter (l) as left_elements, count(*) filter (r) as right_elements, count(*) filter (l and not m) as left_content, "
    "count(*) filter (r and not m) as right_content, cast(coalesce(sum(w) filter (l and not m), 0) as bigint) as left_words, cast(coalesce(sum(w) filter (r and not m), 0) as bigint) as right_words, "
    "max(y_percent) - min(y_percent) as y_span, count(*) filter (not l and not r) as centre_elements, min(x_percent) filter (l) as left_x, min(x_percent) filter (r) as right_x "
    f"from (select *, contains(region, 'left') as l, contains(region, 'right') as r, {IS_META} as m, {WORDS} as w from ({BANDED})) group by page_id, band"
)
COLUMNS = (
    "left_content > 0 and right_content > 0 and elements > 1 and case when page_layout = 'single_column' then least(left_words, right_words) >= 6 and y_span <= 10 and centre_elements <= 1 "
    "else least(left_words, right_words) >= 4 and y_span <= 14 end"
)


@query(f"select page_id, ord as listed, place as ord from ({ORDERED})")
def reading_order(t: Tables) -> DataFrame:
    return L.reading_order(t.ocr_elements).select("page_id", "listed", "ord")


def _try(n: int) -> str:
    return f"case when len(ws) >= {n} then nullif(instr(raw, array_to_string(ws[1:{n}], ' ')), 0) end"


@query(
    "select page_id, listed, cast(row_number() over (partition by page_id order by pos nulls last, listed) - 1 as int) as ord from (select page_id, listed, "
    f"case when page_layout = 'single_column' and raw <> '' then coalesce({', '.join(map(_try, (5, 4, 3, 2, 1)))}) end as pos from "
    r"(select e.page_id, e.ord as listed, p.page_layout, lower(regexp_replace(coalesce(p.raw_text, ''), '^\s+|\s+$', '', 'g')) as raw, "
    r"list_filter(regexp_split_to_array(lower(e.content), '\s+'), lambda x: x <> '') as ws from ocr_elements e join ocr_pages p on p.page_id = e.page_id))"
)
def raw_text_order(t: Tables) -> DataFrame:
    rows = t.ocr_elements.withColumn("listed", F.col("ord"))
    return L.raw_text_order(rows, t.ocr_pages).select("page_id", "listed", "ord")


@query(f"select page_id, ord as listed, place as ord, band from ({BANDED})")
def assign_bands(t: Tables) -> DataFrame:
    return L.assign_bands(L.reading_order(t.ocr_elements)).select("page_id", "listed", "ord", "band")


_NEAR = "b.page_id = e.page_id and b.container = 'box' and b.type <> 'diagram' and abs(e.x_percent - b.x_percent) < 20 and abs(e.y_percent - b.y_percent) < 25"
_CONNECTOR = f"e.type = 'diagram' and coalesce(e.shape, 'none') in ('triangle', 'arrow', 'none') and exists (select 1 from ocr_elements b where {_NEAR})"
_DUPLICATE = "e.type = 'diagram' and exists (select 1 from ocr_elements b where b.page_id = e.page_id and b.type <> 'diagram' and b.region = e.region)"


@query(f"select page_id, ord, type, shape from ocr_elements e where not ({_CONNECTOR})")
def drop_connector_shapes(t: Tables) -> DataFrame:
    return L.drop_connector_shapes(t.ocr_elements).select("page_id", "ord", "type", "shape")


@query(f"select page_id, ord, type, region from ocr_elements e where not ({_DUPLICATE})")
def drop_duplicate_region(t: Tables) -> DataFrame:
    return L.drop_duplicate_region_diagrams(t.ocr_elements).select("page_id", "ord", "type", "region")


@query(f"select page_id, ord, type from ocr_elements e where not ({_CONNECTOR}) and not ({_DUPLICATE})")
def clean_elements(t: Tables) -> DataFrame:
    return L.clean_elements(t.ocr_elements).select("page_id", "ord", "type")


@query(f"select page_id, ord, {TEXT} as text, cast({WORDS} as int) as words, {IS_META} as metadata from ocr_elements")
def metadata_elements(t: Tables) -> DataFrame:
    rows = L.complete(t.ocr_elements)
    return rows.select("page_id", "ord", L.element_text().alias("text"), L.element_word_count().alias("words"), L.is_metadata_element().alias("metadata"))


@query(STATS)
def band_stats(t: Tables) -> DataFrame:
    return L.band_stats(L.assign_bands(L.reading_order(t.ocr_elements)))


@query(f"select page_id, band, {COLUMNS} as columns from ({STATS}) join ocr_pages using (page_id)")
def column_bands(t: Tables) -> DataFrame:
    stats = L.band_stats(L.assign_bands(L.reading_order(t.ocr_elements))).join(t.ocr_pages.select("page_id", "page_layout"), "page_id")
    return stats.select("page_id", "band", L.should_render_as_columns(F.col("page_layout")).alias("columns"))


@query(
    "select page_id, band, cast(case when lf <= 0 then 50 else lf end as int) as left_fr, cast(case when rf <= 0 then 50 else rf end as int) as right_fr from "
    f"(select page_id, band, round_even(greatest(20, least(80, right_x)) - left_x, 0) as lf, round_even(100 - greatest(20, least(80, right_x)), 0) as rf from ({STATS}) where left_x is not null and right_x is not null)"
)
def grid_fractions(t: Tables) -> DataFrame:
    stats = L.band_stats(L.assign_bands(L.reading_order(t.ocr_elements))).where("left_x is not null and right_x is not null")
    widths = T.grid_fractions(F.col("left_x"), F.col("right_x"))
    return stats.select("page_id", "band", widths["left_fr"].alias("left_fr"), widths["right_fr"].alias("right_fr"))


def _div(style: str, inner: str) -> str:
    return f"concat('<div style=\"', '{style}', '\">', {inner}, '</div>')"


def _tag(name: str, style: str) -> str:
    return f"concat('<{name} style=\"', '{style}', '\">', {TEXT}, '</{name}>')"


_HEADER, _P = f"font-size: 1.2em; {L.HEADER}", "margin:10px 0;line-height:1.75;font-weight:normal;"
_PAIR = f"case when instr({TEXT}, ':') > 0 then concat('<span style=\"{L.KEY}\">', substr({TEXT}, 1, instr({TEXT}, ':') - 1), ':</span> ', substr({TEXT}, instr({TEXT}, ':') + 1)) else {TEXT} end"
#: The HTML of an element of the view, which has no children, labels or descriptions and is neither large nor bold.
ELEMENT_HTML = (
    f"case type when 'header' then case container when 'box' then {_div(L.BOX, _tag('h2', _HEADER + ' margin:0;'))} when 'circled' then {_div(L.CIRCLED, _tag('h2', _HEADER + ' margin:0;'))} "
    f"when 'underlined' then {_tag('h2', _HEADER + ' ' + L.UNDERLINED)} else {_tag('h2', _HEADER)} end "
    f"when 'bullet_list' then case container when 'box' then {_div(L.BOX, chr(39) * 2)} when 'circled' then {_div(L.CIRCLED, chr(39) * 2)} else {_div('margin:12px 0;', chr(39) * 2)} end "
    f"when 'key_value' then case container when 'box' then {_div(L.BOX, _PAIR)} else {_div('margin:8px 0;line-height:1.75;', _PAIR)} end "
    f"when 'diagram' then {_div(L.DIAGRAM, f"concat('📊 ', {TEXT})")} "
    f"else case container when 'box' then {_div(L.BOX + ' font-weight:normal;line-height:1.75;', TEXT)} when 'circled' then {_div(L.CIRCLED + ' font-weight:normal;line-height:1.75;', TEXT)} "
    f"when 'underlined' then {_tag('p', _P + L.UNDERLINED)} else {_tag('p', _P)} end end"
)


def page_html_sql(pages: str, kept: str = "true") -> str:
    """page_id and html of the pages of a statement (page_id, page_layout, raw_text, ...), of elements e that `kept` lets through."""
    cleaned = f"select * from ({ORDERED}) e where not ({_CONNECTOR}) and not ({_DUPLICATE}) and {kept}"
    found = (
        r"select e.* exclude (place), e.place as o, p.page_layout, lower(regexp_replace(coalesce(p.raw_text, ''), '^\s+|\s+$', '', 'g')) as raw, "
        rf"list_filter(regexp_split_to_array(lower(e.content), '\s+'), lambda x: x <> '') as ws from ({cleaned}) e join ({pages}) p on p.page_id = e.page_id"
    )
    placed = f"select *, case when page_layout = 'single_column' and raw <> '' then coalesce({', '.join(map(_try, (5, 4, 3, 2, 1)))}) end as pos from ({found})"
    ordered = f"select * exclude (pos), row_number() over (partition by page_id order by pos nulls last, o) as place from ({placed})"
    opened = f"select *, case when y_percent >= max(y_percent + height_percent) over (partition by page_id order by place rows between unbounded preceding and 1 preceding) + 5 then 1 else 0 end as opens from ({ordered})"
    banded = f"select *, sum(opens) over (partition by page_id order by place rows unbounded preceding) as band from ({opened})"
    items = f"select page_id, band, place, type, page_layout, y_percent, x_percent, contains(region, 'left') as l, contains(region, 'right') as r, {IS_META} as m, {WORDS} as w, {ELEMENT_HTML} as html from ({banded})"
    side = lambda keep, order="place": f"coalesce(string_agg(html, '' order by {order}) filter ({keep}), '')"
    bands = (
        f"select page_id, band, any_value(page_layout) as page_layout, count(*) as elements, count(*) filter (l and not m) as left_content, count(*) filter (r and not m) as right_content, "
        "coalesce(sum(w) filter (l and not m), 0) as left_words, coalesce(sum(w) filter (r and not m), 0) as right_words, max(y_percent) - min(y_percent) as y_span, count(*) filter (not l and not r) as centre_elements, "
        "min(x_percent) filter (l) as left_x, min(x_percent) filter (r) as right_x, count(*) filter (m) as metas, coalesce(arg_min(type, place) filter (not m), '') as head_type, coalesce(arg_min(html, place) filter (not m), '') as head_html, "
        f"{side('m')} as meta_html, {side('not m')} as contents, {side('l')} as lefts, {side('r')} as rights, {side('not l and not r', 'y_percent, place')} as centre from ({items}) group by page_id, band"
    )
    block = f"case when metas > 0 then concat('{L.META_BLOCK}', meta_html, '</div>') else '' end"
    linear = f"case when metas > 0 and head_type = 'header' then concat(head_html, {block}, substr(contents, length(head_html) + 1)) else concat({block}, contents) end"
    three = f"concat('{L.GRID_THREE}', lefts, '</div><div style=\"text-align:center;\">', centre, '</div><div style=\"text-align:right;\">', rights, '</div></div>')"
    share = lambda x: f"cast(case when round_even({x}, 0) <= 0 then 50 else round_even({x}, 0) end as int)"
    right = "greatest(20, least(80, right_x))"
    two = (
        f"concat('<div style=\"display:grid;grid-template-columns:', {share(right + ' - left_x')}, 'fr ', {share('100 - ' + right)}, "
        "'fr;gap:24px;margin:12px 0;\"><div>', lefts, '</div><div>', rights, '</div></div>')"
    )
    rendered = f"select page_id, band, case when not coalesce({COLUMNS}, false) then {linear} when centre_elements > 0 then {three} else {two} end as html from ({bands})"
    return f"select page_id, string_agg(html, '' order by band) as html from ({rendered}) group by page_id"


@query(page_html_sql("select * from ocr_pages"))
def page_html(t: Tables) -> DataFrame:
    ordered = L.raw_text_order(L.clean_elements(L.reading_order(t.ocr_elements)), t.ocr_pages)
    return L.build_page_html(ordered, t.ocr_pages)


_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
_TO_TEXT = CLEAN.format(r"regexp_replace(replace(replace(replace(replace({0}, '<br>', ' '), '<br/>', ' '), '<br />', ' '), '&nbsp;', ' '), '<[^>]+>', ' ', 'g')")


def structured_sql(pages: str) -> str:
    """The rows of a statement (page_layout, raw: the trimmed transcript, html, ...) with `reason` and `structured`."""
    return (
        "select *, case when reason in ('layout', 'no_transcript') then html else replace(raw, chr(10), '<br>') end as structured from (select *, "
        "case when html = '' then 'no_layout' when raw = '' then 'no_transcript' when rw >= 20 and sw < greatest(12, cast(floor(rw * 0.6::double) as int)) then 'few_words' "
        "when rw >= 15 and sw >= 15 and spot > 0 and (spot - 1) / length(st) > case when page_layout = 'single_column' then 0.4 else 0.5 end then 'scrambled' else 'layout' end as reason from ("
        "select *, instr(st, lower(anchor)) as spot from (select *, list_filter(list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '')[1:10], lambda x: length(x) > 4)[1] as anchor, "
        f"len(regexp_extract_all(raw, '{WORD}')) as rw, len(regexp_extract_all({_TO_TEXT.format('html')}, '{WORD}')) as sw, lower({_TO_TEXT.format('html')}) as st from ({pages}))))"
    )


_LAYOUT_HTML = "case page_id % 4 when 0 then '' when 1 then raw_text when 2 then replace(raw_text, ' ', '') else concat('<p>', substr(raw_text, 101), '</p><br/>', substr(raw_text, 1, 100)) end"


@query(f"select page_id, reason, structured from ({structured_sql(f'select page_id, page_layout, {_TRIM.format("raw_text")} as raw, {_LAYOUT_HTML} as html from ocr_pages')})")
def select_structured(t: Tables) -> DataFrame:
    return E.select_structured(t.ocr_pages.withColumn("html", F.expr(_LAYOUT_HTML))).select("page_id", "reason", "structured")


def digitized_sql(pages: str, kept: str = "true") -> str:
    """All columns of the pages of a statement, and html, reason, structured and failed."""
    full = f"select p.*, {_TRIM.format('p.raw_text')} as raw, coalesce(h.html, '') as html, coalesce(p.error, '') <> '' as failed from ({pages}) p left join ({page_html_sql(pages, kept)}) h on h.page_id = p.page_id"
    return structured_sql(full)


#: Pages as they are, digitised.
DIGITIZED = digitized_sql("select * from ocr_pages")


_PASS_WORDS = f"len(regexp_extract_all(coalesce(raw_text, ''), '{WORD}'))"
_WEAK = f"(coalesce(error, '') <> '' or {_TRIM.format('raw_text')} = '' or {_PASS_WORDS} < 25 or ({_PASS_WORDS} < 45 and n_elements <= 2))"


@query(f"select page_id, pass, {_PASS_WORDS} as words, {_WEAK} as needs_fallback from ocr_passes")
def needs_fallback(t: Tables) -> DataFrame:
    rows = E.page_quality(t.ocr_passes)
    return rows.select("page_id", "pass", F.col("words").cast("long").alias("words"), E.needs_fallback().alias("needs_fallback"))


_BETTER = "case when bf then false when p1.failed or p1.words = 0 then bw > 0 else bw >= greatest(p1.words + 5, cast(floor(p1.words * 1.2::double) as bigint)) end"


SELECTED = (
    f"with p as (select page_id, pass, raw_text, error, coalesce(error, '') <> '' as failed, case when coalesce(error, '') <> '' then 0 else {_PASS_WORDS} end as words, {_WEAK} as weak from ocr_passes), "
    "j as (select p1.page_id, p1, p2, p3, case when p3.words > p2.words then p3.words else p2.words end as bw, case when p3.words > p2.words then p3.failed else p2.failed end as bf from p p1 join p p2 on p1.page_id = p2.page_id and p2.pass = 2 "
    "join p p3 on p1.page_id = p3.page_id and p3.pass = 3 where p1.pass = 1), "
    f"k as (select *, case when not p1.weak then 1 when not p2.weak then 2 when {_BETTER} then 3 else 1 end as pass, case when not p1.weak then 1 when not p2.weak then 2 when {_BETTER} then case when p3.words > p2.words then 3 else 2 end else 1 end as source_pass from j) "
    "select page_id, pass, source_pass, case source_pass when 1 then p1.raw_text when 2 then p2.raw_text else p3.raw_text end as raw_text, case source_pass when 1 then p1.error when 2 then p2.error else p3.error end as error, "
    "case source_pass when 1 then p1.words when 2 then p2.words else p3.words end as words from k"
)


@query(f"select page_id, pass, source_pass, raw_text, words from ({SELECTED})")
def select_pass(t: Tables) -> DataFrame:
    return E.select_pass(t.ocr_passes).select("page_id", "pass", "source_pass", "raw_text", F.col("words").cast("long").alias("words"))


@query(
    "select note_id, string_agg(case when error is not null then concat('[Page ', page_no, ' failed: ', error, ']') else coalesce(raw_text, '') end, chr(10) || chr(10) order by page_no) as raw_text, "
    f"string_agg(case when error is not null then concat('<p style=\"color:#EF5350;font-style:italic;\">[Page ', page_no, ' extraction failed]</p>') else replace(coalesce(raw_text, ''), chr(10), '<br>') end, '{E.DIVIDER}' order by page_no) as structured_text, "
    "case when count(error) < count(*) then 'completed' else 'failed' end as status, 'Pages ' || string_agg(cast(page_no as varchar), ', ' order by page_no) filter (error is not null) || ' failed' as error_message from ocr_pages group by note_id"
)
def merge_pages(t: Tables) -> DataFrame:
    return E.merge_pages(t.ocr_pages.withColumn("structured_text", T.newline_to_br("raw_text")))


@query("select note_id, cast(row_number() over (partition by note_id order by page_id) as int) as page_no, coalesce(nullif(f, ''), concat('page_', row_number() over (partition by note_id order by page_id), '.jpg')) as filename from (select note_id, page_id, case when page_id % 3 = 0 then 'scan.png' when page_id % 3 = 1 then '' end as f from ocr_pages)")
def page_numbers(t: Tables) -> DataFrame:
    files = t.ocr_pages.selectExpr("note_id", "page_id", "case when page_id % 3 = 0 then 'scan.png' when page_id % 3 = 1 then '' end as filename")
    return E.page_numbers(files, "page_id").select("note_id", "page_no", "filename")


#: Pages with what their chosen pass gave.
_CHOSEN = f"select o.page_id, o.note_id, o.page_no, o.page_layout, k.raw_text, k.error, k.pass, k.source_pass from ocr_pages o join ({SELECTED}) k on k.page_id = o.page_id"
_PAGES = digitized_sql(_CHOSEN, f"exists (select 1 from ({SELECTED}) s where s.page_id = e.page_id and s.source_pass < 3)")
_NOTES = (
    "select note_id, max(pass) as pass, string_agg(case when failed then concat('[Page ', page_no, ' failed: ', error, ']') else coalesce(raw_text, '') end, chr(10) || chr(10) order by page_no) as raw_text, "
    f"string_agg(case when failed then concat('<p style=\"color:#EF5350;font-style:italic;\">[Page ', page_no, ' extraction failed]</p>') else structured end, '{E.DIVIDER}' order by page_no) as structured_text, "
    f"case when bool_and(failed) then 'failed' else 'completed' end as status, 'Pages ' || string_agg(cast(page_no as varchar), ', ' order by page_no) filter (failed) || ' failed' as error_message from ({_PAGES}) group by note_id"
)


@query(f"select page_id, note_id, page_no, pass, reason, case when failed then 'failed' else 'completed' end as status, case when failed then error end as error_message, case when not failed then structured end as structured_text from ({_PAGES})")
def digitized_pages(t: Tables) -> DataFrame:
    """Pages from their extraction passes to structured text."""
    rows = E.digitize(t.ocr_pages, t.ocr_elements, passes=t.ocr_passes)
    return rows.select("page_id", "note_id", "page_no", "pass", "reason", "status", "error_message", "structured_text")


@query(_NOTES)
def digitized_notes(t: Tables) -> DataFrame:
    return E.digitize_multi(t.ocr_pages, t.ocr_elements, t.ocr_passes)


_STRIP = r"regexp_replace(regexp_replace(coalesce(nullif({0}, ''), nullif({1}, ''), ''), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g')"
_COUNT = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@query(
    f"select n.id as note_id, cast({_COUNT.format(_STRIP.format('n.structured_text', 'n.raw_text'))} as int) as old_words, cast({_COUNT.format(_STRIP.format('m.structured_text', 'm.raw_text'))} as int) as new_words, m.pass, "
    f"case when {_TRIM.format('m.raw_text')} = '' and {_TRIM.format('m.structured_text')} = '' then m.error_message end as error from notes n join ({_NOTES}) m on m.note_id = n.id"
)
def reprocess_diff(t: Tables) -> DataFrame:
    new = E.digitize_multi(t.ocr_pages, t.ocr_elements, t.ocr_passes).withColumn("error", F.col("error_message"))
    return E.reprocess_diff(t.notes, new).select("note_id", "old_words", "new_words", "pass", "error")


@query(r"select page_id, coalesce(page_layout, 'unknown') as page_layout, regexp_replace(raw_text, '^\s+|\s+$', '', 'g') as raw_text, error from ocr_pages")
def ocr_page_files(t: Tables) -> DataFrame:
    """Pages as files of JSON text, a file a page, read and parsed."""
    text = F.to_json(F.struct("page_layout", F.btrim("raw_text", F.lit(T.WHITE)).alias("raw_text"), "error"))
    written = write_files(t.ocr_pages.select("page_id", text.alias("value")), shared_folder(t.spark, "pages"))
    return pages.read_written_pages(t.spark, written, "page_id")
