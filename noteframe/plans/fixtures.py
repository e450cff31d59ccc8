"""Tables of notes, notebooks, cards and pages as views over the given tables: arithmetic on keys, nothing random.

Each view is SQL that Spark and DuckDB both run; where their dialects differ DUCKDB has the other form.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The given tables that the views read.
BASE = ("documents", "pages", "conversations", "events", "customer", "part")

VIEWS = {
    "users": r"""
select c_custkey as id, lower(replace(c_name,'#','_')) as username,
 concat(lower(replace(c_name,'#','_')),'@example.org') as email,
 case when c_custkey % 3 = 0 then concat('g', c_custkey) end as google_id, c_custkey % 10 <> 0 as is_active
from customer
""",
    "notes": r"""
select doc_id as id, doc_id % 50 as owner_id,
 case when doc_id % 13 = 0 then null else concat('Note ', doc_id) end as title,
 case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then '  ' else text end as raw_text,
 case when doc_id % 5 = 0 then null else replace(text, chr(10), '<br>') end as structured_text,
 case when doc_id % 11 = 0 then null else lang end as subject,
 case when doc_id % 7 = 0 then '' else source end as topic,
 case when doc_id % 23 = 0 then null when n_chars > 1000 then concat(lang, ', ', source, ',long') else concat(lang, ', ,', source) end as tags,
 case when doc_id % 4 = 0 then 'summary' end as ai_summary,
 case when doc_id % 9 = 0 then 'failed' when doc_id % 9 = 1 then 'processing' else 'completed' end as status,
 case when doc_id % 6 = 0 then null else concat('img_', doc_id, '.jpg') end as image_filename,
 case when doc_id % 8 = 0 then concat('tok-', doc_id) end as share_token,
 timestamp '2024-01-01 00:00:00' + ((doc_id * 7919) % 2592000) * interval '1' second as created_at
from documents
""",
    "notebooks": r"""
select p_partkey as id, p_name as name, p_partkey % 50 as owner_id,
 case when p_partkey % 4 = 0 then '#FFC107' else '#1F2A44' end as color,
 timestamp '2024-01-01 00:00:00' + ((p_partkey * 7919) % 2592000) * interval '1' second as updated_at
from part
""",
    "note_notebooks": r"""
select n.id as note_id, b.id as notebook_id from
 (select id, owner_id + 50 * cast((floor(id / 50) * 7 + k * 3) % (select greatest(1, count(*) / 50) from notebooks) as bigint) as book
  from (select id, owner_id, 0 as k from notes union all select id, owner_id, 1 as k from notes where id % 2 = 0) a) n
join notebooks b on n.book = b.id
""",
    "ocr_passes": r"""
select doc_id as page_id, pass, case pass
  when 1 then case doc_id % 3 when 0 then text when 1 then replace(text, ' ', '') else replace(text, chr(10), ' ') end
  when 2 then case doc_id % 4 when 0 then replace(text, ' ', '') when 1 then replace(text, '. ', '.x') else text end
  else case doc_id % 5 when 0 then '' else text end end as raw_text,
 case pass when 1 then doc_id % 5 when 2 then doc_id % 4 else 0 end as n_elements,
 case when pass = 1 and doc_id % 17 = 0 then 'timeout' when pass = 2 and doc_id % 7 = 0 then 'JSON parse failed'
      when pass = 3 and doc_id % 19 = 0 then 'timeout' end as error
from (select *, 1 as pass from documents union all select *, 2 as pass from documents union all select *, 3 as pass from documents) p
""",
    "study_events": r"""
select event_id, user_id as session_id, event_id % 20 as card_idx, ts,
 case when event_type in ('click','purchase','view') then 'know' else 'learning' end as result from events
""",
    "flashcard_sets": r"""
select conv_id * 10 + v as id, conv_id as note_id, conv_id % 50 as owner_id, concat('Flashcards for Note ', conv_id) as title,
 case when (conv_id + v) % 7 = 0 then null else timestamp '2024-02-01 00:00:00' + ((conv_id * 31 + v * 17) % 1000) * interval '1' hour end as created_at
from (select distinct conv_id, 0 as v from conversations union all select distinct conv_id, 1 as v from conversations) c where (conv_id + v) % 3 <> 0
""",
    "flashcards": r"""
select s.id * 100 + q.turn as id, s.id as set_id, q.text as question, a.text as answer
from flashcard_sets s join conversations q on s.note_id = q.conv_id and q.role = 'user'
join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role = 'assistant'
""",
    "ai_summaries": r"""
select doc_id as id, doc_id as note_id, (doc_id + case when doc_id % 20 = 0 then 1 else 0 end) % 50 as owner_id, concat('about ', doc_id) as summary from documents where doc_id % 4 = 0
""",
    "ai_explanations": r"""
select doc_id as id, doc_id as note_id, doc_id % 50 as owner_id, trim(substr(text, 1, 12)) as highlighted_text, concat('about ', doc_id) as explanation,
 timestamp '2024-03-01 00:00:00' + (doc_id % 977) * interval '1' minute as created_at from documents where doc_id % 3 = 0
""",
    "model_responses": r"""
select conv_id, kind, case kind
  when 0 then concat('```json', chr(10), arr, chr(10), '```')
  when 1 then substr(arr, 1, cast(floor(length(arr) * 2 / 3) as int))
  when 2 then concat('{"cards": ', arr, '}')
  when 3 then concat('{"note": 1, "items": ', arr, '}') else 'no cards' end as response
from (select conv_id, conv_id % 5 as kind, concat('[{"question": "', t, '", "answer": "a1"}, {"question": "q2", "answer": "', t, '"}]') as arr
 from (select conv_id * 1000 + turn as conv_id, regexp_replace(text, '[^A-Za-z ]', '') as t from conversations) x) y
""",
    "logins": r"""
select c_custkey as login_id,
 case c_custkey % 4 when 0 then case when c_custkey % 3 = 0 then concat('g', c_custkey) else concat('n', c_custkey) end else concat('n', c_custkey) end as google_id,
 case when c_custkey % 2 = 0 then concat(lower(replace(c_name,'#','_')),'@example.org') else concat('new', c_custkey, '@example.org') end as email,
 case when c_custkey % 5 = 0 then null else concat('User ', c_custkey % 7) end as name
from customer where c_custkey % 3 <> 1
""",
    "image_blobs": r"""
select page_id, concat('img_', page_id, case when page_id % 4 = 0 then '' else '.png' end) as filename,
 unhex(hx) as content, page_id * 40000 % 700000 as length, 400 + (page_id * 211) % 2600 as width
from (select page_id, case page_id % 6 when 0 then '89504E470D0A1A0A' when 1 then 'FFD8FFE0' when 2 then '474946383961'
  when 3 then '524946460000000057454250' when 4 then '0000001866747970686569630000' else '0001' end as hx from pages) h
""",
    "ocr_pages": r"""
select doc_id as page_id, cast(floor(doc_id / 3) as bigint) as note_id, doc_id % 3 + 1 as page_no,
 case doc_id % 3 when 0 then 'single_column' when 1 then 'two_column' else 'mixed' end as page_layout,
 text as raw_text, case when doc_id % 12 = 5 or doc_id % 30 in (9, 10, 11) then 'timeout' end as error from documents
""",
    "html_notes": r"""
select doc_id as note_id, concat('<p>', replace(text, chr(10), '</p><p>'), '</p><p>&nbsp;<span style="background-color: rgb(255, 255, 0);">', substr(text, case when doc_id % 2 = 0 then 1 else 51 end, 12),
 '</span><br/><span style="background-color: transparent">plain</span> $x_', doc_id, '$ and $$sum_i x_i$$</p>') as html from documents
""",
    "ocr_elements": r"""
select page_id, ord, content,
 case (page_id + ord) % 6 when 0 then 'header' when 1 then 'paragraph' when 2 then 'bullet_list' when 3 then 'key_value' when 4 then 'diagram' else 'label' end as type,
 case (page_id * 3 + ord) % 5 when 0 then 'box' when 1 then 'underlined' when 2 then 'circled' else 'none' end as container,
 concat(case when ord * 3 < n then 'top' when ord * 3 < 2 * n then 'middle' else 'bottom' end, '-',
        case (page_id + ord * 2) % 5 when 0 then 'center' when 1 then 'right' when 3 then 'right' else 'left' end) as region,
 cast(case (page_id + ord * 2) % 5 when 0 then 30 when 1 then 52 when 3 then 55 else 4 end as double) as x_percent,
 cast((ord * 97) % 100 as double) * (cast(ord + 1 as double) / cast(n as double)) as y_percent,
 cast(case when ord % 4 = 0 then 15 else 45 end as double) as width_percent,
 cast((page_id + ord) % 9 as double) as height_percent,
 case (page_id + ord) % 4 when 0 then 'triangle' when 1 then 'rectangle' when 2 then 'arrow' end as shape
from (select doc_id as page_id, cast(pos as bigint) as ord, col as content, cast(size(split(text, '\n')) as bigint) as n from (select doc_id, text, posexplode(split(text, '\n')) as (pos, col) from documents)) l
""",
}

DUCKDB = {
    "model_responses": r"""
select conv_id, kind, case kind
  when 0 then concat('```json', chr(10), arr, chr(10), '```')
  when 1 then substr(arr, 1, cast(floor(length(arr) * 2 / 3) as int))
  when 2 then concat('{"cards": ', arr, '}')
  when 3 then concat('{"note": 1, "items": ', arr, '}') else 'no cards' end as response
from (select conv_id, conv_id % 5 as kind, concat('[{"question": "', t, '", "answer": "a1"}, {"question": "q2", "answer": "', t, '"}]') as arr
 from (select conv_id * 1000 + turn as conv_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') as t from conversations) x) y
""",
    "ocr_elements": r"""
select page_id, ord, content,
 case (page_id + ord) % 6 when 0 then 'header' when 1 then 'paragraph' when 2 then 'bullet_list' when 3 then 'key_value' when 4 then 'diagram' else 'label' end as type,
 case (page_id * 3 + ord) % 5 when 0 then 'box' when 1 then 'underlined' when 2 then 'circled' else 'none' end as container,
 concat(case when ord * 3 < n then 'top' when ord * 3 < 2 * n then 'middle' else 'bottom' end, '-',
        case (page_id + ord * 2) % 5 when 0 then 'center' when 1 then 'right' when 3 then 'right' else 'left' end) as region,
 cast(case (page_id + ord * 2) % 5 when 0 then 30 when 1 then 52 when 3 then 55 else 4 end as double) as x_percent,
 cast((ord * 97) % 100 as double) * (cast(ord + 1 as double) / cast(n as double)) as y_percent,
 cast(case when ord % 4 = 0 then 15 else 45 end as double) as width_percent,
 cast((page_id + ord) % 9 as double) as height_percent,
 case (page_id + ord) % 4 when 0 then 'triangle' when 1 then 'rectangle' when 2 then 'arrow' end as shape
from (select doc_id as page_id, unnest(range(len(string_split(text, chr(10))))) as ord,
  unnest(string_split(text, chr(10))) as content, len(string_split(text, chr(10))) as n from documents) l
""",
}


class Tables:
    """The views of one data folder as DataFrames, by attribute: Tables(spark, sf_dir).notes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                for other in needed(VIEWS[name]):
                    getattr(self, other)
                df = self.spark.sql(VIEWS[name].replace("timestamp '", "timestamp_ntz '"))
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            df.createOrReplaceTempView(name)
            self.made[name] = df
        return self.made[name]


def needed(sql: str) -> list[str]:
    """Views and tables that a statement names."""
    return [x for x in (*BASE, *VIEWS) if re.search(rf"\b(from|join)\s+{x}\b", sql)]


def with_views(sql: str) -> str:
    """A DuckDB statement with the views that it needs, and those that they need, before it."""
    found: list[str] = []

    def add(text: str) -> None:
        for x in needed(text):
            if x in VIEWS and x not in found:
                add(DUCKDB.get(x, VIEWS[x]))
                found.append(x)

    add(sql)
    if not found:
        return sql
    head = ",\n".join(f"{x} as ({DUCKDB.get(x, VIEWS[x]).strip()})" for x in found)
    body = sql.strip()
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{head},\n{body[len(start) :].strip()}"
    return f"with {head}\n{body}"
