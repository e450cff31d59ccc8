"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

import math

from noteframe.llm import secrets, warc

#: crc32 of a text's UTF-8 bytes, by a table that is made from the polynomial. Needs the tables `crc_table` and `crc_bytes`.
CRC = """
crc_table as (select list(c order by n) as t from (select n, list_reduce(list_prepend(n, range(8)), lambda c, b: xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end)) as c from (select unnest(range(256)) as n))),
crc_bytes as (select *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
summed as (select * exclude (bytes, t), xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::bigint as crc from crc_bytes, crc_table)
"""

SHARDING = f"""
with {CRC.strip()},
keyed as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 as size, crc, md5(concat('7:', coalesce(cast(doc_id as varchar), 'null'))) as k, coalesce('=' || source, 'null') as s from summed),
ranked as (select *, row_number() over (partition by s order by k) - 1 as r, count(*) over (partition by s) as n from keyed),
placed as (select *, row_number() over (order by cast(2 * r + 1 as double) / cast(2 * n as double), s, k) - 1 as p, count(*) over () as total from ranked)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'rows' as law, cast(p * 40 // total as int) as shard,
 cast(p - ((p * 40 // total) * total + 39) // 40 as bigint) as slot, cast(null as int) as grown_shard, source from placed
"""

WARC = f"""
with digested as (select page_id, url, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, cast(n as bigint) as payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') as payload_digest,
 case when page_id < top then 'revisit' else 'response' end as record_type, case when page_id < top then top end as refers_to, regexp_replace(url, '[\\r\\n]', '%0A', 'g') as uri from digested
"""

TRIE = """
with recursive convs as (select distinct conv_id from conversations where conv_id is not null),
crc_table as (select list(c order by n) as t from (select n, list_reduce(list_prepend(n, range(8)), lambda c, b: xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end)) as c from (select unnest(range(256)) as n))),
hashed as (select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::bigint % 9 as h from convs, crc_table),
ordered as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, '')))) as pos from conversations where conv_id is not null),
moved as (select c.conv_id, 0 as own, o.pos, role, text from hashed c join ordered o on o.conv_id = c.base and o.pos <= c.h union all select c.conv_id, 1, o.pos, role, text from hashed c join ordered o on o.conv_id = c.conv_id and o.pos > c.h),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, md5(concat(length(role), ':', role, ':', text)) as said, octet_length(encode(text)) as bytes from moved),
prefixes as (select conv_id, depth, string_agg(said, '') over (partition by conv_id order by depth) as node, bytes from rebuilt union all select conv_id, 0, '', 0 from convs),
ends as (select node, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (select conv_id, max(node) as node from prefixes group by conv_id) group by node),
nodes as (select node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from prefixes group by node),
families as (select substr(node, 1, 32 * (cast(depth as bigint) - 1)) as node, count(*) as n_children from nodes where depth > 0 group by 1),
above as (select substr(n.node, 1, 32 * up) as node, sum((n_convs - 1) * bytes) as saved, count(*) filter (n_children is null) as leaves from (select n.*, f.n_children, unnest(range(cast(depth + 1 as bigint))) as up from nodes n left join families f on f.node = n.node) n group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(f.n_children, 0) as n_children, a.leaves as n_leaves, cast(a.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join above a on a.node = n.node left join families f on f.node = n.node left join ends e on e.node = n.node left join nodes p on n.depth > 0 and p.node = substr(n.node, 1, 32 * (cast(n.depth as bigint) - 1))
"""

COLLOCATIONS = """
with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(p, '[^ \t]+') as w from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) as p from documents)),
sizes as (select unnest([1, 2, 3]) as size),
grams as (select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase from (select lang, size, w, unnest(range(1, cast(len(w) - size + 2 as bigint))) as i from pieces, sizes where len(w) >= size)),
counts as (select lang, size, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f) as n from counts where size = 1 group by lang),
candidates as (select *, string_split(phrase, ' ') as w from counts where size > 1 and f >= 10),
cuts as (select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, 1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f) as score from (select *, unnest(range(1, size)) as k from candidates) c
 join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ') join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (select lang, phrase, max(f) as longer from (select lang, f, array_to_string(w[s:s + 1], ' ') as phrase from (select lang, f, w, unnest([1, 2]) as s from candidates where size = 3)) group by all),
ranked as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from best b left join covered v on v.lang = b.lang and v.phrase = b.phrase where v.longer is null or 100 * v.longer < 50 * b.a)
select r.lang, rank, r.phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""


def _matches(name: str, pattern: str, group: int | None) -> str:
    """Rows (doc_id, s, e, hit, part) of a pattern's matches: gaps and matches alternate, so places are running sums."""
    p = pattern.replace("'", "''")
    part = f"unnest(regexp_extract_all(text, '{p}', {group}))" if group is not None else "null"
    return (
        f"{name}_raw as (select doc_id, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) as k, unnest(regexp_extract_all(text, '{p}', 0)) as hit, {part} as part, "
        f"unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}', 0))]) as gap from texts), "
        f"{name} as (select doc_id, hit, part, cast(sum(length(gap) + length(hit)) over (partition by doc_id order by k) as bigint) as e, cast(sum(length(gap) + length(hit)) over (partition by doc_id order by k) as bigint) - length(hit) as s from {name}_raw)"
    )


def _entropy(name: str, kind: secrets.CharClass) -> str:
    """Spans of high entropy: windows of each candidate, flagged by whole millionths, joined where they overlap."""
    w = secrets.WINDOW
    pattern = "[" + "".join(f"\\{c}" if c in "+/_=-" else c for c in kind.alphabet) + f"]{{{w},}}"
    most = int(1e6 * w * (math.log2(w) - kind.bits))
    allowed = " or ".join(f"regexp_matches(hit, '{p}')" for p in secrets.ALLOWED)
    logs = "[" + ", ".join(map(str, secrets.LOGS)) + "]"
    return (
        f"{_matches(f'c_{name}', pattern, None)}, "
        f"w_{name} as (select doc_id, s, unnest(range(length(hit) - {w - 1})) as w, hit from c_{name} where not ({allowed})), "
        f"l_{name} as (select doc_id, s, w, string_split(substr(hit, cast(w + 1 as bigint), {w}), '') as chars from w_{name}), "
        f"f_{name} as (select doc_id, s, w from l_{name} where list_sum(list_transform(list_distinct(chars), lambda c: {logs}[len(list_filter(chars, lambda x: x = c)) + 1])) <= {most}), "
        f"i_{name} as (select doc_id, s, w, sum(fresh) over (partition by doc_id, s order by w) as island from (select *, case when w - lag(w) over (partition by doc_id, s order by w) <= {w} then 0 else 1 end as fresh from f_{name})), "
        f"e_{name} as (select doc_id, s + min(w) as s, s + max(w) + {w} as e from i_{name} group by doc_id, s, island)"
    )


def _secrets() -> str:
    base = [_matches("m_assign", secrets.ASSIGN, 2), _matches("m_access", secrets.ACCESS, None), _matches("m_hex", secrets.HEX, None)]
    classes = [_entropy(f"k{n}", kind) for n, kind in enumerate(secrets.CLASSES)]
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents), {', '.join(base)}, {', '.join(classes)},
spans as (select doc_id, 0 as rank, 'assign' as kind, s, e from m_assign where length(part) >= 12 union all select doc_id, 1, 'access', s, e from m_access union all select doc_id, 2, 'hex', s, e from m_hex
 union all select * from (select doc_id, 3, 'entropy', s, e from ({' union '.join(f'select doc_id, s, e from e_k{n}' for n in range(len(classes)))}))),
totals as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, count(*) filter (rank = 3) as n_entropy,
 string_agg(concat_ws(':', kind, s, e), ',' order by s, rank, e) filter (rank < 3) as base, string_agg(concat_ws(':', kind, s, e), ',' order by s, rank, e) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0) as n_entropy
from documents d left join totals t on t.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": _secrets(), "op8_sharding": SHARDING, "op10_warc": WARC, "op11_trie": TRIE, "op12_collocations": COLLOCATIONS}
