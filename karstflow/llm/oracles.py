"""DuckDB SQL for the corpus queries that SQL can express, written from their contracts."""

from __future__ import annotations

from karstflow.llm.quality_rules import STOP_WORDS

SPACE = r"\x20\x09-\x0D"
#: A-Z lower-cased, other letters as they are.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MULTIPLIER = 2862933555777941757

_stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^{SPACE}]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) as lines from d),
win as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, x) as n from win) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(8) t(k) group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    length(text) - length(replace(text, '!', '')) as n_excl, len(list_filter(w, lambda x: lower(x) in ({_stop}))) as n_stop, len(lines) as n_lines
  from w left join covered on covered.doc_id = w.doc_id),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2 and 20 and n_symbols / n_words <= 0.3 and n_excl / n_words <= 0.5 and n_stop / n_words >= 0.01 and n_dup_lines / n_lines <= 0.5 as kept from f"""

LINE_DEDUP = rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from d),
k as (select *, {LOWER.format(f"regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')")} as key from l),
often as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, often.key is not null and doc_id <> keeper as gone from k left join often using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id"""

DECONTAMINATION = rf"""
with word as (select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' as p),
d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, p) as w from documents, word),
b as (select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, p) as w from benchmark, word),
bw as (select item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as x from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as x from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from bw))),
hit as (select distinct doc_id, item_id, i, dw.size from dw join bw on dw.size = bw.size and dw.x = bw.x),
n as (select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(size)) as k from hit) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(x, ',' order by x) as x from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(items.x, '')) as items_sha256, coalesce(n.n, 0) > 0 as contaminated
from d left join n on n.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^{SPACE}]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
link as (select a, b from both_ join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
way as (select a, b from link union all select b, a from link),
reach(id, r) as (select doc_id, doc_id from d union select id, way.b from reach join way on way.a = r),
c as (select id, min(r) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, component_id = d.doc_id as kept from d join c on c.id = d.doc_id left join n on n.doc_id = d.doc_id"""


def _jump(shards: int) -> str:
    """The shard of every doc_id: the last b of a sequence (key, b, j) that ends where j reaches the number of shards."""
    key = f"((key * {MULTIPLIER}::uhugeint + 1) % 18446744073709551616::uhugeint)"
    return f"""(select doc_id, b as shard from (with recursive j(doc_id, key, b, j) as (
    select doc_id, (doc_id + case when doc_id < 0 then 18446744073709551616::hugeint else 0 end)::uhugeint, -1::bigint, 0::bigint from documents
    union all select doc_id, {key}, j, floor((j + 1) * (2147483648.0::double / (({key} // 8589934592::uhugeint)::double + 1)))::bigint from j where j < {shards})
  select * from j) where j >= {shards})"""


#: The remainder of each byte under the reversed polynomial of CRC-32, and the sum of a text's bytes from it.
_TABLE = "(select list(c order by i) from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c from range(256) t(i)))"

SHARDING = f"""
with recursive crc as (select {_TABLE} as t),
d as (select doc_id, coalesce(text, '') as text from documents),
bytes as (select doc_id, text, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::bigint) as b from d),
s16 as {_jump(16)}, s17 as {_jump(17)},
r as (select d.doc_id, octet_length(encode(d.text))::bigint + 1 as size,
    case when d.text = '' then 0 else xor(list_reduce(list_prepend(4294967295::bigint, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) end as text_crc32,
    'key' as law, s16.shard::int as shard, s17.shard::int as grown_shard
  from d, crc, bytes, s16, s17 where bytes.doc_id = d.doc_id and s16.doc_id = d.doc_id and s17.doc_id = d.doc_id)
select doc_id, size, text_crc32::bigint as text_crc32, law, shard, row_number() over (partition by shard order by (((doc_id + case when doc_id < 0 then 18446744073709551616::hugeint else 0 end)::uhugeint * {MULTIPLIER}::uhugeint + 1) % 18446744073709551616::uhugeint // 18014398509481984::uhugeint + text_crc32) % 1024, doc_id, text_crc32, size) - 1 as slot, grown_shard from r"""

SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
p as (select doc_id, p, md5(substring(h, 2 * p + 1, 800)) as x from (select doc_id, h, unnest(range(n - 399)) as p from d where n >= 400)),
rep as (select doc_id, p from (select doc_id, p, count(*) over (partition by x) as c from p) where c > 1),
run as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 400 then 0 else 1 end as new from rep),
num as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from run),
span as (select doc_id, k, min(p) as a, max(p) + 400 as b from num group by doc_id, k),
gap as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as since from span),
kept as (select doc_id, sum(b - a) as gone, count(*) as spans, max(b) as last, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' order by a) as x from gap join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(x, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join kept using (doc_id)"""

ORACLES = {
    "op1_quality_rules": QUALITY_RULES,
    "op2_line_dedup": LINE_DEDUP,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op8_decontamination": DECONTAMINATION,
    "op9_near_duplicates": NEAR_DUPLICATES,
    "op10_sharding": SHARDING,
}
