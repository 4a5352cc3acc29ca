"""The corpus queries and, where SQL can say the same, DuckDB's words for it."""

from __future__ import annotations

from .ann import op7_adaptive_scan
from .bpe import op10_byte_bpe
from .bytespans import op9_bwt_merge
from .ctw import op1_context_tree
from .mixing import op8_mix_sources
from .neardup import op3_hyperminhash
from .pii import op2_personal_data
from .quality import RULES, STOP_WORDS, op4_quality_rules
from .substring import op6_difference_cover
from .urls import op5_url_rules

QUERIES = {
    "op1_context_tree": op1_context_tree,
    "op2_personal_data": op2_personal_data,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_rules": op5_url_rules,
    "op6_difference_cover": op6_difference_cover,
    "op7_adaptive_scan": op7_adaptive_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_bwt_merge": op9_bwt_merge,
    "op10_byte_bpe": op10_byte_bpe,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_DOCS = f"docs as (select doc_id, source, coalesce(text, '') as t, {_WORDS} as ws from documents)"


def _rule_sql(r) -> str:
    out = []
    if r.low != float("-inf"):
        out.append(f"{r.measure} * 1000 < {r.per} * {round(r.low * 1000)}")
    if r.high != float("inf"):
        out.append(f"{r.measure} * 1000 > {r.per} * {round(r.high * 1000)}")
    return f"(n_words >= {r.words} and ({' or '.join(out)}))"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_OP4 = rf"""
with {_DOCS},
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from docs),
win as (select doc_id, i, case when lead(w, 4) over o is not null then concat_ws(' ', w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) end as win
        from w window o as (partition by doc_id order by i)),
dup as (select doc_id, i, (win is not null and count(*) over (partition by doc_id, win) > 1)::int as d from win),
cov as (select doc_id, i, max(d) over (partition by doc_id order by i rows between 4 preceding and current row) as c from dup),
rep as (select doc_id, sum(c)::bigint as n from cov group by doc_id),
m as (select docs.doc_id, len(ws)::bigint as n_words, list_sum(list_transform(ws, lambda x: length(x)))::bigint as word_chars0,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_marks,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
        len(list_filter(ws, lambda x: list_contains([{_STOP}], lower(x)))) as n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as n_letter_words, coalesce(rep.n, 0)::bigint as n_repeat_words
      from docs left join rep using (doc_id)),
k as (select *, coalesce(word_chars0, 0)::bigint as word_chars, len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {' or '.join(map(_rule_sql, RULES))}) as kept
from k"""

_OP8 = rf"""
with {_DOCS},
r as (select doc_id, source, len(ws)::bigint as size, md5('mix-1:' || coalesce(doc_id::varchar, 'null:' || len(ws))) as k from docs),
s as (select source, sum(size)::bigint as n, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as w from r group by source),
c as (select *, 2 * n as cap, sum(n) over () as total, coalesce(sum(2 * n) over (order by (2 * n)::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
        sum(w) over (order by (2 * n)::double / w, source nulls last rows between current row and unbounded following) as rest from s),
l as (select *, (total::double * 1.5::double - filled::double) / rest::double as level from c),
f as (select source, n, least(cap::double, coalesce((select level from l where level * w <= cap order by cap::double / w, source nulls last limit 1) * w, cap::double)) as target from l),
p as (select r.*, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from r)
select doc_id, size, n as source_size, target,
  (size * (floor(target)::bigint // greatest(n, 1)) + greatest(0, least(size, floor(target)::bigint % greatest(n, 1) - before)))::bigint as taken
from p join f on p.source is not distinct from f.source"""

#: A text's set: its distinct pairs of words, or the only word.
_OP3 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) < 2 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end)) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
r(doc_id, comp) as (select doc_id, doc_id from d union select e.b, r.comp from r join e on e.a = r.doc_id),
m as (select doc_id, min(comp) as comp from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.comp as component_id, m.comp = d.doc_id as kept from d join m using (doc_id) left join n using (doc_id)"""

_OP6 = rf"""
with {_DOCS},
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from docs),
win as (select doc_id, unnest(range(1, len(ws) - 48)) as i, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) as k from docs where len(ws) >= 50),
f as (select k, min(doc_id) as m from win group by 1),
g as (select win.doc_id, win.i from win join f using (k) where f.m < win.doc_id),
c as (select w.doc_id, w.i, w.w, max((g.i is not null)::int) over (partition by w.doc_id order by w.i rows between 49 preceding and current row) as gone from w left join g on g.doc_id = w.doc_id and g.i = w.i),
t as (select doc_id, sum(gone)::bigint as n_removed, string_agg(w, ' ' order by i) filter (gone = 0) as kept from c group by 1)
select docs.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join t using (doc_id)"""

_OP9 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
win as (select doc_id, unnest(range(0, n - 99)) as i, unnest(list_transform(range(0, n - 99), lambda i: md5_number_lower(substr(h, 2 * i + 1, 200)))) as k from d where n >= 100),
f as (select k, min(doc_id * 100000000 + i) as m from win group by 1),
g as (select win.doc_id, win.i from win join f using (k) where f.m < win.doc_id * 100000000 + win.i),
b as (select doc_id, unnest(range(0, n)) as i from d),
c as (select b.doc_id, b.i, max((g.i is not null)::int) over (partition by b.doc_id order by b.i rows between 99 preceding and current row) as gone from b left join g on g.doc_id = b.doc_id and g.i = b.i),
s as (select *, (gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0) as starts, (gone = 0 and coalesce(lag(gone) over (partition by doc_id order by i), 1) = 1) as stays, (gone = 0 and coalesce(lead(gone) over (partition by doc_id order by i), 1) = 1) as ends from c),
t as (select doc_id, sum(gone) as n_removed, count_if(starts) as n_spans, list(i order by i) filter (stays) as lo, list(i order by i) filter (ends) as hi from s group by 1)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(range(1, len(lo) + 1), lambda j: substr(h, 2 * lo[j] + 1, 2 * (hi[j] - lo[j] + 1))), ''), ''))) as kept_sha256 from d left join t using (doc_id)"""

ORACLE_SQL = {"op3_hyperminhash": _OP3, "op4_quality_rules": _OP4, "op6_difference_cover": _OP6, "op8_mix_sources": _OP8, "op9_bwt_merge": _OP9}
