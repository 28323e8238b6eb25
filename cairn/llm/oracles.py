"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .linefirst import BOILERPLATE, CHARS_PER_SYMBOL, KEEP_PERCENT, MIN_WORDS, WORDS_PER_SEPARATOR

_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
 w as (select doc_id, t, regexp_extract_all(t, '{_WORD}') ws,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
 g as (select doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) gram from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
 r as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from
       (select doc_id, i, count(*) over (partition by doc_id, gram) c from g) where c > 1) group by doc_id),
 j as (select w.*, coalesce(r.n, 0) rep, list_filter(ls, lambda x:
       not (len(x) - len(translate(x, '#*$%&|<>', '')) >= 1 and (len(x) - len(translate(x, '#*$%&|<>', ''))) * {CHARS_PER_SYMBOL} >= len(x))
       and not (len(x) - len(translate(x, '|»›•', '')) >= 2 and (len(x) - len(translate(x, '|»›•', ''))) * {WORDS_PER_SEPARATOR} >= len(regexp_extract_all(x, '{_WORD}')))
       and not (len(regexp_extract_all(x, '{_WORD}')) >= {MIN_WORDS} and not regexp_matches(x, '[.!?…。！？]'))
       and not (len(regexp_extract_all(x, '{_WORD}')) >= {MIN_WORDS} and (len(x) - len(replace(x, '!', ''))) * 2 >= len(regexp_extract_all(x, '{_WORD}')))
       and not regexp_matches(x, '(?i){"|".join(BOILERPLATE)}')) good from w left join r using (doc_id)),
 b as (select doc_id, cast(len(ws) as bigint) n_words, cast(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) word_chars,
       cast(len(t) - len(translate(t, '#*$%&|<>', '')) as bigint) n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
       cast(rep as bigint) n_repeat_words,
       coalesce(list_sum(list_transform(ls, lambda x: len(x))), 0) line_chars, coalesce(list_sum(list_transform(good, lambda x: len(x))), 0) clean_chars from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * clean_chars >= {KEEP_PERCENT} * line_chars kept from b
"""

_OP4 = rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') ws from documents),
 s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) end g
       from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from w where len(ws) > 0)),
 c as materialized (select doc_id, count(*) n from s group by doc_id),
 p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id
       where a.g in (select g from s group by g having count(*) > 1) group by 1, 2),
 l as materialized (select p.a, p.b from p join c x on x.doc_id = p.a join c y on y.doc_id = p.b where 100 * p.i >= 90 * (x.n + y.n - p.i)),
 e as (select a u, b v from l union all select b, a from l)
select w.doc_id, coalesce(c.n, 0) n_shingles, coalesce(k.component_id, w.doc_id) component_id from w left join c using (doc_id)
left join (with recursive t(u, m) using key (u) as (select distinct u, u from e union
           select e.u, min(t.m) from t join e on e.v = t.u join recurring.t o on o.u = e.u group by e.u, o.m having min(t.m) < o.m)
  select u, m component_id from t) k on k.u = w.doc_id
"""

_OP8 = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) size,
       md5('0:' || coalesce(cast(doc_id as varchar), '')) h from documents),
 s as (select source, cast(sum(size) as bigint) source_size from d group by source),
 w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] weight from s),
 f as (select *, sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0) left_tokens,
       sum(weight) over () - coalesce(sum(weight) over before, 0) left_weight from w
       window before as (order by 3.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
 o as (select *, weight * left_tokens > 3 * source_size * left_weight capped from f),
 a as (select min(left_weight) filter (where capped) lw, max(left_weight) filter (where not capped) fw, max(left_tokens) filter (where not capped) ft from o),
 t as (select source, source_size, case when capped then cast(3 * source_size as double)
       else cast(weight * ft as double) / cast(fw as double) end target from o, a),
 q as (select *, cast(round_even(target, 0) as bigint) quota from t),
 r as (select d.*, q.source_size, q.target, q.quota,
       coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) before
       from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target, cast(case when size = 0 then 0 else
  least(3, quota // source_size + case when 2 * before + size <= 2 * (quota % source_size) then 1 else 0 end) * size end as bigint) taken from r
"""

_OP2 = """
with recursive v as materialized (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
 l as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
 n as (select a, count(*) n_links from l group by a),
 t(u, m) as (select vec_id, vec_id from v union select l.b, t.m from t join l on l.a = t.u),
 c as (select u, min(m) component_id from t group by u)
select v.vec_id, coalesce(n.n_links, 0) n_links, c.component_id, v.vec_id = c.component_id kept
from v left join n on n.a = v.vec_id join c on c.u = v.vec_id
"""

_OP6 = r"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
       union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 n as (select *, 24 + len(r) + len(x) + len(x) - len(replace(x, '\', '')) + len(regexp_extract_all(x, '<\||</?s>|\[/?INST\]|<</?SYS>>')) c from t),
 g as (select conv_id, count(*) n_turns, string_agg(r || chr(10) || x || chr(10), '' order by turn) s,
       coalesce(string_agg(x, '' order by turn) filter (where r = 'assistant'), '') l, sum(c) c from n group by conv_id)
select conv_id, cast(n_turns as bigint) n_turns, sha256(s) turns_sha256, cast(len(l) as bigint) loss_chars, sha256(l) loss_sha256, cast(c as bigint) formatted_chars from g
"""

ORACLE_SQL: dict[str, str] = {
    "op2_e8_cells": _OP2,
    "op3_line_quality": _OP3,
    "op4_parity_join": _OP4,
    "op6_reply_trees": _OP6,
    "op8_flow_mix": _OP8,
}
