"""The corpus operators' queries, each over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from lintlake.llm.chat import op13_chat
from lintlake.llm.decontamination import op1_decontamination
from lintlake.llm.fingerprints import op2_fingerprints
from lintlake.llm.jaccard import op3_jaccard_join
from lintlake.llm.language import op7_language_id
from lintlake.llm.licenses import op9_licenses
from lintlake.llm.mixing import op4_mixing
from lintlake.llm.negatives import op11_negatives
from lintlake.llm.pii import op10_pii
from lintlake.llm.quality import op6_quality
from lintlake.llm.secrets import op8_secrets
from lintlake.llm.sharding import op5_sharding
from lintlake.llm.spelling import op12_spelling


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_fingerprints": op2_fingerprints,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_mixing": op4_mixing,
        "op5_sharding": op5_sharding,
        "op6_quality": op6_quality,
        "op7_language_id": op7_language_id,
        "op8_secrets": op8_secrets,
        "op9_licenses": op9_licenses,
        "op10_pii": op10_pii,
        "op11_negatives": op11_negatives,
        "op12_spelling": op12_spelling,
        "op13_chat": op13_chat,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as l, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as k from b where len(w) > 0),
lens as (select distinct l from win),
dk as (select doc_id, l, unnest(range(0, len(w) - l + 1)) as i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) as k from d join lens on len(w) >= l),
hit as (select doc_id, dk.l, i, item_id from dk join win on dk.l = win.l and dk.k = win.k),
n as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + l)) as p from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.doc_id = n.doc_id left join it on d.doc_id = it.doc_id"""

_OP3 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as k from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select x, y from c join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 80 * (nx.n + ny.n - i)),
pairs as (select x, y from e union all select y, x from e),
r(id, root) as (select doc_id, doc_id from n union select y, root from r join pairs on id = x),
least_root as (select id, min(root) as component_id from r group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id from d left join n on d.doc_id = n.doc_id left join least_root on d.doc_id = id"""

_OP11 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, list_dot_product(a.e, v.e)::bigint as score from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank
  from p join s on s.anchor_id = p.anchor_id where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5"""

_ESCAPED = r"regexp_replace(coalesce({}, ''), '([<\[])(\\*)((?:/?s>|/?INST\]|/?SYS>>|\|[a-z_]+\|>))', '\1\\\2\3', 'g')"
_OP13 = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n, sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 23) over (w rows unbounded preceding) as upto
  from c window w as (partition by conv_id order by turn nulls first, role, {_ESCAPED.format("text")})),
g as (select conv_id, n, string_agg(role || chr(10) || text || chr(10), '' order by i) as told, coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss, sum(upto) filter (role = 'assistant' or i = n) as chars from t group by all)
select conv_id, n::bigint as n_turns, sha256(told) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, chars::bigint as formatted_chars from g"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL expresses; the others are tested against brute force."""
    return {"op1_decontamination": _OP1, "op3_jaccard_join": _OP3, "op11_negatives": _OP11, "op13_chat": _OP13}
