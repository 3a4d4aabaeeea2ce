"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLES = {
    "op2_exact_dedup": r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm order by n desc, doc_id)
""",
    "op1_warc_segments": r"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select *, max(page_id) over (partition by body) as keeper,
  array_to_string(list_transform(string_split(sha1(body), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4)), '') as bits from p)
select page_id, octet_length(encode(body)) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
    + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int) + cast(substr(bits, 5 * i + 5, 1) as int) as bigint), 1)), '') as payload_digest,
  case when keeper = page_id then 'response' else 'revisit' end as record_type, case when keeper <> page_id then keeper end as refers_to
from d
""",
    "op5_embedding_dedup": r"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join link l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a)
select c.a as vec_id, (select count(*) from link l where l.a = c.a) as n_links, component_id, c.a = component_id as kept from c
""",
    "op6_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0) q),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach r where r.a = d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id
""",
    "op10_repeated_phrases": r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35) q),
r as (select doc_id, i from (select *, count(*) over (partition by h) as c from s) q where c > 1),
gone as (select distinct doc_id, i + k as j from r cross join range(0, 35) t(k)),
k as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
m as (select k.doc_id, count(*) as n_words, count(gone.j) as n_removed, string_agg(k.word, ' ' order by k.j) filter (gone.j is null) as kept from k left join gone on gone.doc_id = k.doc_id and gone.j = k.j group by k.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join m on m.doc_id = d.doc_id
""",
}
