"""DuckDB SQL for the corpus queries that SQL can express."""

#: DuckDB SQL for op10_near_copies; it compares all pairs that share a shingle, so that it is for small tables.
NEAR_ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * o >= 75 * (a.n + b.n - o)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as c from documents union select e.x, r.c from r join e on e.y = r.doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id from documents d left join n using (doc_id) join (select doc_id, min(c) as c from r group by 1) using (doc_id)
"""

#: DuckDB SQL for op5_lm_score_bigrams.
BIGRAM_ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
t as (select doc_id, i, w[i] as word, case when i > 1 then w[i - 1] end as prev from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d where len(w) > 0)),
o1 as (select doc_id, word, count(*) as n from t group by all), c1 as (select word, sum(n) as n from o1 group by 1),
o2 as (select doc_id, prev, word, count(*) as n from t where prev is not null group by all), c2 as (select prev, word, sum(n) as n from o2 group by all),
x as (select t.doc_id, t.i, c1.n - o1.n as one, cp.n - op.n as before, coalesce(c2.n - o2.n, 0) as two, (select count(*) from t) - len(d.w) as rest
  from t join d using (doc_id) join c1 on c1.word = t.word join o1 on o1.doc_id = t.doc_id and o1.word = t.word
  left join c1 cp on cp.word = t.prev left join o1 op on op.doc_id = t.doc_id and op.word = t.prev
  left join c2 on c2.prev = t.prev and c2.word = t.word left join o2 on o2.doc_id = t.doc_id and o2.prev = t.prev and o2.word = t.word),
y as (select doc_id, count(*) as n_words, count(*) filter (i > 1 and two = 0) as n_backoffs,
  sum(case when two > 0 then ln(two / before) else ln(greatest(one, 0.5) / greatest(rest, 1)) + case when i > 1 then ln(0.4) else 0 end end) as log_score from x group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_backoffs, 0) as n_backoffs, round(coalesce(log_score, 0.0), 4) as log_score from documents left join y using (doc_id)
"""

#: DuckDB SQL for op5_lm_score: of each word, how often the other documents hold the three, two and one words that end with it, and what comes before it.
LM_ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
t as (select doc_id, i, w[i] as a, case when i > 1 then w[i - 1] || ' ' || w[i] end as b, case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as c,
  case when i > 1 then w[i - 1] end as pa, case when i > 2 then w[i - 2] || ' ' || w[i - 1] end as pb, len(w) as size from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d where len(w) > 0)),
g as (select doc_id, a as g from t union all select doc_id, b from t where b is not null union all select doc_id, c from t where c is not null),
own as (select doc_id, g, count(*) as n from g group by all), total as (select g, sum(n) as n from own group by 1),
rest as (select doc_id, g, total.n - own.n as n from own join total using (g)),
x as (select t.doc_id, i, size, ra.n as one, coalesce(rb.n, 0) as two, coalesce(rc.n, 0) as three, rpa.n as before_two, rpb.n as before_three, (select count(*) from t) - size as others
  from t join rest ra on ra.doc_id = t.doc_id and ra.g = t.a left join rest rb on rb.doc_id = t.doc_id and rb.g = t.b left join rest rc on rc.doc_id = t.doc_id and rc.g = t.c
  left join rest rpa on rpa.doc_id = t.doc_id and rpa.g = t.pa left join rest rpb on rpb.doc_id = t.doc_id and rpb.g = t.pb),
y as (select doc_id, count(*) as n_words, count(*) filter (case when three > 0 then 3 when two > 0 then 2 else 1 end < least(i, 3)) as n_backoffs,
  sum(case when three > 0 then ln(three / before_three) when two > 0 then ln(two / before_two) + (least(i, 3) - 2) * ln(0.4) else ln(greatest(one, 0.5) / greatest(others, 1)) + (least(i, 3) - 1) * ln(0.4) end) as log_score from x group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_backoffs, 0) as n_backoffs, round(coalesce(log_score, 0.0), 4) as log_score from documents left join y using (doc_id)
"""
