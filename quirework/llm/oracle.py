"""SQL for DuckDB of those problems that it can state over whole tables in reasonable time; the rest is tested against brute force."""

WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"

P1_FOUND = f"""with recursive t as (select passage_id, min(passage) as passage from techniques where passage is not null group by 1),
w as (select passage_id, unnest(list_distinct({WORDS.format(c='passage')})) as word from t),
n as (select passage_id, count(*) as n from w group by 1),
both_words as (select a.passage_id as a, b.passage_id as b, count(*) as k from w a join w b on a.word = b.word and a.passage_id < b.passage_id group by all),
links as (select a, b from both_words join n x on x.passage_id = a join n y on y.passage_id = b where k * 10 >= 7 * (x.n + y.n - k)),
edges as (select a, b from links union select b, a from links),
reach as (select a as id, b as other from edges union select r.id, e.b from reach r join edges e on e.a = r.other)
select distinct id as passage_id_a, other as passage_id_b from reach where id < other"""

P2_FOUND = """select distinct 'sections' as table_name, arxiv_id, section_index, i - 1 as paragraph_index
from (select arxiv_id, section_index, text, unnest(range(1, len(text) + 1))::int as i from sections) where length(text[i]) > 1500
union all select distinct 'paragraphs', arxiv_id, section_index, paragraph_index from paragraphs where length(text) > 1500"""

P3_FOUND = """with v as (select distinct 'techniques' as table_name, passage_id as id, embedding::double[] as v from techniques union all select distinct 'papers', arxiv_id, area_embedding::double[] from papers),
u as (select *, sqrt(list_dot_product(v, v)) as n from v where v is not null and len(v) > 0 and list_dot_product(v, v) > 0),
c as (select a.table_name, a.id, b.id as other, list_dot_product(a.v, b.v) / (a.n * b.n) as cosine from u a join u b on a.table_name = b.table_name and a.id <> b.id and len(a.v) = len(b.v)),
best as (select * from c qualify row_number() over (partition by table_name, id order by cosine desc, other) <= 5)
select distinct table_name, least(id, other) as id_a, greatest(id, other) as id_b from best where cosine >= 0.95"""

P4_FOUND = """with recursive u as (select distinct arxiv_id as id, area_embedding::double[] as v from papers where area_embedding is not null and list_dot_product(area_embedding::double[], area_embedding::double[]) > 0),
edges as (select a.id as a, b.id as b from u a join u b on a.id <> b.id where list_dot_product(a.v, b.v) >= 0.8 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
reach as (select id, id as other from u union select r.id, e.b from reach r join edges e on e.a = r.other),
own as (select id, min(other) as cluster_key, count(*) as n from reach group by id)
select cluster_key, id as arxiv_id from own where n >= 8"""

P9_FOUND = f"""with d as (select doc_id, {WORDS.format(c='text')} as w from documents where text is not null),
r as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, array_to_string(w[i : i + 7], ' ') order by i) as k from r) where k > 1),
hit as (select doc_id, count(distinct i + j) as n from again, (select unnest(range(0, 8)) as j) group by doc_id)
select d.doc_id from d join hit using (doc_id) where hit.n * 4 >= len(d.w)"""

P1_GROUPS = f"""with recursive t as (select passage_id, min(passage) as passage from techniques where passage is not null group by 1),
s as (select passage_id, {WORDS.format(c='passage')} as w from t), k as (select passage_id, array_to_string(w, ' ') as key, w from s where len(w) > 0), d as (select key, any_value(list_distinct(w)) as w from k group by 1),
w as (select key, unnest(w) as word from d), n as (select key, len(w) as n from d),
both_words as (select a.key as a, b.key as b, count(*) as k from w a join w b on a.word = b.word and a.key < b.key group by all),
links as (select a, b from both_words join n x on x.key = a join n y on y.key = b where k * 10 >= 7 * (x.n + y.n - k)),
edges as (select a, b from links union all select b, a from links),
reach as (select key as id, key as other from d union select r.id, e.b from reach r join edges e on e.a = r.other),
own as (select id as key, min(other) as comp from reach group by 1), c as (select passage_id, comp from k join own using (key)), named as (select comp, min(passage_id) as class_id, count(*) as class_size from c group by 1)
select passage_id, class_id, class_size from c join named using (comp)"""

P3_TOP5 = """with v as (select distinct 'techniques' as space, passage_id as id, embedding::double[] as v from techniques union all select distinct 'papers', arxiv_id, area_embedding::double[] from papers),
u as (select *, sqrt(list_dot_product(v, v)) as n from v where v is not null and len(v) > 0 and list_dot_product(v, v) > 0),
c as (select a.space, a.id, b.id as other, list_dot_product(a.v, b.v) / (a.n * b.n) as cosine from (select * from u where ('0x' || substr(md5(id), 1, 4))::int % 20 = 0) a join u b on a.space = b.space and a.id <> b.id and len(a.v) = len(b.v))
select space, id, other, round(cosine, 5) as cosine, (row_number() over (partition by space, id order by round(cosine, 9) desc, other))::int as rank from c qualify rank <= 5"""

P9_SHARES = f"""with d as (select doc_id, {WORDS.format(c="coalesce(text, '')")} as w from documents),
r as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, array_to_string(w[i : i + 7], ' ') order by i) as k from r) where k > 1),
hit as (select doc_id, count(distinct i + j) as n from again, (select unnest(range(0, 8)) as j) group by doc_id)
select doc_id, len(w) as words, round(case when len(w) > 0 then coalesce(n, 0) / len(w) else 0 end, 6) as repeated_share from d left join hit using (doc_id)"""

ORACLE = {"p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_top5": P3_TOP5, "p4_found": P4_FOUND, "p9_found": P9_FOUND, "p9_shares": P9_SHARES}
