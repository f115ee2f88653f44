"""Queries of the comparison of contexts, statement dependencies, text scopes and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.operators import documents as D
from quirework.operators import experiment as X
from quirework.operators import metrics as E
from quirework.operators import search as S
from quirework.plans._collect import Collected
from quirework.plans.artifact_queries import _ONE, one_papers
from quirework.plans.rejected_rows import REVIEW_SQL, typed_sql
from quirework.session import table
from quirework.sources import rejects

query = Collected()

_S = "(select distinct on (arxiv_id, section_index) * from sections)"
_REVIEW = f"({typed_sql(REVIEW_SQL, rejects.REVIEW)})"
_BLANK = "trim(coalesce({c}, ''), ' ' || chr(9) || chr(10) || chr(13)) = ''"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sections").dropDuplicates(["arxiv_id", "section_index"])


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(table(spark, sf_dir, "raw_lines"), "review")


# Contexts.

_OVERVIEW = r"(?i)\b(?:overviews?|contributions?|techniques?|methods?|methodology|methodologies|approach(?:es)?|strategy|strategies|ideas?|insights?|intuitions?|proof[\s-]+(?:sketch(?:es)?|outlines?|roadmaps?)|(?:sketch(?:es)?|outlines?|roadmaps?)[\s-]+of[\s-]+(?:the[\s-]+)?proofs?)\b"


@query(
    f"""with s as (select * from {_S} where len(list_filter(text, lambda x: not ({_BLANK.format(c='x')}))) > 0),
    b as (select * from s qualify row_number() over (partition by arxiv_id order by not regexp_matches(coalesce(major_section_header, ''), '{_OVERVIEW}'), section_index) = 1)
    select p.arxiv_id, case when b.arxiv_id is null then 'abstract' else 'section' end as source, b.section_index, b.major_section_header as header,
    case when b.arxiv_id is null then p.abstract else array_to_string(list_transform(b.text, lambda x: coalesce(x, '')), chr(10) || chr(10)) end as text from {_ONE} p left join b using (arxiv_id)"""
)
def f12_paper_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text that tells most of each paper's proofs: an overview section, else the first with text, else the abstract."""
    return X.paper_context(one_papers(spark, sf_dir), _sections(spark, sf_dir))


_BLOCKS = f"""b as (select arxiv_id, 'abstract' as block_id, true as abstract, false as introduction from {_ONE} where not ({_BLANK.format(c='abstract')})
    union all select arxiv_id, 's' || section_index || '_p' || (i - 1), false, regexp_matches(coalesce(section_header, '') || ' ' || coalesce(major_section_header, ''), '(?i)\\bintroduction\\b') from (select *, unnest(range(1, len(text) + 1)) as i from {_S}) where not ({_BLANK.format(c='text[i]')})),
    w as (select arxiv_id, bool_or(not abstract) as body, bool_or(abstract) as abs, bool_or(introduction) as intro from b group by 1)"""


@query(
    f"""with {_BLOCKS}, g as (select b.*, intro from b join w using (arxiv_id) where body and abs)
    select arxiv_id, 'paragraph' as condition, block_id as context, block_id from g union all select arxiv_id, 'whole_paper', 'whole', block_id from g
    union all select arxiv_id, 'abstract_introduction', 'introduction', block_id from g where intro and (abstract or introduction)"""
)
def proj6_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every context of the three conditions."""
    return X.context_blocks(D.blocks(one_papers(spark, sf_dir), _sections(spark, sf_dir)))


@query(
    f"""with {_BLOCKS} select p.arxiv_id, case when not coalesce(body, false) then 'no source paragraphs' when not coalesce(abs, false) then 'no abstract' else 'no introduction' end as problem
    from {_ONE} p left join w using (arxiv_id) where not (coalesce(body, false) and coalesce(abs, false) and coalesce(intro, false))"""
)
def proj6_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that lack a context, with the reason."""
    papers = one_papers(spark, sf_dir)
    return X.context_problems(D.blocks(papers, _sections(spark, sf_dir)), papers)


# Statements. The delivered sources name no statement in a proof, so sources are made of the delivered statements: each labelled one is followed by a proof that names the one before it.


def _with_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "statements").where("size(labels) > 0")
    before = F.lag(F.element_at("labels", -1)).over(Window.partitionBy("arxiv_id").orderBy("section_index", "statement_index"))
    kind = F.regexp_replace("statement_type", r"\*", "")
    stated = F.concat(F.lit("\\begin{"), kind, F.lit("}"), F.col("raw_latex"), F.lit("\\end{"), kind, F.lit("}\n"))
    proof = F.when(before.isNotNull(), F.concat(F.lit("\\begin{proof} This follows from \\ref{"), before, F.lit("}.\\end{proof}\n"))).otherwise("")
    rows = s.select("arxiv_id", "section_index", "statement_index", F.concat(stated, proof).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("statement_index", "t"))), lambda x: x["t"])
    return rows.groupBy("arxiv_id", "section_index").agg(F.array_join(parts, "").alias("raw_latex"))


_EDGES = """s as (select *, lag(labels[1]) over (partition by arxiv_id order by section_index, statement_index) as before from statements where len(labels) > 0),
    e as (select arxiv_id, labels[1] as statement, before as depends_on from s where before is not null)"""


@query(f"with {_EDGES} select arxiv_id, statement, depends_on, (row_number() over (partition by arxiv_id order by section_index, statement_index) - 1)::int as place from (select s.*, labels[1] as statement, before as depends_on from s where before is not null)")
def x27_statement_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements' proofs mention which others, by aliases, from sources with a proof behind every labelled statement."""
    return D.statement_edges(_with_proofs(spark, sf_dir))


@query(
    f"""with {_EDGES} select arxiv_id, section_index, statement_index from statements t where not (regexp_replace(statement_type, '\\*+$', '') in ('theorem', 'mtheorem', 'thm', 'thrm') and len(labels) > 0
    and not exists (select 1 from e where e.arxiv_id = t.arxiv_id and e.depends_on = t.labels[1]))"""
)
def f9_without_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements but for labelled theorems that no proof depends on."""
    rows = X.without_top_level(table(spark, sf_dir, "statements"), D.statement_edges(_with_proofs(spark, sf_dir)))
    return rows.select("arxiv_id", "section_index", "statement_index")


# Review and decisions.


@query(
    f"""with r as (select distinct connection_id, arxiv_id, condition, predicted_source, predicted_target from {_REVIEW}), f as (select arxiv_id, max(reference_source) as reference_source, max(reference_target) as reference_target from {_REVIEW} group by 1 having max(reference_source) <> '')
    select arxiv_id, condition, connection_id, predicted_source, predicted_target, reference_source, reference_target, '' as match, '' as review_notes from r join f using (arxiv_id) where not (condition = 'whole_paper' and ascii(right(arxiv_id, 1)) % 2 = 0)"""
)
def j8_review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of the answers that came back well beside their paper's reference; here some answers to whole papers failed."""
    rows = _review(spark, sf_dir)
    one = rows.select("arxiv_id", "condition", F.struct("connection_id", "predicted_source", "predicted_target").alias("c")).distinct()
    failed = (F.col("condition") == "whole_paper") & (F.ascii(F.right("arxiv_id", F.lit(1))) % 2 == 0)
    records = one.groupBy("arxiv_id", "condition").agg(F.collect_list("c").alias("connections")).withColumn("status", F.when(failed, "failed").otherwise("ok"))
    references = rows.groupBy("arxiv_id").agg(F.max("reference_source").alias("reference_source"), F.max("reference_target").alias("reference_target")).where("reference_source <> ''")
    return X.review_candidates(records, references)


@query(
    f"""with c as (select distinct connection_id, arxiv_id, condition from {_REVIEW}), o as (select connection_id, min(match) as match, min(review_notes) as review_notes from {_REVIEW} where match <> '' group by 1)
    select c.connection_id, c.arxiv_id, c.condition, coalesce(o.match, '') as match, coalesce(o.review_notes, '') as review_notes from c left join o using (connection_id)"""
)
def j9_kept_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a new run with the decisions of the earlier review."""
    rows = _review(spark, sf_dir)
    old = rows.where("match <> ''").groupBy("connection_id").agg(F.min("match").alias("match"), F.min("review_notes").alias("review_notes"))
    return X.kept_decisions(rows.select("connection_id", "arxiv_id", "condition").distinct(), old, ["match", "review_notes"])


_DECISIONS = f"""r as (select distinct connection_id, arxiv_id, condition, match, split_part(replace(connection_id, arxiv_id || ':' || condition || ':', ''), ':', 1)::int as request from {_REVIEW}),
    q as (select arxiv_id, condition, count(distinct request) as n, max(request) + 1 as expected, count(*) filter (where match = 'yes') as yes, count(*) filter (where match = 'uncertain') as unsure, count(*) filter (where match = '') as open from r group by all),
    d as (select arxiv_id, condition, case when n <> expected then 'incomplete' when open > 0 then 'pending_review' else 'ready' end as status, yes, unsure from q),
    e as (select arxiv_id, condition, status, case when status = 'ready' then case when yes > 0 then 'connection' when unsure > 0 then 'uncertain' else 'no_connection' end end as prediction, case when status = 'ready' then yes > 0 end as recovered from d)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.split(F.replace("connection_id", F.concat_ws(":", "arxiv_id", "condition", F.lit("")), F.lit("")), ":")[0].cast("int")
    rows = _review(spark, sf_dir).select("connection_id", "arxiv_id", "condition", "match").distinct().withColumn("request_id", number)
    keys = ["arxiv_id", "condition"]
    expected = rows.groupBy(keys).agg((F.max("request_id") + 1).alias("requests"))
    requests = rows.select(*keys, "request_id").distinct().withColumn("ok", F.lit(True))
    return X.condition_decisions(expected, requests, rows.select(*keys, "match"))


@query(f"with {_DECISIONS} select * from e")
def j10_condition_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per paper and condition, if every expected request came back."""
    return _decisions(spark, sf_dir)


_CLASS = "['connection', 'no_connection']"


@query(
    f"""with {_DECISIONS}, t as (select arxiv_id, case when max(reference_target) <> '' then 'connection' else 'no_connection' end as truth from {_REVIEW} group by 1),
    ok as (select arxiv_id from e where status = 'ready' group by 1 having count(distinct condition) >= 1), x as (select e.*, truth, unnest({_CLASS}) as class from e join t using (arxiv_id) join ok using (arxiv_id) where status = 'ready'),
    y as (select condition, class, count(*) filter (where truth = class) as support, count(*) filter (where prediction = class) as predicted, count(*) filter (where truth = class and prediction = class) as both_ from x group by all)
    select condition, class, support, predicted, round(case when support > 0 then case when predicted > 0 then both_ / predicted else 0 end end, 6) as precision, round(case when support > 0 then both_ / support end, 6) as recall from y"""
)
def a13_class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of each class and condition over the papers that are ready."""
    truth = _review(spark, sf_dir).groupBy("arxiv_id").agg(F.when(F.max("reference_target") != "", "connection").otherwise("no_connection").alias("truth"))
    rows = _decisions(spark, sf_dir).where("status = 'ready'").join(truth, "arxiv_id")
    t = X.class_table(rows, ["connection", "no_connection"])
    return t.select("condition", "class", "support", "predicted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    f"""with {_DECISIONS} select e.condition, count(*) as papers, round(avg(recovered::int), 6) as recovery from e where status = 'ready' and arxiv_id in (select arxiv_id from e where status = 'ready' group by 1 having count(distinct condition) = 1) group by 1"""
)
def a13_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of targets over the papers that are ready under exactly as many conditions as asked, here one; few are under more."""
    rows = X.paired(_decisions(spark, sf_dir), ["any"]).where("status = 'ready'")
    return rows.groupBy("condition").agg(F.count("*").alias("papers"), F.round(F.avg(F.col("recovered").cast("int")), 6).alias("recovery"))


@query(
    """select event_type as condition, count(*) as calls, round(sum(value), 4) as total, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, sum(case when event_type < 'd' then user_id end)::bigint as tokens
    from events where value is not null group by 1"""
)
def a14_timing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, total, median and 95th percentile of seconds, and a sum of tokens that stays null where none is reported."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("condition"), "value", F.when(F.col("event_type") < "d", F.col("user_id")).alias("tokens"))
    t = X.timing(e, "value", "condition", ["tokens"])
    return t.select("condition", "calls", F.round("total", 4).alias("total"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "tokens")


# Scopes and retrieval.

_MATCHED = f"""m as (select p.arxiv_id, title, abstract, introduction from {_ONE} p join (select arxiv_id, section_index, array_to_string(list_filter(text, lambda x: not ({_BLANK.format(c='x')})), chr(10) || chr(10)) as introduction from {_S}
    where regexp_matches(concat_ws(' ', section_header, major_section_header), '(?i)\\bintroduction\\b')) s using (arxiv_id) where not ({_BLANK.format(c='introduction')}) and not ({_BLANK.format(c='title')}) and not ({_BLANK.format(c='abstract')})
    qualify row_number() over (partition by p.arxiv_id order by section_index) = 1)"""


@query(f"with {_MATCHED} select arxiv_id, md5(introduction) as introduction from m")
def e7_matched_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that have a title, an abstract and an introduction, so that every scope sees the same ones."""
    return X.matched_corpora(one_papers(spark, sf_dir), _sections(spark, sf_dir)).select("arxiv_id", F.md5("introduction").alias("introduction"))


_Q = "(select * from (values ('q1', 'spectral gap of the graph'), ('q2', 'tokenizer and verifier')) v(query_id, query))"
_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _scope_sql(scope: str) -> str:
    text = f"concat_ws(chr(10) || chr(10), {', '.join(X.SCOPES[scope])})"
    return f"""select '{scope}' as scope, query_id, id, score, rank from (with d as (select arxiv_id as id, {_TOK.format(c=text)} as t from m), w as (select count(*) as docs, avg(len(t)) as mean from d),
    q as (select query_id, unnest(list_distinct({_TOK.format(c='query')})) as term from {_Q}), p as (select id, len(t) as n, term, count(*) as tf from (select id, t, unnest(t) as term from d) where term in (select term from q) group by all),
    f as (select term, count(*) as df from p group by 1), s as (select q.query_id, p.id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) as score from q join p using (term) join f using (term), w group by all)
    select query_id, id, score, (row_number() over (partition by query_id order by score desc, id))::int as rank from s qualify rank <= 5)"""


@query(f"with {_MATCHED} {' union all '.join(_scope_sql(s) for s in X.SCOPES)}")
def proj9_bm25_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over title, abstract and introduction, in the three scopes."""
    q = spark.createDataFrame([("q1", "spectral gap of the graph"), ("q2", "tokenizer and verifier")], "query_id string, query string")
    m = X.matched_corpora(one_papers(spark, sf_dir), _sections(spark, sf_dir))
    out = None
    for scope in X.SCOPES:
        found = D.bm25(m.select("arxiv_id", X.scope_text(scope).alias("t")), q, "arxiv_id", "t", 5).select(F.lit(scope).alias("scope"), "query_id", "id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


@query("select passage_id, (row_number() over (partition by arxiv_id order by passage_id) - 1)::int as technique_index, arxiv_id || '::technique::' || (row_number() over (partition by arxiv_id order by passage_id) - 1) as technique_id from techniques where arxiv_id is not null")
def proj8_passage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of passages made of their paper and their place in it."""
    t = table(spark, sf_dir, "techniques").where("arxiv_id is not null").select("passage_id", "arxiv_id")
    return X.passage_ids(t, [F.col("passage_id")]).select("passage_id", "technique_index", "technique_id")


@query(
    """with t as (select arxiv_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from techniques where embedding is not null and arxiv_id is not null and list_dot_product(embedding::double[], embedding::double[]) > 0),
    c as (select q.arxiv_id as query_id, t.arxiv_id as target_id, round(max(list_dot_product(q.v, t.v) / (q.n * t.n)), 6) as similarity from (select * from t where substr(md5(arxiv_id), 1, 2) < '0d') q join t on q.arxiv_id <> t.arxiv_id and len(q.v) = len(t.v) group by all)
    select query_id, target_id, similarity, (row_number() over (partition by query_id order by similarity desc, target_id))::int as rank from c qualify rank <= 10"""
)
def te_nearest_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 papers nearest to each query paper by the best of all pairs of passages; queries are every 20th paper by the digest of its id."""
    t = table(spark, sf_dir, "techniques").select("arxiv_id", "embedding")
    return S.nearest_papers(t.where(F.substring(F.md5("arxiv_id"), 1, 2) < "0d"), t, 10)


@query(
    """with r as (select user_id, event_type, (row_number() over (partition by user_id order by sum(value) desc, event_type)) as rank from events group by 1, 2),
    u as (select distinct user_id from events), p as (select user_id, a.rank as better, b.rank as worse from u left join r a using (user_id) left join r b on b.user_id = u.user_id and b.event_type = 'purchase' where a.event_type = 'click')
    select round(avg(case when better is null and worse is null then 0.5 when worse is null then 1 when better is null then 0 when better < worse then 1 when better = worse then 0.5 else 0 end), 6) as accuracy, round(avg((better is not null or worse is not null)::int), 6) as coverage from p"""
)
def a21_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pairs ranked as wanted, a missing item last, and the share of pairs with an item at all."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("v"), "event_type")
    r = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).withColumn("rank", F.row_number().over(w))
    pairs = r.where("event_type = 'click'").select("user_id", F.col("rank").alias("better")).join(r.where("event_type = 'purchase'").select("user_id", F.col("rank").alias("worse")), "user_id", "left")
    m = E.pairwise_ranking(pairs)
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"))


@query()
def a9_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of logistic regression on papers it was not fitted on, in five parts; an iterative fit has no SQL."""
    from quirework.operators import models as M

    t = table(spark, sf_dir, "techniques").where("embedding is not null and score is not null and arxiv_id is not null").select("arxiv_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("score") >= 2.7).cast("int").alias("y"))
    return M.left_out_accuracy(t, "x", "y", "arxiv_id", 5)


QUERIES, ORACLE = query.queries, query.oracle
