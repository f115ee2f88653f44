"""Queries around plugged models, with deterministic stand-ins whose answers SQL can work out too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import answers as A
from quirework.operators.documents import tokens
from quirework.plans._collect import Collected
from quirework.plans.artifact_queries import _ONE, one_papers
from quirework.plans.experiment_queries import f12_paper_context
from quirework.scratch import Scratch
from quirework.session import table

query = Collected()


def _digits(text: str, n: int) -> str:
    """The stand-in encoder in SQL."""
    return f"list_transform(range(1, {n + 1}), lambda place: instr('0123456789abcdef', substr(md5({text}), place::int, 1)) - 8.5)"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x / sqrt(list_sum(list_transform({v}, lambda y: y * y))), 6))"


@query(
    f"""with t as (select passage_id, case when trim(coalesce(passage, '')) <> '' then {_digits("'" + A.DOCUMENT_PROMPT + "' || passage", 8)} end as v from techniques)
    select passage_id, {_unit('v')} as embedding from t"""
)
def u4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one of every passage behind the prompt for documents."""
    t = table(spark, sf_dir, "techniques").select("passage_id", "passage")
    rows = A.embedded(t, "passage", A.digest_encoder(), A.DOCUMENT_PROMPT)
    return rows.select("passage_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(
    f"""with p as (select arxiv_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(abstract, '') as t from {_ONE}) select arxiv_id, {_unit(_digits("'" + A.CLUSTER_PROMPT + "' || t", 8))} as embedding from p"""
)
def u4_area_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every paper's title and abstract behind the prompt for clustering."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit("")))
    rows = A.embedded(one_papers(spark, sf_dir).select("arxiv_id", text.alias("t")), "t", A.digest_encoder(), A.CLUSTER_PROMPT)
    return rows.select("arxiv_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(
    f"""with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents), n as (select doc_id, w, greatest(1, ceil((len(w) - 16) / 48.0))::int as n from t),
    x as (select doc_id, n, unnest(range(0, n)) as i, w from n), y as (select doc_id, n, {_digits("array_to_string(w[i * 48 + 1 : i * 48 + 64], ' ')", 5)} as v from x)
    select doc_id, n::bigint as windows, [round(avg(v[1]), 6), round(avg(v[2]), 6), round(avg(v[3]), 6), round(avg(v[4]), 6), round(avg(v[5]), 6)] as logits from y group by all"""
)
def u3_pooled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of every document's windows of 64 tokens that share 16, scored and pooled by their mean."""
    rows = A.scored_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", tokens(F.col("text")), A.digest_encoder(5), 64, 16)
    return rows.select("doc_id", "windows", F.transform("logits", lambda x: F.round(x, 6)).alias("logits"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f12_paper_context(spark, sf_dir).join(one_papers(spark, sf_dir).select("arxiv_id", "title"), "arxiv_id")


def _context_sql() -> str:
    from quirework.plans.experiment_queries import ORACLE

    return f"""c as ({ORACLE['f12_paper_context']}), s as (select t.*, 'Paper: ' || coalesce(p.title, '') || chr(10) || chr(10) || case when c.source = 'section' then 'Proof overview (' || coalesce(c.header, '') || '):' || chr(10) else 'Paper abstract:' || chr(10) end
    || coalesce(c.text, '') as ctx from statements t join c using (arxiv_id) join {_ONE} p using (arxiv_id)), a as (select arxiv_id, section_index, statement_index, substr(md5(ctx || chr(10) || chr(10) || 'Statement (' || statement_type || '):' || chr(10) || raw_latex), 1, 8) as description from s)"""


@query(f"with {_context_sql()} select * from a")
def u9_contextualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description of every statement from its paper's context."""
    s = table(spark, sf_dir, "statements")
    return A.contextualised(s, _contexts(spark, sf_dir), A.digest_answers()).select("arxiv_id", "section_index", "statement_index", "description")


@query(
    """with s as (select *, (row_number() over (partition by arxiv_id order by section_index, statement_index) - 1)::int as place, count(*) over (partition by arxiv_id) as n from statements)
    select arxiv_id, section_index, statement_index, (least(3, n) - 1 - place)::int as rank from s where place < least(3, n) and n % 7 <> 0"""
)
def u9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that each paper's answer ranks; here the first three backwards, and a broken answer of every paper whose number of statements is a multiple of 7."""
    s = table(spark, sf_dir, "statements")
    n = s.groupBy("arxiv_id").agg(F.count("*").alias("n"))
    ranked = F.to_json(F.reverse(F.sequence(F.lit(0), (F.least(F.lit(3), F.col("n")) - 1).cast("int"))))
    answers = n.select("arxiv_id", F.when(F.col("n") % 7 == 0, "[0, 0, 1]").otherwise(ranked).alias("answer"))
    return A.selected_statements(s, answers, 3).select("arxiv_id", "section_index", "statement_index", "rank")


@query(
    f"""with t as (select distinct arxiv_id, section_index, paragraph_index, text from paragraphs where arxiv_id is not null qualify row_number() over (partition by arxiv_id, section_index, paragraph_index order by text) = 1),
    v as (select arxiv_id, section_index, paragraph_index, {_digits("coalesce(text, '')", 5)} as v from t), e as (select *, list_sum(list_transform(v, lambda x: exp(x))) as z from v)
    select arxiv_id, section_index, paragraph_index, list_transform(v, lambda x: round(exp(x) / z, 6)) as distribution from e"""
)
def u10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions over the five classes of every paragraph; those of even places come from the cache, some of them stale."""
    keys = ["arxiv_id", "section_index", "paragraph_index"]
    p = table(spark, sf_dir, "paragraphs").where("arxiv_id is not null").groupBy(keys).agg(F.min("text").alias("text"), F.count_if(F.col("text").isNull()).alias("nulls"))
    key = F.to_json(F.struct(*keys))
    rows = p.select(key.alias("key"), F.col("text"))
    even = p.where("paragraph_index % 2 = 0").select(key.alias("key"), "text")
    cached = A.M.scored(even, "text", A.digest_encoder(5), "answer").select("key", A.label_fingerprint(F.when(F.length("text") % 5 == 0, F.lit("stale")).otherwise(F.col("text")), "v1").alias("fingerprint"), "answer")
    found, _ = A.weak_labels(rows, cached, "key", "text", "v1", A.digest_encoder(5))
    out = found.select(F.from_json("key", "arxiv_id string, section_index int, paragraph_index int").alias("k"), F.transform("distribution", lambda x: F.round(x, 6)).alias("distribution"))
    return out.select("k.*", "distribution")


@query()
def u7_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the cluster tree, children before parents; each level asks with the answers of the one below."""
    tree = table(spark, sf_dir, "cluster_metadata").select("cluster_id", "parent_cluster_id")
    members = table(spark, sf_dir, "clusters").select("cluster_id", "arxiv_id")
    return A.labelled_clusters(tree, members, table(spark, sf_dir, "papers").select("arxiv_id", "title"), A.digest_answers(), Scratch(spark, "u7"))


@query("select doc_id, case when trim(text) <> '' then trim(text) end as content from documents where text is not null and regexp_full_match(text, '[A-Za-z0-9 .,;:()-]*')")
def g23_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of chat responses, null where it is blank."""
    d = table(spark, sf_dir, "documents").where("text is not null").where(F.col("text").rlike(r"\A[A-Za-z0-9 .,;:()-]*\z"))
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    response = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return d.select("doc_id", A.content(response).alias("content"))


QUERIES, ORACLE = query.queries, query.oracle
