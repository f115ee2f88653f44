"""Queries over passages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.operators import search as S
from quirework.plans._collect import Collected
from quirework.session import table

query = Collected()

_V = """select arxiv_id, passage_id, score, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n
  from techniques where embedding is not null and len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0"""
_PICK = "substr(md5(arxiv_id), 1, 2) < '0d'"
_NEAR = f"""with t as ({_V}), q as (select * from t where {_PICK}),
  pairs as (select q.arxiv_id query_id, q.passage_id query_passage_id, t.arxiv_id target_id, t.passage_id target_passage_id,
    round(list_dot_product(q.v, t.v) / (q.n * t.n), 6) similarity, q.score s, t.score t_score from q, t),
  near as (select *, row_number() over (partition by query_passage_id order by similarity desc, target_passage_id) as position from pairs
    qualify row_number() over (partition by query_passage_id order by similarity desc, target_passage_id) <= 6),
  other as (select * from near where target_id <> query_id)"""


def query_papers(techniques: DataFrame) -> DataFrame:
    """The stated query set: the passages of every 20th paper by the digest of its id, searched against all rows."""
    return techniques.where(F.substring(F.md5("arxiv_id"), 1, 2) < "0d")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "techniques").select("arxiv_id", "passage_id", "embedding", "score")


@query(_NEAR + " select query_id, query_passage_id, target_id, target_passage_id, similarity, position::int as position from other")
def j5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 6 nearest passages of each query passage, without those of the query paper."""
    p = _passages(spark, sf_dir)
    return S.candidates(query_papers(p), p, 5)


@query(
    _NEAR
    + """, papers_found as (select query_id, target_id, max(similarity) best, min((position, query_passage_id, target_passage_id)) first from other group by all),
  ranks as (select *, row_number() over (partition by query_id order by best desc, first) as rank from papers_found qualify row_number() over (partition by query_id order by best desc, first) <= 5)
  select o.query_id, r.rank::int as rank, o.target_id, m.target_title, query_passage_id, target_passage_id, similarity from other o join ranks r using (query_id, target_id)
  left join (select arxiv_id, min(title) target_title from papers group by 1) m on m.arxiv_id = o.target_id"""
)
def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of similar papers: the 5 papers with the best passage pair, with all their pairs and titles."""
    p = _passages(spark, sf_dir)
    return S.find_similar(query_papers(p), p, table(spark, sf_dir, "papers"), 5)


_ONE_PAPER = _NEAR.replace(_PICK, "arxiv_id = (select max(arxiv_id) from techniques where embedding is not null and len(embedding) = 64)")


@query(
    _ONE_PAPER
    + """, papers_found as (select query_id, target_id, max(similarity) best, min((position, query_passage_id, target_passage_id)) first from other group by all),
  ranks as (select *, row_number() over (partition by query_id order by best desc, first) as rank from papers_found qualify row_number() over (partition by query_id order by best desc, first) <= 5)
  select o.query_id, r.rank::int as rank, o.target_id, m.target_title, query_passage_id, target_passage_id, similarity from other o join ranks r using (query_id, target_id)
  left join (select arxiv_id, min(title) target_title from papers group by 1) m on m.arxiv_id = o.target_id"""
)
def g12_query_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of a service for one paper, here that of the greatest id, against all rows."""
    p = _passages(spark, sf_dir)
    asked = p.where("embedding is not null and size(embedding) = 64").agg(F.max("arxiv_id")).head()[0]
    return S.query_paper(asked, p, table(spark, sf_dir, "papers"), 5)


@query(
    _NEAR
    + """, scored as (select *, round(coalesce(t_score, 0) - similarity, 6) as score from other),
  papers_found as (select query_id, target_id, max(score) best, min((position, query_passage_id, target_passage_id)) first from scored group by all),
  ranks as (select *, row_number() over (partition by query_id order by best desc, first) as rank from papers_found qualify row_number() over (partition by query_id order by best desc, first) <= 5)
  select o.query_id, r.rank::int as rank, o.target_id, query_passage_id, target_passage_id, similarity from scored o join ranks r using (query_id, target_id)"""
)
def tc_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with a deterministic stand-in for the reranker: papers order by its score, similarity stays."""
    p = _passages(spark, sf_dir)
    scores = p.select(F.col("passage_id").alias("target_passage_id"), F.coalesce("score", F.lit(0.0)).alias("t"))

    def scorer(found: DataFrame) -> DataFrame:
        return found.join(scores, "target_passage_id").withColumn("score", F.round(F.col("t") - F.col("similarity"), 6)).drop("t")

    return S.find_similar(query_papers(p), p, table(spark, sf_dir, "papers"), 5, scorer).drop("target_title")


@query(
    _NEAR
    + """, w as (select query_id, target_id, similarity * coalesce(s, 0) * coalesce(t_score, 0) as weighted, query_passage_id, target_passage_id from other
    qualify row_number() over (partition by query_id, target_id order by similarity * coalesce(s, 0) * coalesce(t_score, 0) desc, query_passage_id, target_passage_id) <= 3)
  select query_id, target_id, round(avg(weighted), 6) as score, count(*) as pairs from w group by all"""
)
def u16_similar_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by the salience-weighted mean of their three best passage pairs."""
    p = _passages(spark, sf_dir)
    return S.similar_papers(query_papers(p), p, 5)


@query(
    f"""with t as ({_V}) select a.arxiv_id, a.passage_id as a, b.passage_id as b, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as similarity
    from t a join t b on a.arxiv_id = b.arxiv_id and a.passage_id < b.passage_id where round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) >= 0.9"""
)
def j6_pairs_within_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar passages of one paper."""
    return S.pairs_within_paper(_passages(spark, sf_dir), 0.9)


@query(
    """select count(*) filter (where v is null) as null_vectors, count(*) filter (where v is not null and list_dot_product(v, v) = 0) as zero_vectors,
    count(*) filter (where v is not null and list_dot_product(v, v) > 0) as usable, count(distinct len(v)) as dims from (select embedding::double[] as v from techniques)"""
)
def proj7_vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of null, zero and usable vectors, and of vector lengths."""
    v = F.col("embedding")
    return table(spark, sf_dir, "techniques").agg(
        F.count_if(v.isNull()).alias("null_vectors"),
        F.count_if(v.isNotNull() & ~D.usable_vector(v)).alias("zero_vectors"),
        F.count_if(D.usable_vector(v)).alias("usable"),
        F.countDistinct(F.when(v.isNotNull(), F.size(v))).alias("dims"),
    )


@query(f"with t as ({_V}) select passage_id, round(n, 5) as norm, round(list_dot_product(v, v) / (n * n), 6) as unit_norm from t")
def x42_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector lengths before and after scaling."""
    t = table(spark, sf_dir, "techniques").where(D.usable_vector(F.col("embedding")))
    u = D.unit(F.col("embedding"))
    return t.select("passage_id", F.round(D.norm(F.col("embedding")), 5).alias("norm"), F.round(D.dot(u, u), 6).alias("unit_norm"))


@query(
    """with e as (select vec_id, label, embedding::double[] v from embeddings), q as (select * from e where vec_id % 20 = 0),
  pairs as (select q.vec_id as query_id, e.label, max(round(list_dot_product(q.v, e.v), 6)) as best from q, e where q.label <> e.label group by all)
  select query_id, label, best from pairs qualify row_number() over (partition by query_id order by best desc, label) <= 3"""
)
def w3_best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 20th vector the three other labels with the best vector."""
    from quirework.operators.ranking import top_by

    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), F.col("embedding").alias("q"))
    best = S.best_labels(q, e.select("label", "embedding"))
    return top_by(best, ["query_id"], [F.desc("best"), F.col("label")], 3)


QUERIES, ORACLE = query.queries, query.oracle
