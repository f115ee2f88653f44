"""Queries that stand before or behind a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import models as M
from quirework.operators import ranking as R
from quirework.operators import techniques as T
from quirework.operators import workflow as W
from quirework.plans._collect import Collected
from quirework.session import table

query = Collected()


@query()
def u5_merge_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's 20 best passages with similar ones joined; the join depends on order, so it has no SQL."""
    return T.merge_similar(table(spark, sf_dir, "techniques"), 0.9).select("arxiv_id", "passage_id", "score", "members")


@query()
def u8_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates of every paper on the principal axes of all vectors."""
    p = table(spark, sf_dir, "papers").select("arxiv_id", "area_embedding").dropDuplicates(["arxiv_id"])
    return W.coordinates(p)


@query(f"select passage_id, list_transform(range(0, 5), lambda place: ('0x' || substr(sha256(coalesce(passage, '')), (2 * place + 1)::int, 2))::int / 64.0) as logits from techniques")
def u3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a deterministic stand-in classifier for every passage."""
    return M.scored(table(spark, sf_dir, "techniques").select("passage_id", "passage"), "passage", M.stand_in_scorer()).drop("passage")


@query(
    """with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
    n as (select doc_id, w, greatest(1, ceil((len(w) - 16) / 48.0))::int as n from t)
    select doc_id, n::bigint as windows, len(w[(n - 1) * 48 + 1 : (n - 1) * 48 + 64])::bigint as last_size, array_to_string(w[1:3], ' ') as opening from n"""
)
def u3_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows of 64 that share 16, for texts longer than a model takes."""
    from quirework.operators.documents import tokens

    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    d = d.withColumn("x", M.windows(F.col("w"), 64, 16))
    return d.select("doc_id", F.size("x").cast("long").alias("windows"), F.size(F.element_at("x", -1)).cast("long").alias("last_size"), F.array_join(F.slice("w", 1, 3), " ").alias("opening"))


@query(
    """with w as (select arxiv_id as passage_id, unnest(range(1, 6)) as c, embedding from techniques where embedding is not null and arxiv_id is not null)
    select passage_id, round(avg(embedding[c]::double) filter (where c = 1), 6) as first, round(avg(embedding[c]::double) filter (where c = 5), 6) as last from w group by 1"""
)
def a4_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five outputs pooled by their mean over all windows of an item: a paper's passages stand for its windows."""
    w = table(spark, sf_dir, "techniques").where("embedding is not null and arxiv_id is not null").select(F.col("arxiv_id").alias("passage_id"), F.slice("embedding", 1, 5).cast("array<double>").alias("logits"))
    p = T.pooled(w)
    return p.select("passage_id", F.round(F.col("logits")[0], 6).alias("first"), F.round(F.col("logits")[4], 6).alias("last"))


@query(
    """with t as (select passage_id, regexp_extract_all(lower(coalesce(passage, '')), '[a-z0-9]+') as a, regexp_extract_all(lower(arxiv_id), '[a-z0-9]+') as b from techniques where arxiv_id is not null),
    k as (select *, case when len(a) <= 25 then len(a) else least(len(a), 50 - least(len(b), 25)) end as ka from t)
    select passage_id, ka::bigint as left_tokens, least(len(b), 50 - ka)::bigint as right_tokens from k"""
)
def x35_pair_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that the two texts of a reranker's pair keep of a budget of 50."""
    from quirework.operators.documents import tokens

    a, b = M.pair_budget(tokens(F.col("passage")), tokens(F.col("arxiv_id")), 50)
    t = table(spark, sf_dir, "techniques").where("arxiv_id is not null")
    return t.select("passage_id", F.size(a).cast("long").alias("left_tokens"), F.size(b).cast("long").alias("right_tokens"))


_U = "((('0x' || substr(md5('5|' || passage_id), 1, 10))::bigint + 0.5) / 1099511627776.0)"


@query(f"select passage_id, coalesce(score, 0.0) as w from techniques order by case when coalesce(score, 0.0) > 0 then -ln({_U}) / score else 'infinity'::double end, passage_id limit 200")
def u13_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded weighted sample of passages without replacement: the sample is the feature."""
    t = table(spark, sf_dir, "techniques").select("passage_id", F.coalesce("score", F.lit(0.0)).alias("w"))
    return t.orderBy(R.weighted_order(5, F.col("w"), "passage_id"), "passage_id").limit(200)


@query()
def u14_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a high score by logistic regression on five vector components."""
    t = table(spark, sf_dir, "techniques").where("embedding is not null and score is not null").select("passage_id", F.slice("embedding", 1, 5).cast("array<double>").alias("x"), (F.col("score") >= 2.7).cast("int").alias("y"))
    return M.logistic_probabilities(t, t, "x", "y").select("passage_id", "y", "probability")


QUERIES, ORACLE = query.queries, query.oracle
