"""Queries over stored tables: upserts, selections, joins and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import records as C
from quirework.operators import storage as S
from quirework.plans._collect import Collected
from quirework.session import table

query = Collected()

_CUT = "timestamp '2033-01-01'"


@query(
    f"""with t as (select md5(arxiv_id || ':' || passage) as k, passage_id, arxiv_id, passage, score, loaded_at from techniques where passage is not null),
    old as (select * from t where loaded_at < {_CUT} qualify row_number() over (partition by k order by loaded_at, passage_id) = 1),
    new as (select * from t where loaded_at >= {_CUT} qualify row_number() over (partition by k order by loaded_at desc, passage_id desc) = 1)
    select coalesce(o.passage_id, n.passage_id) as passage_id, coalesce(o.arxiv_id, n.arxiv_id) as arxiv_id, case when n.k is not null then n.score else o.score end as score
    from old o full join new n on o.k = n.k"""
)
def k6_upsert_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later deliveries put into earlier ones: a known passage changes its vector and score only."""
    t = table(spark, sf_dir, "techniques").where("passage is not null").select("passage_id", "arxiv_id", "passage", "embedding", "score", "loaded_at")
    cut = F.lit("2033-01-01").cast("timestamp")
    from quirework.operators.ranking import first_by

    old = first_by(t.where(F.col("loaded_at") < cut).withColumn("k", S.passage_key()), ["k"], [F.col("loaded_at"), F.col("passage_id")]).drop("k")
    return S.upsert("techniques", old, t.where(F.col("loaded_at") >= cut), [F.col("loaded_at"), F.col("passage_id")]).select("passage_id", "arxiv_id", "score")


@query(
    """with o as (select arxiv_id, cluster_id, max(certainty) as certainty from clusters where cluster_id % 2 = 0 group by all),
    n as (select arxiv_id, cluster_id, min(certainty) as certainty from clusters where certainty is not null group by all)
    select coalesce(o.arxiv_id, n.arxiv_id) as arxiv_id, coalesce(o.cluster_id, n.cluster_id) as cluster_id, case when n.arxiv_id is not null then n.certainty else o.certainty end as certainty
    from o full join n on o.arxiv_id = n.arxiv_id and o.cluster_id = n.cluster_id"""
)
def k6_upsert_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships put into a table keyed by paper and cluster."""
    c = table(spark, sf_dir, "clusters")
    old = c.where("cluster_id % 2 = 0").groupBy("arxiv_id", "cluster_id").agg(F.max("certainty").alias("certainty"))
    new = c.where("certainty is not null").groupBy("arxiv_id", "cluster_id").agg(F.min("certainty").alias("certainty"))
    return S.upsert("clusters", old, new, [F.col("certainty")])


@query("select arxiv_id, cluster_id, certainty from clusters where cluster_id = 1 and certainty is not null")
def s9_select_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the rows that equal given values; the filter reaches the scan."""
    return S.select(table(spark, sf_dir, "clusters"), ["arxiv_id", "cluster_id", "certainty"], {"cluster_id": 1}).where("certainty is not null")


@query("select passage_id, p.title, t.score from techniques t join (select arxiv_id, min(title) title, min(embedding_dim) d from papers group by 1) p using (arxiv_id) where t.embedding is not null and len(t.embedding) = p.d")
def j3_techniques_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with their paper's title, where the vector has the paper's dimension."""
    p = table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(F.min("title").alias("title"), F.min("embedding_dim").alias("d"))
    t = table(spark, sf_dir, "techniques").where("embedding is not null").select("arxiv_id", "passage_id", "score", F.size("embedding").alias("n"))
    return t.join(p, "arxiv_id").where("n = d").select("passage_id", "title", "score")


@query(
    """select c.arxiv_id, c.cluster_id, p.x is not null as has_coordinates from (select distinct arxiv_id, cluster_id from clusters) c
    left join (select arxiv_id, min(area_embedding[1]) as x from papers where area_embedding is not null group by 1) p using (arxiv_id)"""
)
def j1_memberships_with_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships and whether their paper has coordinates; a strict run ends with an error instead."""
    p = table(spark, sf_dir, "papers").where("area_embedding is not null").groupBy("arxiv_id").agg(F.min(F.col("area_embedding")[0]).alias("x"))
    return table(spark, sf_dir, "clusters").select("arxiv_id", "cluster_id").distinct().join(p, "arxiv_id", "left").select("arxiv_id", "cluster_id", F.col("x").isNotNull().alias("has_coordinates"))


@query(
    """select p.arxiv_id, p.section_index, p.paragraph_index, coalesce(s.n, -1) as in_section, s.arxiv_id is null as section_missing from (select distinct arxiv_id, section_index, paragraph_index from paragraphs) p
    left join (select distinct arxiv_id, section_index, len(text) as n from sections) s using (arxiv_id, section_index)"""
)
def j7_paragraphs_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph with its section by a key of several columns; some sections were not delivered."""
    s = table(spark, sf_dir, "sections").select("arxiv_id", "section_index", F.size("text").cast("long").alias("n")).distinct().withColumn("here", F.lit(True))
    p = table(spark, sf_dir, "paragraphs").select("arxiv_id", "section_index", "paragraph_index").distinct()
    return p.join(s, ["arxiv_id", "section_index"], "left").select("arxiv_id", "section_index", "paragraph_index", F.coalesce("n", F.lit(-1).cast("long")).alias("in_section"), F.col("here").isNull().alias("section_missing"))


@query("select arxiv_id, cast(count(*) as bigint) as papers, cast(sum(n) as bigint) as passages from (select arxiv_id, count(*) as n from techniques group by 1) group by 1")
def j11_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages joined to papers with the papers' side checked to be unique."""
    from quirework.operators.ranking import require_unique

    p = require_unique(table(spark, sf_dir, "techniques").groupBy("arxiv_id").agg(F.count("*").alias("n")), ["arxiv_id"])
    return p.groupBy("arxiv_id").agg(F.count("*").alias("papers"), F.sum("n").alias("passages"))


@query("select event_id, list_sort(json_keys(props)) as keys from events where props is not null and json_valid(props)")
def x46_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of JSON objects, as the exact key set of an answer is checked."""
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.array_sort(F.json_object_keys("props")).alias("keys"))


@query("select event_id, case event_id % 6 when 1 then 'not an object' when 2 then 'wrong keys' when 3 then 'no category' when 4 then 'no evidence' when 5 then 'blank quote' end as problem from events")
def x46_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a connection's answer is refused; answers are made of events, five of six broken in one way each."""
    kind = F.pmod("event_id", F.lit(6))
    nothing = F.lit(None).cast("struct<description: string>")
    quote = F.struct(F.lit("s0_p0").alias("block_id"), F.when(kind == 5, " ").otherwise(F.col("event_type")).alias("quote"))
    evidence = F.when(kind == 4, F.array().cast("array<struct<block_id: string, quote: string>>")).otherwise(F.array(quote))
    fields = [
        F.when(kind == 3, " ").otherwise(F.col("event_type")).alias("category"), F.lit("reduction").alias("relation_type"), F.array(F.lit("a"), F.lit("b")).alias("objects"), F.array(F.lit("x")).alias("fields"),
        evidence.alias("evidence"), nothing.alias("objective"), nothing.alias("obstacle"), nothing.alias("benefit"),
    ]
    whole = {"ignoreNullFields": "false"}
    answer = F.when(kind == 1, "[1, 2]").when(kind == 2, F.to_json(F.struct(*fields[1:]), whole)).otherwise(F.to_json(F.struct(*fields), whole))
    return table(spark, sf_dir, "events").select("event_id", C.connection_problem(answer).alias("problem"))


@query("select arxiv_id, to_json(min(authors))::varchar as authors from papers where authors is not null group by 1")
def x49_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author lists as JSON inside a field."""
    return table(spark, sf_dir, "papers").where("authors is not null").groupBy("arxiv_id").agg(F.min("authors").alias("authors")).select("arxiv_id", F.to_json("authors").alias("authors"))


@query("select arxiv_id, sha256(coalesce(title, '') || chr(10) || coalesce(abstract, '')) as fingerprint from (select arxiv_id, min(title) title, min(abstract) abstract from papers group by 1) where arxiv_id not in (select arxiv_id from sections)")
def s20_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without a cached row of their fingerprint: the cache holds those with sections."""
    p = table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(F.min("title").alias("title"), F.min("abstract").alias("abstract"))
    mark = F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("abstract", F.lit(""))), 256)
    cached = p.join(table(spark, sf_dir, "sections").select("arxiv_id"), "arxiv_id", "left_semi").select("arxiv_id", mark.alias("fingerprint"))
    return S.cache_misses(p, cached, "arxiv_id", mark).select("arxiv_id", "fingerprint")


@query(
    """with d as (select vec_id, [abs(embedding[1]), abs(embedding[2]), abs(embedding[3])]::double[] as m from embeddings)
    select vec_id, list_transform(list_transform(m, lambda x: x / list_sum(m)), lambda x: round(x, 6)) as p from d"""
)
def x39_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses scaled to sum 1."""
    from quirework.functions import distributions as D

    e = F.col("embedding")
    m = F.transform(F.slice(e, 1, 3), lambda x: F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(D.normalised(m, 3), lambda x: F.round(x, 6)).alias("p"))


@query("select arxiv_id, section_index, statement_index, statement_index <> section_index and statement_index between 0 and 9 and section_index between 0 and 9 as valid from statements")
def x48_valid_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked selections checked for count, range and repeats; answers are made from ids."""
    s = table(spark, sf_dir, "statements").select("arxiv_id", "section_index", "statement_index")
    answer = F.concat(F.lit("["), F.col("statement_index").cast("string"), F.lit(", "), F.col("section_index").cast("string"), F.lit("]"))
    return s.select("*", C.valid_selection(answer, F.lit(2), F.lit(10)).alias("valid"))


QUERIES, ORACLE = query.queries, query.oracle
