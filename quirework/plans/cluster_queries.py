"""Queries over cluster trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.operators import cluster_tree as C
from quirework.plans._collect import Collected
from quirework.scratch import Scratch
from quirework.session import table

query = Collected()

_UP = """with recursive up as (select cluster_id, cluster_id as ancestor_id, 0 as distance from cluster_metadata
  union all select u.cluster_id, m.parent_cluster_id, u.distance + 1 from up u join cluster_metadata m on m.cluster_id = u.ancestor_id where m.parent_cluster_id <> -1)"""
_LEAF = "(select distinct cluster_id, arxiv_id, certainty from clusters where cluster_id not in (select parent_cluster_id from cluster_metadata))"


@query(_UP + " select cluster_id, ancestor_id, distance::int as distance from up")
def a2_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with each of its ancestors."""
    return C.ancestors(table(spark, sf_dir, "cluster_metadata"), Scratch(spark, "a2"))


@query(_UP + f" select u.ancestor_id as cluster_id, count(distinct l.arxiv_id) as size from {_LEAF} l join up u on u.cluster_id = l.cluster_id group by 1")
def a2_rolled_up_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of each cluster, rolled up from the leaves."""
    tree = table(spark, sf_dir, "cluster_metadata")
    leaves = C.leaf_memberships(table(spark, sf_dir, "clusters"), tree)
    return C.sizes(C.expanded_memberships(leaves, tree, Scratch(spark, "a2")))


@query(
    """select m.cluster_id, m.label, m.size as stored, coalesce(c.n, 0) as counted, coalesce(c.n, 0) <> m.size as stale
    from cluster_metadata m left join (select cluster_id, count(distinct arxiv_id) n from clusters group by 1) c using (cluster_id)"""
)
def a18_cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and counted sizes of clusters."""
    n = C.sizes(table(spark, sf_dir, "clusters")).withColumnRenamed("size", "n")
    m = table(spark, sf_dir, "cluster_metadata").join(n, "cluster_id", "left").withColumn("counted", F.coalesce("n", F.lit(0)))
    return m.select("cluster_id", "label", F.col("size").alias("stored"), "counted", (F.col("counted") != F.col("size")).alias("stale"))


@query(f"select l.cluster_id, l.arxiv_id, p.title from {_LEAF} l join (select arxiv_id, min(title) title from papers group by 1) p using (arxiv_id)")
def j2_leaf_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the leaf clusters with their titles."""
    leaves = C.leaf_memberships(table(spark, sf_dir, "clusters"), table(spark, sf_dir, "cluster_metadata")).select("cluster_id", "arxiv_id", "certainty").distinct()
    titles = table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(F.min("title").alias("title"))
    return leaves.join(titles, "arxiv_id").select("cluster_id", "arxiv_id", "title")


_XY = "(select arxiv_id, min(area_embedding[1])::double as x, min(area_embedding[2])::double as y from papers where area_embedding is not null group by 1)"


@query(
    f"""select cluster_id, count(*) as n, round(avg(x), 6) as x, round(avg(y), 6) as y from (select distinct cluster_id, arxiv_id from clusters) c
    join {_XY} using (arxiv_id) group by 1"""
)
def a1_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coordinates of each cluster's members: two vector components stand for the coordinates."""
    xy = table(spark, sf_dir, "papers").where("area_embedding is not null").groupBy("arxiv_id").agg(F.min(F.col("area_embedding")[0]).cast("double").alias("x"), F.min(F.col("area_embedding")[1]).cast("double").alias("y"))
    rows = table(spark, sf_dir, "clusters").join(xy.select("arxiv_id"), "arxiv_id", "left_semi")
    return C.approximate_centroids(rows, xy, 1 << 30, 7).select("cluster_id", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    f"""select cluster_id, count(*) as n, round(avg(x), 6) as x, round(avg(y), 6) as y from (select c.*, x, y from (select distinct cluster_id, arxiv_id from clusters) c join {_XY} using (arxiv_id)
    qualify row_number() over (partition by cluster_id order by md5('7|' || cluster_id || '|' || arxiv_id), arxiv_id) <= 5) group by 1"""
)
def a1_sampled_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from 5 seeded members of each cluster: the feature is the sample."""
    xy = table(spark, sf_dir, "papers").where("area_embedding is not null").groupBy("arxiv_id").agg(F.min(F.col("area_embedding")[0]).cast("double").alias("x"), F.min(F.col("area_embedding")[1]).cast("double").alias("y"))
    rows = table(spark, sf_dir, "clusters").join(xy.select("arxiv_id"), "arxiv_id", "left_semi")
    return C.approximate_centroids(rows, xy, 5, 7).select("cluster_id", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """select cluster_id, arxiv_id from (select cluster_id, arxiv_id, max(certainty) c from clusters where certainty is not null group by all)
    qualify row_number() over (partition by cluster_id order by c desc, arxiv_id) <= 3"""
)
def u7_typical_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most certain papers of each cluster, as a labelling model is shown them."""
    rows = table(spark, sf_dir, "clusters").where("certainty is not null").groupBy("cluster_id", "arxiv_id").agg(F.max("certainty").alias("c"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("c"), "arxiv_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 3").select("cluster_id", "arxiv_id")


@query("select parent_cluster_id as cluster_id, count(*) as children, string_agg(cluster_id::varchar, ',' order by cluster_id) as child_ids from cluster_metadata where parent_cluster_id <> -1 group by 1")
def u7_sibling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each cluster, which are labelled together before their parent."""
    m = table(spark, sf_dir, "cluster_metadata").where("parent_cluster_id <> -1")
    ids = F.transform(F.array_sort(F.collect_list("cluster_id")), lambda x: x.cast("string"))
    return m.groupBy(F.col("parent_cluster_id").alias("cluster_id")).agg(F.count("*").alias("children"), F.array_join(ids, ",").alias("child_ids"))


@query()
def u6_density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the papers of each category."""
    p = table(spark, sf_dir, "papers").where("primary_category is not null").groupBy("arxiv_id").agg(F.min("primary_category").alias("primary_category"), F.first("area_embedding", True).alias("area_embedding"))
    return C.clusters_within(p, "primary_category", "arxiv_id", "area_embedding", Scratch(spark, "u6"))


@query(
    """select count(*) as papers, count(*) - count(distinct arxiv_id) as repeated, count(*) filter (where title is null or trim(title) = '' or abstract is null or trim(abstract) = '') as without_text,
    count(distinct embedding_dim) as dims, count(distinct model_name) as models, count(*) filter (where area_embedding is null) as without_vector from papers"""
)
def g15_cluster_input_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps papers from being clustered together."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    one = table(spark, sf_dir, "papers").agg(
        F.count("*").alias("papers"),
        F.countDistinct("arxiv_id").alias("d"),
        F.count_if(blank("title") | blank("abstract")).alias("without_text"),
        F.countDistinct("embedding_dim").alias("dims"),
        F.countDistinct("model_name").alias("models"),
        F.count_if(F.col("area_embedding").isNull()).alias("without_vector"),
    )
    return one.select("papers", (F.col("papers") - F.col("d")).alias("repeated"), "without_text", "dims", "models", "without_vector")


QUERIES, ORACLE = query.queries, query.oracle
