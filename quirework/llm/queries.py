"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import near_duplicates as nd
from quirework.llm.oracle import ORACLE
from quirework.llm import clusters, markup, mixing, neighbours, repetition, splitting, tokens
from quirework.scratch import Scratch
from quirework.session import table

__all__ = ["ORACLE", "QUERIES"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages of one group of near-duplicates."""
    members, groups, _ = nd.near_duplicates(table(spark, sf_dir, "techniques"), Scratch(spark, "p1"), complete=False)
    return nd.pairs_of_groups(nd.grouped_rows(members, groups)).select(F.col("a").alias("passage_id_a"), F.col("b").alias("passage_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage with words: its class of near-duplicates, named by its smallest id, and the size of that."""
    members, groups, _ = nd.near_duplicates(table(spark, sf_dir, "techniques"), Scratch(spark, "p1"), complete=False)
    rows = nd.grouped_rows(members, groups)
    named = rows.groupBy("group").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, "group").select(F.col("id").alias("passage_id"), "class_id", "class_size")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of both tables that had to be cut."""
    pieces = splitting.oversized_paragraphs(table(spark, sf_dir, "sections"), table(spark, sf_dir, "paragraphs"), with_text=False)
    return pieces.where("piece_index = 0").select("table_name", "arxiv_id", "section_index", "paragraph_index")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized paragraph."""
    return splitting.oversized_paragraphs(table(spark, sf_dir, "sections"), table(spark, sf_dir, "paragraphs"))


def p2_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of files that hold the paragraphs of all sections, split from byte ranges."""
    files = splitting.text_files(table(spark, sf_dir, "sections"), Scratch(spark, "p2"))
    pieces = splitting.split_files(spark, files, range_bytes=1 << 20)
    return pieces.select(F.regexp_extract("path", r"file=([0-9]+)", 1).cast("int").alias("file"), "start", "end", "piece")


def _vector_tables(spark: SparkSession, sf_dir: str) -> list:
    return [
        ("techniques", table(spark, sf_dir, "techniques"), "passage_id", "embedding"),
        ("papers", table(spark, sf_dir, "papers"), "arxiv_id", "area_embedding"),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with a cosine of at least 0.95, one among the 5 best of the other."""
    return neighbours.found_pairs(neighbours.nearest(_vector_tables(spark, sf_dir), Scratch(spark, "p3")))


def p3_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar rows, whatever their cosine, of every 20th technique and paper by the digest of its id."""
    techniques, papers = _vector_tables(spark, sf_dir)
    every = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20 == 0
    return neighbours.nearest_of_queries(techniques, every, Scratch(spark, "p3")).unionByName(neighbours.nearest_of_queries(papers, every, Scratch(spark, "p3"))).withColumn("cosine", F.round("cosine", 5))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of each cluster of 8 or more linked by a cosine of at least 0.8."""
    ids, comps, _ = clusters.linked(table(spark, sf_dir, "papers"), Scratch(spark, "p4"))
    return clusters.clusters_of(ids, comps).select("cluster_key", F.col("id").alias("arxiv_id"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical papers of each cluster after loose ones are divided, beside the cluster of the earlier run."""
    scratch = Scratch(spark, "p4")
    papers = table(spark, sf_dir, "papers")
    ids, comps, _ = clusters.linked(papers, scratch)
    members = clusters.parted(ids, comps, clusters.directions(papers), scratch)
    known = table(spark, sf_dir, "clusters").select(F.col("arxiv_id").alias("id"), "cluster_id")
    return clusters.described(members, None, known)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of sections and statements that still hold markup."""
    return markup.residue(table(spark, sf_dir, "sections"), table(spark, sf_dir, "statements"))


def p6_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every item, with headings, lists, code blocks and formulas."""
    return markup.plain_texts(table(spark, sf_dir, "sections"), table(spark, sf_dir, "statements"), Scratch(spark, "p6"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents of the listed sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), Scratch(spark, "p8"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each listed source."""
    return mixing.shares(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), Scratch(spark, "p8")))


def p8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each output shard of the mixture holds of each source."""
    return mixing.shard_shares(mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), Scratch(spark, "p8"))[0])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least a quarter of the words is repeated."""
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and exact repeated share of every document."""
    return repetition.repetition(table(spark, sf_dir, "documents")).select("doc_id", "words", F.round("repeated_share", 6).alias("repeated_share"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of repetition of every document, with the trees' estimate of its share."""
    return repetition.repetition(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_file_pieces": p2_file_pieces,
    "p3_found": p3_found,
    "p3_top5": p3_top5,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p6_found": p6_found,
    "p6_plain": p6_plain,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_shards": p8_shards,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_scores": p9_scores,
}
