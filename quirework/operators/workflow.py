"""The pipeline's steps as jobs: select, download, embed, generate_coords, cluster, generate_centroids; each resumes from what is stored.

Sources come from a folder of archives instead of the network, and models are
plugged in: the command line takes the name of a function that loads one.
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.functions.text import labelled_paragraph
from quirework.operators import answers, cluster_tree, models, storage, techniques
from quirework.operators.deltas import Store
from quirework.operators.ranking import require_unique, top_by
from quirework.scratch import Scratch
from quirework.sources import artifacts, files, metadata

log = logging.getLogger(__name__)


def select_papers(spark: SparkSession, archives: list[str], output: str, days_back: int | None, max_results: int | None, categories: list[str], keywords: list[str], today: dt.date | None = None) -> DataFrame:
    """Writes the selected papers of ZIP snapshots as JSON lines and returns them."""
    if days_back is not None and days_back < 0:
        raise ValueError("days must not be negative")
    if output in archives:
        raise ValueError("the output must differ from the input")
    today = today or dt.datetime.now(dt.UTC).date()
    start = today - dt.timedelta(days=days_back) if days_back is not None else None
    rows = metadata.select_records(metadata.zip_member_lines(spark, archives), categories, keywords, start, today if start else None, max_results, ["path", "position"])
    storage.write_atomic(rows, output, "json")
    return spark.read.schema(rows.schema).json(output)


def parse_archives(spark: SparkSession, wanted: DataFrame, archives: DataFrame, target: str, include_proofs: bool = False) -> DataFrame:
    """Adds the sections of wanted archives that are not yet stored under ``target``; papers without sections are stored too."""
    try:
        stored = spark.read.parquet(target)
        wanted = files.still_to_fetch(wanted, stored)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    files.sections_of_archives(archives.join(wanted, "arxiv_id", "left_semi"), include_proofs).write.mode("append").parquet(target)
    return spark.read.parquet(target)


def coordinates(papers: DataFrame, id_col: str = "arxiv_id", vector: str = "area_embedding") -> DataFrame:
    """(id, x, y) on the two principal axes of the vectors: a linear stand-in for neighbour embeddings, and not equal to them."""
    return models.projected(papers, id_col, vector, *models.principal_axes(papers, vector))


def cluster(spark: SparkSession, papers: DataFrame, min_cluster_size: int = 5, name: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """((cluster_id, arxiv_id, certainty), (cluster_id, size, parent_cluster_id)) of papers with unique ids and vectors of one length."""
    rows = require_unique(papers.where("arxiv_id is not null and area_embedding is not null").select("arxiv_id", "area_embedding"), ["arxiv_id"])
    return cluster_tree.whole_tree(rows, "arxiv_id", "area_embedding", Scratch(spark, name), min_cluster_size)


def check_papers(papers: DataFrame) -> list[str]:
    """What keeps papers from being clustered together: repeated ids, missing text or vectors, several lengths or models; one pass of aggregates."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    usable = D.usable_vector(F.col("area_embedding"))
    r = papers.agg(
        (F.count("*") - F.countDistinct("arxiv_id")).alias("repeated ids"),
        F.count_if(blank("title") | blank("abstract")).alias("papers without title or abstract"),
        F.count_if(~usable).alias("papers without a usable vector"),
        F.greatest(F.lit(0), F.countDistinct(F.size("area_embedding")) - 1).alias("further lengths of vectors"),
        F.greatest(F.lit(0), F.countDistinct("model_name") - 1).alias("further models"),
    ).head()
    return [f"{n} {what}" for what, n in r.asDict().items() if n]


def check_options(min_cluster_size: int = 5, min_samples: int | None = None, batch_size: int = 500, merge_threshold: float = 0.9, pooling: str = "mean", samples: int = 20) -> None:
    """Raises for options that no step can work with."""
    if min_cluster_size < 2:
        raise ValueError("a cluster needs two members")
    if min_samples is not None and min_samples < 1:
        raise ValueError("min_samples must be positive")
    if batch_size < 1 or samples < 1:
        raise ValueError("sizes must be positive")
    if not 0 <= merge_threshold <= 1:
        raise ValueError("the threshold of a merge lies between 0 and 1")
    if pooling not in ("mean", "max"):
        raise ValueError("pooling is mean or max")


def techniques_of(papers: DataFrame, sections: DataFrame, encoder: answers.Load, scorer: answers.Load, merge_threshold: float = 0.9, k: float = techniques.LEAST_SCORE, pooling: str = "mean") -> DataFrame:
    """(passage_id, arxiv_id, passage, score, embedding): each paper's passages that are worth keeping.

    Every non-blank paragraph is scored in token windows, 0 to 4; the 20 best are
    embedded, similar ones joined and, where joined, embedded again; the threshold
    rises with the place.
    """
    one = sections.dropDuplicates(["arxiv_id", "section_index"]).join(papers.select("arxiv_id").distinct(), "arxiv_id", "left_semi")
    p = one.select("arxiv_id", "section_index", "section_header", F.posexplode("text").alias("paragraph_index", "passage")).where(F.trim(F.coalesce("passage", F.lit(""))) != "")
    p = p.withColumn("passage_id", F.concat_ws("::", "arxiv_id", F.format_string("%06d", "section_index"), F.format_string("%06d", "paragraph_index")))
    words = F.split(labelled_paragraph(F.col("section_header"), F.col("passage")), r"\s+")
    scores = answers.scored_passages(p.select("passage_id", words.alias("w")), "passage_id", F.col("w"), scorer, pooling=pooling)
    rated = p.join(scores.select("passage_id", D.expected_class(D.softmax(F.col("logits")), 0).alias("score")), "passage_id")
    best = top_by(rated, ["arxiv_id"], [F.desc("score"), F.col("passage_id")], techniques.BEST)
    joined = techniques.merge_similar(answers.embedded(best, "passage", encoder, answers.DOCUMENT_PROMPT), merge_threshold)
    again = answers.embedded(joined.where("members > 1").drop("embedding"), "passage", encoder, answers.DOCUMENT_PROMPT)
    names = ["passage_id", "arxiv_id", "passage", "score", "embedding"]
    rows = joined.where("members = 1").select(*names[:-1], F.col("embedding").cast("array<float>").alias("embedding")).unionByName(again.select(*names[:-1], F.col("embedding").cast("array<float>").alias("embedding")))
    return techniques.above_threshold(rows, "score", ["passage_id"], k).select(*names)


def area_vectors(papers: DataFrame, encoder: answers.Load, model_name: str) -> DataFrame:
    """The papers with area_embedding, embedding_dim and model_name: the vector of title and abstract."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit("")))
    rows = answers.embedded(papers.withColumn("__area", text), "__area", encoder, answers.CLUSTER_PROMPT, "area_embedding").drop("__area")
    return rows.withColumn("area_embedding", F.col("area_embedding").cast("array<float>")).withColumn("embedding_dim", F.size("area_embedding")).withColumn("model_name", F.lit(model_name))


def embed_papers(
    spark: SparkSession, papers: DataFrame, sections: DataFrame, output: str, encoder: answers.Load, scorer: answers.Load, batch_size: int = 500, merge_threshold: float = 0.9, model_name: str = "plugged", store: Store | None = None
) -> int:
    """Runs the batches of papers that are not done, stores them below ``output`` and, with a store, uploads each in one commit; returns how many were run."""
    check_options(batch_size=batch_size, merge_threshold=merge_threshold)

    def embed(own: DataFrame) -> tuple[DataFrame, DataFrame]:
        return area_vectors(own, encoder, model_name), techniques_of(own, sections, encoder, scorer, merge_threshold)

    settings = {"batch_size": batch_size, "merge_threshold": merge_threshold, "model_name": model_name}
    return artifacts.run_batches(spark, papers, output, batch_size, embed, settings, store)


def centroids(memberships: DataFrame, coordinates_: DataFrame, samples: int, seed: int) -> DataFrame:
    return cluster_tree.approximate_centroids(memberships, coordinates_, samples, seed)


def batches_done(spark: SparkSession, manifest: str, settings: dict) -> int:
    """Number of finished batches of a resumable run; other settings than those of its start are an error."""
    known = storage.read_manifest(spark, manifest)
    if known["settings"] != settings:
        raise ValueError("the run was begun with other settings")
    return known["done"] if known["state"] == "completed" else known["done"] - 1


def _plugged(name: str | None, stand_in: answers.Load) -> answers.Load:
    """The function package.module:name, or the deterministic stand-in."""
    if name is None:
        return stand_in
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("quirework")
    sub = parser.add_subparsers(dest="command", required=True)
    select = sub.add_parser("select", help="papers of snapshots")
    select.add_argument("archives", nargs="+")
    select.add_argument("--days-back", type=int)
    select.add_argument("--max-results", type=int)
    select.add_argument("--categories", nargs="*", default=[])
    select.add_argument("--keywords", nargs="*", default=[])
    download = sub.add_parser("download", help="sections of the archives in a folder, named by id")
    download.add_argument("papers")
    download.add_argument("archives")
    download.add_argument("--include-proofs", action="store_true")
    embed = sub.add_parser("embed", help="vectors and passages, batch by batch")
    embed.add_argument("papers")
    embed.add_argument("sections")
    embed.add_argument("--batch-size", type=int, default=500)
    embed.add_argument("--merge-threshold", type=float, default=0.9)
    embed.add_argument("--encoder", help="package.module:function that loads an encoder")
    embed.add_argument("--scorer", help="package.module:function that loads a scorer")
    embed.add_argument("--store", help="folder of the tables to upload to")
    coords = sub.add_parser("generate_coords", help="two coordinates of every paper")
    coords.add_argument("run")
    grouped = sub.add_parser("cluster", help="density clusters of all papers")
    grouped.add_argument("run")
    grouped.add_argument("--min-cluster-size", type=int, default=5)
    middle = sub.add_parser("generate_centroids", help="centroids from memberships and coordinates")
    middle.add_argument("memberships")
    middle.add_argument("coordinates")
    middle.add_argument("--samples", type=int, default=1000)
    middle.add_argument("--seed", type=int, default=0)
    for command in (select, download, embed, coords, grouped, middle):
        command.add_argument("--output", required=True)
    return parser


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Rows, or batches, that the command has made."""
    if args.command == "select":
        return select_papers(spark, args.archives, args.output, args.days_back, args.max_results, args.categories, args.keywords).count()
    if args.command == "download":
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(args.archives)
        name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(?:tar\.gz|tgz|gz|tar|zip|tex)$", ""))
        return parse_archives(spark, spark.read.json(args.papers).select("arxiv_id"), found.select(name.alias("arxiv_id"), "content"), args.output, args.include_proofs).count()
    if args.command == "embed":
        store = Store(spark, args.store) if args.store else None
        encoder, scorer = _plugged(args.encoder, answers.digest_encoder()), _plugged(args.scorer, answers.digest_encoder(D.CLASSES))
        return embed_papers(spark, spark.read.json(args.papers), spark.read.parquet(args.sections), args.output, encoder, scorer, args.batch_size, args.merge_threshold, args.encoder or "stand-in", store)
    if args.output in (getattr(args, n, None) for n in ("run", "memberships", "coordinates")):
        raise ValueError("the output must differ from the input")
    if args.command == "generate_coords":
        rows = coordinates(artifacts.read_batches(spark, args.run)[0])
        artifacts.write_csv(rows.select("arxiv_id", F.col("x").alias("umap_x"), F.col("y").alias("umap_y")), args.output)
        return rows.count()
    if args.command == "cluster":
        check_options(args.min_cluster_size)
        papers = artifacts.read_batches(spark, args.run)[0]
        members, clusters = cluster(spark, papers, args.min_cluster_size)
        artifacts.write_csv(members.join(papers.select("arxiv_id", "title"), "arxiv_id").select("cluster_id", "arxiv_id", "title", "certainty"), f"{args.output}/memberships")
        artifacts.write_csv(clusters.select("cluster_id", F.lit(None).cast("string").alias("label"), "size", "parent_cluster_id"), f"{args.output}/clusters")
        return clusters.count()
    at = files.finite_coordinates(files.read_table(spark, args.coordinates, files.COORDINATES, ["arxiv_id", "umap_x", "umap_y"]))
    rows = centroids(artifacts.read_memberships(spark, args.memberships), at, args.samples, args.seed)
    artifacts.write_csv(artifacts.with_centroid_field(rows), args.output)
    return rows.count()


def main(argv: list[str] | None = None) -> int:
    """Command line of six commands; an error is logged once and gives exit code 1."""
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("quirework").getOrCreate()
    try:
        log.info("%s: %s", args.command, _run(spark, args))
        return 0
    except Exception:
        log.exception("the command failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
