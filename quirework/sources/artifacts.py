"""Stored artifacts of a run: embedding batches, source papers, cluster files, caches of answers, and tables with checked keys.

Vectors lie in the row they belong to, so no file has to be aligned with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirework.operators.deltas import Store
from quirework.operators.ranking import differences, numbered_batches, require_unique
from quirework.operators.storage import cache_misses, read_manifest, write_atomic, write_manifest
from quirework.sources.files import read_table

#: Tables that an embedding run stores, both by batch.
BATCH_TABLES = ("papers", "techniques")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def checked(df: DataFrame, fine: Column, message: Column) -> DataFrame:
    """The rows, or an error at run time with the message of one for which the condition is not true."""
    return df.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


# Embedding batches.


def batched(papers: DataFrame, size: int) -> DataFrame:
    """Papers with their batch number from 1, by id."""
    ids = numbered_batches(papers.select("arxiv_id").distinct(), [F.col("arxiv_id")], size)
    return papers.join(ids, "arxiv_id")


def write_batches(papers: DataFrame, techniques: DataFrame, path: str) -> None:
    """Stores papers and techniques, both with a column batch, each in folders by batch; a failed write leaves the old ones."""
    for name, rows in zip(BATCH_TABLES, (papers, techniques), strict=True):
        staged = f"{path.rstrip('/')}/{name}"
        rows.repartition("batch").write.partitionBy("batch").mode("overwrite").parquet(staged)


def missing_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables that a stored run lacks."""
    return [n for n in BATCH_TABLES if not _exists(spark, f"{path.rstrip('/')}/{n}")]


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, techniques) of a stored run. Errors: a table is missing; at run time an id is repeated across batches or a vector's length differs from its paper's embedding_dim."""
    if missing := missing_files(spark, path):
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    papers, techniques = (spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in BATCH_TABLES)
    papers = require_unique(papers, ["arxiv_id"])
    papers = checked(papers, F.col("area_embedding").isNull() | (F.size("area_embedding") == F.col("embedding_dim")), F.concat(F.lit("wrong length of the vector of "), "arxiv_id"))
    known = papers.select("arxiv_id", F.col("embedding_dim").alias("__dim"))
    joined = techniques.join(known, "arxiv_id", "left")
    fine = F.col("__dim").isNotNull() & (F.col("embedding").isNull() | (F.size("embedding") == F.col("__dim")))
    return papers, checked(joined, fine, F.concat(F.lit("no paper, or another length of vector: "), "passage_id")).drop("__dim")


def batch_names_differ(papers: DataFrame, techniques: DataFrame) -> DataFrame:
    """(batch, side): batches that only one of both tables has; empty where the sets are equal."""
    return differences(papers, techniques, "batch")


def coverage(expected: DataFrame, stored: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """(id, state): stored, missing or unexpected, of every id of either side."""
    a, b = expected.select(key).distinct().withColumn("a", F.lit(True)), stored.select(key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("a") & F.col("b"), "stored").when(F.col("a"), "missing").otherwise("unexpected").alias("state"))


def resumable(expected: DataFrame, stored: DataFrame, size: int) -> DataFrame:
    """(batch, papers, stored, done): a batch of ids is done if every one of them is stored, and is done again as a whole otherwise."""
    ids = batched(expected.select("arxiv_id").distinct(), size)
    have = stored.select("arxiv_id").distinct().withColumn("s", F.lit(1))
    out = ids.join(have, "arxiv_id", "left").groupBy("batch").agg(F.count("*").alias("papers"), F.count("s").alias("stored"))
    return out.withColumn("done", F.col("papers") == F.col("stored"))


def next_state(state: str) -> str:
    """The state that follows in a run's manifest."""
    order = ["processing", "uploading", "completed"]
    if state not in order:
        raise ValueError(f"unknown state: {state}")
    return order[min(order.index(state) + 1, len(order) - 1)]


def run_batches(spark: SparkSession, papers: DataFrame, path: str, size: int, embed, settings: dict, store: Store | None = None) -> int:
    """Runs ``embed`` over the batches of papers that are not done, stores each, uploads it to the store if there is one, and keeps a manifest; returns how many were run.

    embed: papers of a batch -> (papers, techniques), both without the column
    batch. A run that was begun with other settings is an error. A batch that
    was stored but not uploaded is uploaded first, and only once.
    """
    manifest = f"{path.rstrip('/')}/manifest"
    known = read_manifest(spark, manifest) if _exists(spark, manifest) else {"settings": settings, "batches": {}}
    if known["settings"] != settings:
        raise ValueError("the run was begun with other settings")
    numbered = batched(papers, size)
    last = numbered.agg(F.max("batch")).head()[0] or 0
    ran = 0
    for number in range(1, last + 1):
        state = known["batches"].get(str(number))
        if state == "completed":
            continue
        if state is None or state == "processing":
            known["batches"][str(number)] = "processing"
            write_manifest(spark, manifest, known)
            own, found = embed(numbered.where(F.col("batch") == number).drop("batch"))
            for name, rows in zip(BATCH_TABLES, (own, found), strict=True):
                rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/batch={number}")
            known["batches"][str(number)] = "uploading"
            write_manifest(spark, manifest, known)
            ran += 1
        if store is not None:
            store.commit(f"batch-{number}", {n: spark.read.parquet(f"{path.rstrip('/')}/{n}/batch={number}") for n in BATCH_TABLES})
        known["batches"][str(number)] = next_state("uploading")
        write_manifest(spark, manifest, known)
    return ran


# Source papers: metadata with their sections.


def source_papers(papers: DataFrame, sections: DataFrame, include_proofs: bool = False) -> DataFrame:
    """One row per section with its paper's columns and include_proofs; a paper without sections has one row with a null section_index."""
    one = papers.select("arxiv_id", "title", "abstract", "primary_category").dropDuplicates(["arxiv_id"])
    s = sections.select("arxiv_id", "section_index", "section_header", "major_section_header", "text", "raw_latex").dropDuplicates(["arxiv_id", "section_index"])
    return one.join(s, "arxiv_id", "left").withColumn("include_proofs", F.lit(include_proofs))


def write_source_papers(rows: DataFrame, path: str) -> None:
    write_atomic(rows, path, "json", compression="gzip")


def read_source_papers(spark: SparkSession, path: str, schema: StructType, include_proofs: bool, ids: DataFrame | None = None) -> DataFrame:
    """The stored rows, of the asked ids if given; at run time a row stored with another include_proofs is an error."""
    rows = spark.read.schema(schema).json(path)
    rows = checked(rows, F.col("include_proofs") == F.lit(include_proofs), F.concat(F.lit("stored with other proofs: "), "arxiv_id"))
    return rows if ids is None else rows.join(ids.select("arxiv_id").distinct(), "arxiv_id", "left_semi")


# Cluster files and other delimited tables.

CLUSTER_METADATA = "cluster_id int, label string, size int, parent_cluster_id int"
CENTROIDS = "cluster_id string, label string, centroid string"


def write_csv(df: DataFrame, path: str) -> None:
    """A gzipped file with headers; a failed write leaves the old one."""
    write_atomic(df, path, "csv", header="true", compression="gzip", quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def with_centroid_field(centroids: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the coordinates as a JSON array in one field."""
    return centroids.select("cluster_id", F.to_json(F.array("x", "y")).alias("centroid"))


def centroid_of_field(rows: DataFrame) -> DataFrame:
    """(cluster_id, x, y) of rows with a JSON array of two numbers."""
    xy = F.from_json("centroid", "array<double>")
    return rows.select("cluster_id", F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, arxiv_id, title, certainty) of a stored membership file, each cluster and paper once."""
    rows = read_table(spark, path, "cluster_id int, arxiv_id string, title string, certainty double", ["cluster_id", "arxiv_id", "certainty"])
    return require_unique(rows, ["cluster_id", "arxiv_id"])


def read_cluster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The stored clusters, each once."""
    return require_unique(read_table(spark, path, CLUSTER_METADATA, ["cluster_id", "size", "parent_cluster_id"]), ["cluster_id"])


#: Keys of the delimited files of a review, by kind.
KEYS = {"labels": ["arxiv_id", "section_index", "paragraph_index"], "review": ["connection_id"], "memberships": ["cluster_id", "arxiv_id"]}


def keyed(df: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind of file, or an error at run time if a key is repeated or has a null part."""
    keys = KEYS[kind]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return require_unique(checked(df, whole, F.lit(f"a key of {kind} has a null part")), keys)


# Sources and caches.


def rows_of(name: str, local: DataFrame | None, store: Store | None, order: list[str] | None = None) -> DataFrame:
    """The table from the one source that is given; none or both is an error."""
    if (local is None) == (store is None):
        raise ValueError("exactly one of a local table and a store is needed")
    if local is not None:
        return local
    rows = store.read(name, order)
    if rows is None:
        raise FileNotFoundError(f"the store has no table {name}")
    return rows


def call(functions: dict, name: str, arguments: dict) -> DataFrame:
    """The table that a named function gives for named arguments; an unknown name is an error."""
    if name not in functions:
        raise ValueError(f"unknown function: {name}")
    return functions[name](**arguments)


def cached_answers(wanted: DataFrame, cached: DataFrame, key: str, fingerprint: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): wanted rows with the cached answer of their key and fingerprint, and those without; stale answers are misses."""
    marked = wanted.withColumn("fingerprint", fingerprint)
    hits = marked.join(cached.select(key, "fingerprint", "answer"), [key, "fingerprint"])
    return hits, cache_misses(wanted, cached, key, fingerprint)


def placed_answers(paragraphs: DataFrame, answers: DataFrame) -> DataFrame:
    """Paragraphs with the answer at their place in their paper's list; at run time a paper whose list is longer or shorter is an error.

    paragraphs: (arxiv_id, section_index, paragraph_index, ...); answers:
    (arxiv_id, answers array). Places are counted in document order.
    """
    paper = Window.partitionBy("arxiv_id")
    w, n = F.row_number().over(paper.orderBy("section_index", "paragraph_index")), F.count("*").over(paper)
    rows = paragraphs.withColumn("__place", w).withColumn("__n", n).join(answers, "arxiv_id")
    rows = checked(rows, F.size("answers") == F.col("__n"), F.concat(F.lit("wrong number of answers for "), "arxiv_id"))
    return rows.withColumn("answer", F.element_at("answers", F.col("__place"))).drop("__place", "__n", "answers")
