"""Sections, statements, dependencies and keyword search of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import latex as L

#: Query terms up to this number go to every task; more are joined by term.
FEW_TERMS = 100_000


def carried_header(sections: DataFrame, header: str = "header", out: str = "major_header") -> DataFrame:
    """Each section with the last non-empty header so far of its paper, in document order."""
    w = Window.partitionBy("arxiv_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sections.withColumn(out, F.coalesce(F.last(F.when(F.trim(header) != "", F.col(header)), ignorenulls=True).over(w), F.lit("")))


def extracted_statements(sections: DataFrame) -> DataFrame:
    """(arxiv_id, section_index, statement_index, statement_type, raw_latex, labels) of every section's source; null sources give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, kind, body, labels = [], [], [], [], []
            for i, raw in enumerate(batch.column("raw_latex").to_pylist()):
                for k, (name, text, own) in enumerate(L.statements(raw)):
                    row.append(i)
                    index.append(k)
                    kind.append(name)
                    body.append(text)
                    labels.append(own)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("arxiv_id").take(at), batch.column("section_index").take(at), pa.array(index, pa.int32()), pa.array(kind, pa.string()), pa.array(body, pa.string()), pa.array(labels, pa.list_(pa.string()))],
                names=["arxiv_id", "section_index", "statement_index", "statement_type", "raw_latex", "labels"],
            )

    rows = sections.select("arxiv_id", F.col("section_index").cast("int").alias("section_index"), "raw_latex").where("raw_latex is not null")
    return rows.mapInArrow(run, "arxiv_id string, section_index int, statement_index int, statement_type string, raw_latex string, labels array<string>")


def statement_edges(sections: DataFrame) -> DataFrame:
    """(arxiv_id, statement, depends_on, place): dependencies mentioned in proofs, within each paper.

    Owners and labels cross sections, so a paper's sections with a proof or a
    label meet in one task; those without either are left out before.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("section_index")
        edges = L.dependencies([r or "" for r in rows.column("raw_latex").to_pylist()])
        return pa.table(
            {"arxiv_id": pa.array([key[0].as_py()] * len(edges), pa.string()), "statement": pa.array([a for a, _, _ in edges], pa.string()), "depends_on": pa.array([b for _, b, _ in edges], pa.string()), "place": pa.array([i for _, _, i in edges], pa.int32())}
        )

    rows = sections.select("arxiv_id", "section_index", "raw_latex").where("arxiv_id is not null").where(F.col("raw_latex").rlike(r"\\label|\\begin\s*\{proof|\\newtheorem"))
    return rows.dropDuplicates(["arxiv_id", "section_index"]).groupBy("arxiv_id").applyInArrow(run, "arxiv_id string, statement string, depends_on string, place int")


def clean_paragraphs(sections: DataFrame, include_proofs: bool = False) -> DataFrame:
    """(arxiv_id, section_index, paragraphs) of every section's source as prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [L.paragraphs(raw if include_proofs else L.without_proofs(raw)) for raw in batch.column("raw_latex").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["arxiv_id", "section_index", "paragraphs"])

    rows = sections.select("arxiv_id", F.col("section_index").cast("int").alias("section_index"), "raw_latex").where("raw_latex is not null")
    return rows.mapInArrow(run, "arxiv_id string, section_index int, paragraphs array<string>")


def tokens(text) -> F.Column:
    """Lower-case words for keyword search."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(documents: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, k1: float = 1.5, b: float = 0.75, few: int = FEW_TERMS) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query by BM25; a query's repeated terms count once.

    documents are read twice: once for lengths and document counts, once for the
    postings of query terms. queries: (query_id, query), a stated bounded set.
    Documents of no query term are not listed; ties go to the smaller id. Terms go
    to every task up to ``few`` of them, counted.
    """
    docs = documents.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).withColumn("n", F.size("t"))
    whole = docs.agg(F.count("*").alias("N"), F.avg("n").alias("mean"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    sent = F.broadcast if terms.limit(few + 1).count() <= few else (lambda rows: rows)
    wanted = sent(terms.select("term").distinct())
    post = docs.select("id", "n", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(whole)).withColumn("idf", F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", "idf", "mean")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    score = post.join(sent(terms), "term").join(sent(idf), "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """(arxiv_id, block_id, heading, major_heading, text): the abstract and every paragraph as evidence blocks."""
    a = papers.where("abstract is not null").select("arxiv_id", F.lit("abstract").alias("block_id"), F.lit("Abstract").alias("heading"), F.lit("Abstract").alias("major_heading"), F.col("abstract").alias("text"))
    s = sections.select("arxiv_id", "section_index", "section_header", "major_section_header", F.posexplode("text").alias("i", "text"))
    s = s.select("arxiv_id", F.concat(F.lit("s"), "section_index", F.lit("_p"), "i").alias("block_id"), F.col("section_header").alias("heading"), F.col("major_section_header").alias("major_heading"), "text")
    return a.unionByName(s)


def supported_quotes(evidence: DataFrame, blocks_: DataFrame) -> DataFrame:
    """evidence: (arxiv_id, block_id, quote), with column supported: whether the quote stands word for word in its block."""
    b = blocks_.groupBy("arxiv_id", "block_id").agg(F.min("text").alias("text"))
    return evidence.join(b, ["arxiv_id", "block_id"], "left").withColumn("supported", F.coalesce(F.contains("text", F.col("quote")), F.lit(False))).drop("text")
