"""Passage search: exact nearest passages of a paper's passages, grouped by target paper, with an optional reranker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import distributions as D

#: Query passages whose matrix goes to every task at most, by a count; more are searched in blocks of so many.
MAX_QUERY_ROWS = 4096
#: Passages of a block that meets a block of queries.
PASSAGE_BLOCK = 16384


FOUND = "query_id string, query_passage_id string, target_id string, target_passage_id string, similarity double"


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of equally long, usable vectors."""
    rows = column.to_pylist()
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(q: np.ndarray, ids: list[str], passages: list[str], k: int):
    """Of each batch and query passage the k + 1 most similar rows and those that tie with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            close = np.round(q @ _units(batch.column(2)).T, 6)
            last = np.partition(close, -(k + 1), axis=1)[:, -(k + 1)] if close.shape[1] > k else np.full(len(q), -2.0)
            i, j = np.nonzero(close >= last[:, None])
            at = pa.array(j)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x in i], pa.string()), pa.array([passages[x] for x in i], pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(close[i, j])],
                names=["query_id", "query_passage_id", "target_id", "target_passage_id", "similarity"],
            )

    return run


def _block_nearest(k: int):
    """Of one block of queries and one of passages: each query's k + 1 most similar passages and those that tie with the last."""

    def run(rows: pa.Table) -> pa.Table:
        asked = np.asarray(rows.column("asked"))
        q, p = rows.take(np.flatnonzero(asked)), rows.take(np.flatnonzero(~asked))
        ids, passages = q.column("arxiv_id").to_pylist(), q.column("passage_id").to_pylist()
        out = []
        if q.num_rows and p.num_rows:
            part = pa.RecordBatch.from_arrays([p.column(c).combine_chunks() for c in ("arxiv_id", "passage_id", "v")], names=["arxiv_id", "passage_id", "v"])
            out = list(_nearest(_units(q.column("v")), ids, passages, k)(iter([part])))
        schema = pa.schema([(n, pa.string()) for n in ("query_id", "query_passage_id", "target_id", "target_passage_id")] + [("similarity", pa.float64())])
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    return run


def candidates(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query_id, query_passage_id, target_id, target_passage_id, similarity, position) of the k + 1 nearest passages of each query passage, without those of the query itself.

    queries, passages: (arxiv_id, passage_id, embedding). Unusable vectors take no
    part; vectors compare with those of their own length. Up to MAX_QUERY_ROWS
    queries, by a count, go to every task as one matrix: all passages are then
    read once and never shuffled, and a task keeps only the k + 1 best per query
    passage. More queries meet the passages in block pairs, each in one task,
    with the same result. Ties go to the smaller passage id.
    """
    usable = D.usable_vector(F.col("embedding"))
    asked = queries.where(usable).select("arxiv_id", "passage_id", F.col("embedding").cast("array<double>").alias("v"))
    every = passages.where(usable).select("arxiv_id", "passage_id", F.col("embedding").cast("array<double>").alias("v"))
    n = asked.count()
    if n > MAX_QUERY_ROWS:
        found = _in_blocks(asked, every, k, n)
    else:
        found = None
        rows = asked.orderBy("passage_id").collect()  # at most MAX_QUERY_ROWS rows
        for dim in sorted({len(r.v) for r in rows}) or [0]:
            own = [r for r in rows if len(r.v) == dim]
            q = np.array([r.v for r in own], np.float64).reshape(len(own), dim)
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            part = every.where(F.size("v") == dim).mapInArrow(_nearest(q, [r.arxiv_id for r in own], [r.passage_id for r in own], k), FOUND)
            found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_passage_id").orderBy(F.desc("similarity"), "target_passage_id")
    near = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k + 1)
    return near.where("target_id <> query_id")


def _in_blocks(asked: DataFrame, every: DataFrame, k: int, n: int) -> DataFrame:
    x, y = max(1, -(-every.count() // PASSAGE_BLOCK)), max(1, -(-n // MAX_QUERY_ROWS))
    deal = lambda c: F.pmod(F.xxhash64("passage_id"), F.lit(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    p = every.select("arxiv_id", "passage_id", "v", F.lit(False).alias("asked"), deal(x).alias("x"), each(y).alias("y"))
    q = asked.select("arxiv_id", "passage_id", "v", F.lit(True).alias("asked"), each(x).alias("x"), deal(y).alias("y"))
    both = p.unionByName(q).withColumn("dim", F.size("v")).repartition(int(min(x * y, 100_000)), "dim", "x", "y")
    return both.groupBy("dim", "x", "y").applyInArrow(_block_nearest(k), FOUND)


def _by_best(pairs: DataFrame, k: int, score: str) -> DataFrame:
    """The pairs of each query's k target papers of highest best score, with column rank; equal papers keep the order of their first pair."""
    if k <= 0:
        return pairs.withColumn("rank", F.lit(0)).where(F.lit(False))
    paper = Window.partitionBy("query_id", "target_id")
    rows = pairs.withColumn("__best", F.max(score).over(paper)).withColumn("__first", F.min(F.struct("position", "query_passage_id", "target_passage_id")).over(paper))
    order = Window.partitionBy("query_id").orderBy(F.desc("__best"), "__first")
    return rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).drop("__best", "__first")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The candidates of the k target papers with the best pair of each query paper, with column rank; all pairs of a kept paper stay."""
    return _by_best(found, k, "similarity")


def reranked(found: DataFrame, k: int, scorer: Callable[[DataFrame], DataFrame], score_col: str = "score") -> DataFrame:
    """As ``ranked`` but papers order by their best score; similarity stays. scorer adds score_col to every pair; a pair without a score is an error."""
    scored = scorer(found)
    given = F.coalesce(score_col, F.raise_error(F.lit("the reranker left a pair without a score")).cast("double"))
    return _by_best(scored.withColumn(score_col, given), k, score_col)


def find_similar(queries: DataFrame, passages: DataFrame, titles: DataFrame, k: int, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Search results with target titles: (query_id, rank, target_id, target_title, query_passage_id, target_passage_id, similarity)."""
    found = candidates(queries, passages, k)
    out = ranked(found, k) if scorer is None else reranked(found, k, scorer)
    named = titles.select(F.col("arxiv_id").alias("target_id"), F.col("title").alias("target_title")).groupBy("target_id").agg(F.min("target_title").alias("target_title"))
    return out.join(named, "target_id", "left").select("query_id", "rank", "target_id", "target_title", "query_passage_id", "target_passage_id", "similarity")


#: Papers that one request may ask for.
MOST_RESULTS = 100


def query_paper(arxiv_id: str, passages: DataFrame, titles: DataFrame, k: int, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``find_similar`` for one paper, as a service asks; k is 1 to MOST_RESULTS. A paper without passages has no rows."""
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k lies between 1 and {MOST_RESULTS}")
    return find_similar(passages.where(F.col("arxiv_id") == arxiv_id), passages, titles, k, scorer)


def _block_pairs(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        side, ids, v = rows.column("side").to_numpy(), rows.column("passage_id").to_pylist(), _units(rows.column("v"))
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        close = np.round(v[left] @ v[right].T, 6)
        i, j = np.nonzero(close >= threshold)
        pairs = [(*sorted((ids[left[x]], ids[right[y]])), close[x, y]) for x, y in zip(i, j, strict=True) if ids[left[x]] != ids[right[y]]]
        pairs = sorted(set(pairs))
        return pa.table(
            {"arxiv_id": pa.array([key[0].as_py()] * len(pairs), pa.string()), "a": pa.array([x[0] for x in pairs], pa.string()), "b": pa.array([x[1] for x in pairs], pa.string()), "similarity": pa.array([float(x[2]) for x in pairs], pa.float64())}
        )

    return run


def pairs_within_paper(passages: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(arxiv_id, a, b, similarity) of a paper's passage pairs of at least that cosine, each once.

    No pair across papers is formed. A paper of many passages is dealt in blocks
    and its block pairs go to different tasks, so none gathers a whole paper; only
    pairs that reach the threshold come out.
    """
    rows = passages.where(D.usable_vector(F.col("embedding")) & F.col("arxiv_id").isNotNull()).select("arxiv_id", "passage_id", F.col("embedding").cast("array<double>").alias("v"))
    n = rows.groupBy("arxiv_id", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    rows = rows.withColumn("dim", F.size("v")).join(n, ["arxiv_id", "dim"]).withColumn("at", F.pmod(F.xxhash64("passage_id"), F.col("n")).cast("int"))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("at") == F.col("to"), 0).when(F.col("at") < F.col("to"), -1).otherwise(1)
    dealt = rows.select("arxiv_id", "dim", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"), side.alias("side"), "passage_id", "v")
    return dealt.groupBy("arxiv_id", "dim", "x", "y").applyInArrow(_block_pairs(threshold), "arxiv_id string, a string, b string, similarity double")


def similar_papers(queries: DataFrame, passages: DataFrame, k: int, pairs_per_paper: int = 3) -> DataFrame:
    """(query_id, target_id, score, pairs): papers by the salience-weighted mean of their best passage pairs, at most ``pairs_per_paper`` each.

    queries, passages: (arxiv_id, passage_id, embedding, score); a pair's weight
    is the product of both scores, where a null score counts as 0.
    """
    scores = passages.select(F.col("passage_id").alias("target_passage_id"), F.coalesce("score", F.lit(0.0)).alias("t"))
    own = queries.select(F.col("passage_id").alias("query_passage_id"), F.coalesce("score", F.lit(0.0)).alias("s"))
    found = candidates(queries, passages, k).join(scores, "target_passage_id").join(own, "query_passage_id")
    found = found.withColumn("weighted", F.col("similarity") * F.col("s") * F.col("t"))
    w = Window.partitionBy("query_id", "target_id").orderBy(F.desc("weighted"), "query_passage_id", "target_passage_id")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pairs_per_paper)
    return best.groupBy("query_id", "target_id").agg(F.round(F.avg("weighted"), 6).alias("score"), F.count("*").alias("pairs"))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of one length, from its buffer."""
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Rows, and queries, that meet in one task.
PART_ROWS, PART_QUERIES = 50_000, 4_096


def best_by_label(queries: DataFrame, rows: DataFrame, k: int | None = None, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(query_id, label, best): the highest dot product of each query's vectors with the rows of every other label, rounded to six places; with k only each query's k best labels.

    queries: (query_id string, own string, v array<double>), any number of rows a
    query; rows: (label string, v array<double>). Rows are dealt to parts by their
    count, and each part of rows meets each part of queries in one task, from which
    one number per query and label comes, or the k best: a label among a query's
    k best is so where its best row is. Ties go to the smaller label. Vectors
    compare with those of their own length.
    """
    usable = lambda df: df.where(D.usable_vector(F.col("v")))
    p, q = usable(rows.select("label", F.col("v").cast("array<double>").alias("v"))), usable(queries.select("query_id", "own", F.col("v").cast("array<double>").alias("v")))
    n, m = max(1, -(-p.count() // part_rows)), max(1, -(-q.count() // part_queries))

    def run(part: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.string()), "label": pa.array([], pa.string()), "best": pa.array([], pa.float64())})
        asked = np.asarray(part.column("asked"))
        own, data = part.filter(pa.array(asked)), part.filter(pa.array(~asked))
        if not own.num_rows or not data.num_rows:
            return empty
        names, at = np.unique(np.array(data.column("label").to_pylist(), object), return_inverse=True)
        ids, of = np.unique(np.array(own.column("query_id").to_pylist(), object), return_inverse=True)
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(len(names)))
        x, y = _vectors(data.column("v"))[order], _vectors(own.column("v"))
        best = np.full((len(ids), len(names)), -np.inf)
        mine = np.array(own.column("label").to_pylist(), object)
        for lo in range(0, len(y), 256):
            close = np.maximum.reduceat(y[lo : lo + 256] @ x.T, begin, axis=1)
            close[mine[lo : lo + 256][:, None] == names[None, :]] = -np.inf
            np.maximum.at(best, of[lo : lo + 256], close)
        best = np.round(best, 6)
        if k is not None and k < len(names):
            last = -np.partition(-best, k - 1, axis=1)[:, k - 1]
            best[best < last[:, None]] = -np.inf
        i, j = np.nonzero(best > -np.inf)
        return pa.table({"query_id": pa.array(ids[i], pa.string()), "label": pa.array(names[j], pa.string()), "best": pa.array(best[i, j], pa.float64())})

    each = lambda c, of: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(c)
    data = p.select(F.lit(None).cast("string").alias("query_id"), "label", "v", F.lit(False).alias("asked"), F.pmod(F.xxhash64("v"), F.lit(n)).cast("int").alias("x"), each("y", m))
    asked = q.select("query_id", F.col("own").alias("label"), "v", F.lit(True).alias("asked"), each("x", n), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("y"))
    both = data.unionByName(asked).withColumn("dim", F.size("v"))
    found = both.groupBy("dim", "x", "y").applyInArrow(run, "query_id string, label string, best double").groupBy("query_id", "label").agg(F.max("best").alias("best"))
    if k is None:
        return found
    w = Window.partitionBy("query_id").orderBy(F.desc("best"), "label")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_labels(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, label, best) for whole numbers as ids and labels. queries: (query_id, own, q); rows: (label, embedding)."""
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("own").cast("string").alias("own"), F.col("q").alias("v"))
    found = best_by_label(q, rows.select(F.col("label").cast("string").alias("label"), F.col("embedding").alias("v")))
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("label").cast("int").alias("label"), "best")


def nearest_papers(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query_id, target_id, similarity, rank): of each query paper the k papers with the highest cosine over all pairs of passages, ties by id, the query itself left out.

    queries, passages: (arxiv_id, embedding). A query paper without a usable
    vector has no rows.
    """
    unit = D.unit(F.col("embedding"))
    q = queries.where("arxiv_id is not null").select(F.col("arxiv_id").alias("query_id"), F.col("arxiv_id").alias("own"), unit.alias("v"))
    found = best_by_label(q, passages.where("arxiv_id is not null").select(F.col("arxiv_id").alias("label"), unit.alias("v")), k)
    return found.select("query_id", F.col("label").alias("target_id"), F.col("best").alias("similarity"), "rank")
