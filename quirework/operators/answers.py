"""Answers of plugged models: embeddings, scores of long passages, contextualised statements, labels of paragraphs and of cluster trees.

A model is a function that is loaded once per Python worker; what is asked of it,
and what is made of its answers, are DataFrame expressions, so both are the same
for a stand-in and for weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.functions import records as C
from quirework.operators import models as M
from quirework.operators import techniques as T
from quirework.operators.ranking import seeded_order
from quirework.scratch import Scratch
from quirework.sources.artifacts import cached_answers

Load = Callable[[], Callable[[list[str]], np.ndarray]]
Answer = Callable[[], Callable[[list[str]], list[str]]]

# What encoders put before a text to store and before one to cluster.
DOCUMENT_PROMPT, CLUSTER_PROMPT = "search_document: ", "clustering: "


def digest_encoder(dim: int = 8) -> Load:
    """A deterministic encoder for tests without weights: the hexadecimal digits of the text's digest, around zero."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def run(texts: list[str]) -> np.ndarray:
            return np.array([[int(c, 16) - 7.5 for c in hashlib.md5(t.encode("utf-8", "replace")).hexdigest()[:dim]] for t in texts]).reshape(len(texts), dim)

        return run

    return load


def digest_answers() -> Answer:
    """A deterministic model of answers for tests: the first eight digits of the prompt's digest."""
    return lambda: lambda prompts: [hashlib.md5(p.encode("utf-8", "replace")).hexdigest()[:8] for p in prompts]


def embedded(df: DataFrame, text: str, load: Load, prompt: str = "", out: str = "embedding", batch: int = 8) -> DataFrame:
    """The rows with an array column of the text's vector, scaled to length one; a null or blank text, and an all-zero vector, give null."""
    asked = df.withColumn("__asked", F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit(prompt), F.col(text))))
    blank = asked.where("__asked is null").withColumn("__v", F.lit(None).cast("array<double>"))
    rows = M.scored(asked.where("__asked is not null"), "__asked", load, "__v", batch).unionByName(blank)
    return rows.withColumn(out, F.when(D.usable_vector(F.col("__v")), D.unit(F.col("__v")))).drop("__asked", "__v")


def scored_passages(df: DataFrame, key: str, tokens: Column, load: Load, size: int = 512, overlap: int = 128, pooling: str = "mean") -> DataFrame:
    """(key, windows, logits): each passage's token windows are scored and pooled over all of them; a passage without tokens is one empty window."""
    rows = df.select(F.col(key), F.posexplode(M.windows(tokens, size, overlap)).alias("__no", "__window"))
    rows = rows.withColumn("__text", F.array_join("__window", " "))
    scores = M.scored(rows, "__text", load, "logits")
    pooled = T.pooled(scores.select(F.col(key).alias("passage_id"), "logits"), pooling)
    n = rows.groupBy(F.col(key).alias("passage_id")).agg(F.count("*").alias("windows"))
    return pooled.join(n, "passage_id").select(F.col("passage_id").alias(key), "windows", "logits")


def answered(df: DataFrame, prompt: str, load: Answer, out: str = "answer", batch: int = 32) -> DataFrame:
    """The rows with a string column of the model's answers, asked in batches; a null prompt is not asked and has no answer."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts, result = part.tolist(), [None] * len(part)
            asked = [i for i, t in enumerate(texts) if t is not None]
            for lo in range(0, len(asked), batch):
                own = asked[lo : lo + batch]
                for i, a in zip(own, model([texts[i] for i in own]), strict=True):
                    result[i] = a
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(F.col(prompt)))


def content(response: Column) -> Column:
    """The text of a chat response's first choice, trimmed; null where there is none or it is blank."""
    text = F.trim(F.get_json_object(response, "$.choices[0].message.content"))
    return F.when(text != "", text)


# Statements.


def statement_prompts(statements: DataFrame, contexts: DataFrame) -> DataFrame:
    """The statements with a prompt of their paper's title, context and own text. contexts: (arxiv_id, title, header, source, text) as of ``experiment.paper_context``."""
    head = F.when(F.col("source") == "section", F.concat(F.lit("Proof overview ("), F.coalesce("header", F.lit("")), F.lit("):\n"))).otherwise("Paper abstract:\n")
    own = contexts.select("arxiv_id", F.concat(F.lit("Paper: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), head, F.coalesce("text", F.lit(""))).alias("__context"))
    rows = statements.join(own, "arxiv_id", "left")
    return rows.withColumn("prompt", F.concat(F.coalesce("__context", F.lit("")), F.lit("\n\nStatement ("), F.col("statement_type"), F.lit("):\n"), F.col("raw_latex"))).drop("__context")


def contextualised(statements: DataFrame, contexts: DataFrame, load: Answer) -> DataFrame:
    """The statements with the model's description of their role, null where it gives none."""
    rows = answered(statement_prompts(statements, contexts), "prompt", load).drop("prompt")
    return rows.withColumn("description", F.when(F.trim("answer") != "", F.trim("answer"))).drop("answer")


def selected_statements(statements: DataFrame, answers: DataFrame, count: int) -> DataFrame:
    """(arxiv_id, rank, statement columns) that each paper's answer ranks; the answer is a JSON list of exactly min(count, statements) distinct places from 0.

    A paper whose answer is no such list has no rows. answers: (arxiv_id, answer).
    Places are those in document order.
    """
    w = Window.partitionBy("arxiv_id")
    rows = statements.withColumn("__place", F.row_number().over(w.orderBy("section_index", "statement_index")) - 1)
    n = rows.groupBy("arxiv_id").agg(F.count("*").alias("__n"))
    good = answers.join(n, "arxiv_id").where(C.valid_selection(F.col("answer"), F.least(F.lit(count), F.col("__n")), F.col("__n")))
    picked = good.select("arxiv_id", F.posexplode(F.from_json("answer", "array<int>")).alias("rank", "__place"))
    return rows.join(picked, ["arxiv_id", "__place"]).drop("__place")


# Labels of paragraphs.


def label_fingerprint(text: Column, version: str) -> Column:
    """What a cached label was made from: the version of the prompt and the paragraph's text."""
    return F.sha2(F.concat_ws("\n", F.lit(version), F.coalesce(text, F.lit(""))), 256)


def weak_labels(paragraphs: DataFrame, cached: DataFrame, key: str, text: str, version: str, load: Load) -> tuple[DataFrame, DataFrame]:
    """((key, distribution, expected), new cache rows): probabilities of the five classes for every paragraph, asked only where the cache has none of its fingerprint.

    cached: (key, fingerprint, answer array). The model gives log probabilities,
    which are renormalised over the classes.
    """
    rows = paragraphs.select(key, text)
    hits, misses = cached_answers(rows, cached, key, label_fingerprint(F.col(text), version))
    fresh = M.scored(misses, text, load, "answer")
    both = hits.select(key, "fingerprint", "answer").unionByName(fresh.select(key, "fingerprint", "answer"))
    dist = D.softmax(F.col("answer"))
    return both.select(key, dist.alias("distribution"), D.expected_class(dist).alias("expected")), fresh.select(key, "fingerprint", "answer")


# Labels of clusters.


def depths(tree: DataFrame, scratch: Scratch, most: int = 64) -> DataFrame:
    """(cluster_id, parent_cluster_id, depth): the root has depth 0."""
    from quirework.operators.cluster_tree import ancestors

    deepest = ancestors(tree, scratch, most).groupBy("cluster_id").agg(F.max("distance").alias("depth"))
    return tree.select("cluster_id", "parent_cluster_id").join(deepest, "cluster_id")


def labelled_clusters(tree: DataFrame, memberships: DataFrame, titles: DataFrame, load: Answer, scratch: Scratch, samples: int = 20, seed: int = 0) -> DataFrame:
    """(cluster_id, label): children before parents; a leaf is labelled from sampled titles of its papers, a parent from its children's labels and sizes.

    One step per level of the tree, and within it siblings are asked together, so
    that a label can be told from the others. titles: (arxiv_id, title). A blank
    answer leaves the label null; ties of samples go to the smaller id.
    """
    known = scratch.table(depths(tree, scratch), "depths")
    deepest = known.agg(F.max("depth")).head()[0]
    size = memberships.select("cluster_id", "arxiv_id").distinct().groupBy("cluster_id").agg(F.count("*").alias("size"))
    w = Window.partitionBy("cluster_id").orderBy(seeded_order(seed, "cluster_id", "arxiv_id"), "arxiv_id")
    parents = known.select(F.col("parent_cluster_id").alias("cluster_id")).where("cluster_id is not null").distinct()
    chosen = memberships.select("cluster_id", "arxiv_id").distinct().join(parents, "cluster_id", "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    sampled = chosen.join(titles.groupBy("arxiv_id").agg(F.min("title").alias("title")), "arxiv_id")
    leaves = sampled.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("title", F.lit("")))), "\n").alias("told"))  # at most ``samples`` titles
    done: DataFrame | None = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = known.where(F.col("depth") == depth)
        told = here.join(leaves, "cluster_id", "left")
        if done is not None:
            below = done.join(known.select("cluster_id", F.col("parent_cluster_id").alias("p")), "cluster_id").join(size, "cluster_id", "left")
            line = F.concat(F.coalesce("label", F.lit("")), F.lit(" ("), F.coalesce(F.col("size").cast("string"), F.lit("0")), F.lit(")"))
            children = below.groupBy(F.col("p").alias("cluster_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("children"))
            told = told.join(children, "cluster_id", "left").withColumn("told", F.coalesce("children", "told")).drop("children")
        prompt = F.concat(F.lit("Cluster of papers:\n"), F.coalesce("told", F.lit("")))
        rows = answered(told.withColumn("__prompt", prompt), "__prompt", load).select("cluster_id", F.when(F.trim("answer") != "", F.trim("answer")).alias("label"))
        done = scratch.table(rows if done is None else done.unionByName(rows), f"labels-{depth}")
    return done if done is not None else tree.select("cluster_id", F.lit(None).cast("string").alias("label")).limit(0)


def sibling_problems(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(parent_cluster_id, label, n): labels that siblings share, and blank ones."""
    rows = tree.select("cluster_id", "parent_cluster_id").join(labels, "cluster_id", "left")
    same = rows.groupBy("parent_cluster_id", F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("label")).agg(F.count("*").alias("n"))
    return same.where("n > 1 or label = ''")
