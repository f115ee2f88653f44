"""From scored paragraphs to a paper's technique passages: best paragraphs, merge of similar ones, threshold by place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Paragraphs of a paper that are looked at, the least score, its rise per place, its upper bound.
BEST = 20
LEAST_SCORE, RISE, MOST = 3.0, 0.25, 3.9
#: Fixed value: tokens that a merged passage may have, and that joining costs.
MERGED_TOKENS, JOINT_TOKENS = 2048, 2


def above_threshold(rows: DataFrame, score: str, ties: list[str], k: float = LEAST_SCORE, best: int = BEST) -> DataFrame:
    """Rows with their place (0 first) within the paper: place 0 stays, place i if its score reaches min(k + i / 4, 3.9).

    Scores fall and the threshold rises with the place, so the rule needs no stop.
    """
    w = Window.partitionBy("arxiv_id").orderBy(F.desc(score), *ties)
    rows = rows.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < best)
    return rows.where((F.col("place") == 0) | (F.col(score) >= F.least(F.lit(k) + F.col("place") * RISE, F.lit(MOST))))


def _merge(threshold: float, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "passage_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.stack(rows.embedding.to_numpy()).astype(np.float64)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n > 0, n, 1)
        close = v @ v.T
        group = np.arange(len(rows))
        size = rows.tokens.to_numpy().copy()
        for i in range(len(rows)):
            for j in np.flatnonzero(close[i, i + 1 :] >= threshold) + i + 1:
                a, b = sorted((group[i], group[j]))
                if a != b and size[a] + size[b] + JOINT_TOKENS <= most:
                    group[group == b] = a
                    size[a] += size[b] + JOINT_TOKENS
        out = rows.assign(group=group).groupby("group", sort=True)
        mean = [v[i.to_numpy()].mean(axis=0) for _, i in out.groups.items()]
        return pd.DataFrame(
            {
                "arxiv_id": out.arxiv_id.first().to_numpy(),
                "passage_id": out.passage_id.first().to_numpy(),
                "passage": out.passage.agg("\n\n".join).to_numpy(),
                "score": out.score.max().to_numpy(),
                "members": out.size().to_numpy(),
                "embedding": [(m / (np.linalg.norm(m) or 1)).astype(np.float32) for m in mean],
            }
        )

    return run


def merge_similar(rows: DataFrame, threshold: float, best: int = BEST, most_tokens: int = MERGED_TOKENS) -> DataFrame:
    """(arxiv_id, passage_id, passage, score, members, embedding): a paper's best passages with similar ones joined.

    Pairs are visited by place, and two groups join if together they keep within
    the token budget, so the order matters. A joined passage takes the place and
    id of its first member, all texts in order and the highest score; its vector
    stands in for a new encoding by the mean of its members'. A group never holds
    more than ``best`` rows: they are cut off before the paper is gathered. Rows
    without id, text, score or vector take no part.
    """
    w = Window.partitionBy("arxiv_id").orderBy(F.desc("score"), "passage_id")
    rows = rows.where("arxiv_id is not null and passage is not null and score is not null and embedding is not null and size(embedding) > 0")
    rows = rows.select("arxiv_id", "passage_id", "passage", "score", F.col("embedding").cast("array<float>").alias("embedding"), F.size(F.split("passage", r"\s+")).alias("tokens"))
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= best).drop("r")
    return rows.groupBy("arxiv_id").applyInPandas(_merge(threshold, most_tokens), "arxiv_id string, passage_id string, passage string, score double, members long, embedding array<float>")


def pooled(windows: DataFrame, how: str = "mean") -> DataFrame:
    """(passage_id, logits): logits of a passage's windows pooled class by class. windows: (passage_id, logits array<double>)."""
    if how not in ("mean", "max"):
        raise ValueError("pooling is mean or max")
    one = windows.select("passage_id", F.posexplode("logits").alias("c", "x"))
    per = one.groupBy("passage_id", "c").agg((F.avg if how == "mean" else F.max)("x").alias("x"))
    return per.groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("logits"))
