"""Models behind the engine: pluggable scorers and encoders, projection to two dimensions, logistic regression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "logits", batch: int = 32) -> DataFrame:
    """The rows with an array column of a model's outputs. load builds the model once per Python worker; texts go in batches of like length."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            result: list = [None] * len(texts)
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                for i, row in zip(own, np.asarray(model([texts[i] for i in own]), float), strict=True):
                    result[i] = row.tolist()
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def stand_in_scorer(classes: int = 5) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic model for tests without weights: outputs follow from the text's digest."""

    def load() -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.array([np.frombuffer(hashlib.sha256(t.encode()).digest()[:classes], np.uint8) / 64.0 for t in texts])

    return load


def windows(tokens: Column, size: int = 512, overlap: int = 128) -> Column:
    """An array of token windows: each of at most ``size``, sharing ``overlap`` with the one before; a fitting array is one window."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size(tokens) - overlap) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * step + 1, F.lit(size)))


def pair_budget(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Two token arrays cut so that together they keep within ``most``: the shorter keeps what it needs, up to half, the other gets the rest."""
    half = most // 2
    la, lb = F.size(a), F.size(b)
    ka = F.when(la <= half, la).otherwise(F.least(la, F.lit(most) - F.least(lb, F.lit(half))))
    kb = F.least(lb, F.lit(most) - ka)
    return F.slice(a, F.lit(1), ka), F.slice(b, F.lit(1), kb)


def _moments(n: int, mean: np.ndarray, spread: np.ndarray, m: int, other: np.ndarray, more: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, summed outer products around the mean) of two sets together."""
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), spread + more + np.outer(gap, gap) * (n * m / (n + m))


def principal_axes(df: DataFrame, vector: str, dims: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of principal component analysis of all rows with a vector.

    Each partition gives its count, mean and outer products around its mean; the
    driver joins them, so it holds one matrix of the vector's length a partition.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for part in parts:
            if len(part):
                x = np.stack(part.v.to_numpy())
                mean = x.mean(axis=0)
                new = len(x), mean, (x - mean).T @ (x - mean)
                own = _moments(*own, *new) if own else new
        if own:
            yield pd.DataFrame({"n": [own[0]], "mean": [own[1].tolist()], "spread": [own[2].ravel().tolist()]})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    total = None
    for r in rows.mapInPandas(run, "n long, mean array<double>, spread array<double>").collect():
        mean = np.array(r.mean)
        new = r.n, mean, np.array(r.spread).reshape(len(mean), len(mean))
        if total and len(total[1]) != len(mean):
            raise ValueError("vectors of different lengths")
        total = _moments(*total, *new) if total else new
    if not total:
        raise ValueError("no vectors to fit on")
    axes = np.linalg.eigh(total[2])[1].T[::-1][:dims]
    return total[1], axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def projected(df: DataFrame, id_col: str, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(id, x, y): every row with a vector, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                at = (np.stack(part.v.to_numpy()) - mean) @ axes.T
                yield pd.DataFrame({"id": part.id.to_numpy(), "x": at[:, 0], "y": at[:, 1]})

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == len(mean))).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, "id string, x double, y double").withColumnRenamed("id", id_col)


def logistic_probabilities(train: DataFrame, rows: DataFrame, features: str, label: str, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """The rows with column probability of the positive class: regularised logistic regression fitted on train."""
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / c / 1000, maxIter=max_iter).fit(
        train.select(array_to_vector(F.col(features)).alias("__x"), F.col(label).cast("double").alias("__y"))
    )
    out = model.transform(rows.withColumn("__x", array_to_vector(F.col(features))))
    return out.withColumn("__p", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "prediction", "probability").withColumnRenamed("__p", "probability")


def left_out_accuracy(rows: DataFrame, features: str, label: str, group: str, parts: int = 5) -> DataFrame:
    """(mean, spread, parts): accuracy of logistic regression on the groups it was not fitted on. Groups are dealt to ``parts`` by hash, each left out once; an empty part counts for nothing."""
    part = F.pmod(F.xxhash64(F.col(group)), F.lit(parts))
    out = None
    for i in range(parts):
        own = logistic_probabilities(rows.where(part != i), rows.where(part == i), features, label)
        right = own.agg(F.lit(i).alias("part"), F.avg(((F.col("probability") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("a"))
        out = right if out is None else out.unionByName(right)
    return out.agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("spread"), F.count("a").alias("parts"))
