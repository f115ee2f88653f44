"""First-wins deduplication, top-k with total order, batches and checks of uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given total order (the input position, where the first record is to win)."""
    return top_by(df, keys, order, 1)


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of every key; k = 0 gives none, a negative k is an error. Spark limits each key before the shuffle."""
    if k < 0:
        raise ValueError("k must not be negative")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return out.withColumnRenamed("__r", rank) if rank else out.drop("__r")


def numbered_batches(df: DataFrame, order: list[Column], size: int, group: list[str] | None = None) -> DataFrame:
    """Column batch: 1 for the first ``size`` rows of a group in order, 2 for the next, and so on.

    Without ``group`` one task numbers all rows: for lists of ids only.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    w = Window.partitionBy(*(group or [])).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("int") + 1)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their count; empty means unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, or an error at run time naming a repeated key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys)))
    return df.withColumn("__n", n).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("__n")


def differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(column, side): values found only on the left ('missing') or only on the right ('unexpected')."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def _draw(seed: int, *keys: str) -> Column:
    """The digest of a seed and keys: what every engine draws alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def seeded_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order that depends on the seed and the keys alone."""
    return _draw(seed, *keys)


def weighted_order(seed: int, weight: Column, *keys: str) -> Column:
    """Ascending order of a weighted sample without replacement: -ln(u) / weight; a weight of zero comes last."""
    u = (F.conv(F.substring(_draw(seed, *keys), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    return F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf")))
