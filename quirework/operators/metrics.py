"""Measures of classification, ranking and retrieval, each in one pass of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import distributions as D


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def precision_at_k(rows: DataFrame, k: int, group: str = "arxiv_id", score: str = "score", relevant: str = "relevant", ties: list[str] | None = None) -> DataFrame:
    """(precision): of each group's k best rows the relevant share, over min(k, rows), averaged over groups."""
    if k < 1:
        raise ValueError("k must be positive")
    w = Window.partitionBy(group).orderBy(F.desc(score), *(ties or []))
    best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    per = best.groupBy(group).agg(F.avg(F.col(relevant).cast("double")).alias("p"))
    return per.agg(F.avg("p").alias("precision"))


def class_metrics(rows: DataFrame, probabilities: str = "p", truth: str = "t", classes: int = D.CLASSES) -> DataFrame:
    """One row: n, brier, bce, macro_f1 and an array per class of precision, recall, f1, accuracy.

    truth is a distribution; its largest class (the first among equals) is the
    label. A measure without cases is 0. The cross entropy averages over rows and
    classes with probabilities kept off 0 and 1 by 1e-7.
    """
    p, t = F.col(probabilities), F.col(truth)
    rows = rows.withColumn("pc", F.array_position(p, F.array_max(p)) - 1).withColumn("tc", F.array_position(t, F.array_max(t)) - 1)
    clipped = F.transform(p, lambda x: F.greatest(F.least(x, F.lit(1 - 1e-7)), F.lit(1e-7)))
    square = D.total(F.zip_with(p, t, lambda x, y: (x - y) * (x - y)))
    cross = -D.total(F.zip_with(clipped, t, lambda x, y: y * F.ln(x) + (1 - y) * F.ln(1 - x))) / classes
    counts = []
    for c in range(classes):
        counts += [
            F.count_if((F.col("pc") == c) & (F.col("tc") == c)).alias(f"tp{c}"),
            F.count_if(F.col("pc") == c).alias(f"pp{c}"),
            F.count_if(F.col("tc") == c).alias(f"ap{c}"),
        ]
    one = rows.agg(F.count("*").alias("n"), F.avg(square).alias("brier"), F.avg(cross).alias("bce"), *counts)
    precision = [ratio(F.col(f"tp{c}"), F.col(f"pp{c}")) for c in range(classes)]
    recall = [ratio(F.col(f"tp{c}"), F.col(f"ap{c}")) for c in range(classes)]
    f1 = [ratio(2 * F.col(f"tp{c}"), F.col(f"pp{c}") + F.col(f"ap{c}")) for c in range(classes)]
    accuracy = [ratio(F.col("n") - F.col(f"pp{c}") - F.col(f"ap{c}") + 2 * F.col(f"tp{c}"), F.col("n")) for c in range(classes)]
    return one.select(
        "n", "brier", "bce", (sum(f1, F.lit(0.0)) / classes).alias("macro_f1"), F.array(*precision).alias("precision"), F.array(*recall).alias("recall"), F.array(*f1).alias("f1"), F.array(*accuracy).alias("accuracy")
    )


def binary_metrics(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: precision, recall, f1, accuracy of two boolean columns."""
    tp, pp, ap, n, right = F.count_if(predicted & actual), F.count_if(predicted), F.count_if(actual), F.count("*"), F.count_if(predicted == actual)
    one = rows.agg(tp.alias("tp"), pp.alias("pp"), ap.alias("ap"), n.alias("n"), right.alias("right"))
    return one.select(
        ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("ap")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1"), ratio(F.col("right"), F.col("n")).alias("accuracy")
    )


def inverse_frequency_weights(rows: DataFrame, distribution: str, classes: int = D.CLASSES) -> DataFrame:
    """(weights): the inverse mean mass of each observed class, scaled so that those have a mean of 1; 0 for unobserved ones."""
    one = rows.agg(*(F.avg(F.element_at(distribution, c + 1)).alias(f"m{c}") for c in range(classes)))
    raw = F.array(*(F.when(F.col(f"m{c}") > 0, 1 / F.col(f"m{c}")).otherwise(0.0) for c in range(classes)))
    seen = F.size(F.filter(raw, lambda x: x > 0))
    return one.select(F.transform(raw, lambda x: F.when(seen > 0, x * seen / D.total(raw)).otherwise(0.0)).alias("weights"))


def confusion(rows: DataFrame, truth: str, predicted: str, values: list) -> DataFrame:
    """Counts by truth (rows) and prediction (columns), 0 where there is none."""
    out = rows.groupBy(truth).pivot(predicted, values).count()
    return out.select(truth, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values))


def pairwise_ranking(pairs: DataFrame, better: str = "better", worse: str = "worse") -> DataFrame:
    """(accuracy, coverage): pairs whose better item is ranked before the other; an item not retrieved comes last, a pair of two such scores 0.5."""
    b, w = F.col(better), F.col(worse)
    score = F.when(b.isNull() & w.isNull(), 0.5).when(w.isNull(), 1.0).when(b.isNull(), 0.0).when(b < w, 1.0).when(b == w, 0.5).otherwise(0.0)
    return pairs.agg(F.avg(score).alias("accuracy"), F.avg((b.isNotNull() | w.isNotNull()).cast("double")).alias("coverage"))


def recall_at_k(retrieved: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """(recall, hit): over queries that have positives. retrieved: (query_id, target_id, rank); positives: (query_id, target_id)."""
    hits = positives.join(retrieved.where(F.col("rank") <= k), ["query_id", "target_id"], "left")
    per = hits.groupBy("query_id").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("r"), F.max(F.col("rank").isNotNull().cast("double")).alias("h"))
    return per.agg(F.avg("r").alias("recall"), F.avg("h").alias("hit"))


def mean_top_overlap(lists: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """(overlap): mean share of items that two ranked lists have in common among their first k."""
    both = F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k))) / F.lit(k)
    return lists.agg(F.avg(both).alias("overlap"))
