"""Choice of paragraphs to label: by model uncertainty, by disagreement, from each paper's best, and at random."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.operators.ranking import seeded_order, top_by, weighted_order

KEY = ["arxiv_id", "section_id", "paragraph_id"]


def _count(n: int) -> int:
    if n < 0:
        raise ValueError("a number of samples must not be negative")
    return n


def highest_entropy(samples: DataFrame, n: int, dist: str = "predicted_dist") -> DataFrame:
    """The n rows whose distribution is least certain, equal ones by key."""
    return samples.withColumn("__m", F.round(D.entropy(F.col(dist)), 9)).orderBy(F.desc("__m"), *KEY).limit(_count(n)).drop("__m")


def most_disagreement(samples: DataFrame, n: int, a: str = "predicted_dist", b: str = "gemma_dist") -> DataFrame:
    """The n rows whose two distributions lie furthest apart, equal ones by key."""
    return samples.withColumn("__m", F.round(D.weighted_emd(F.col(a), F.col(b)), 9)).orderBy(F.desc("__m"), *KEY).limit(_count(n)).drop("__m")


def top_of_papers(samples: DataFrame, k: int, dist: str = "predicted_dist") -> DataFrame:
    """Each paper's k rows of highest expected class, equal ones by key."""
    rows = samples.withColumn("__m", F.round(D.expected_class(F.col(dist)), 9))
    return top_by(rows, ["arxiv_id"], [F.desc("__m"), *map(F.col, KEY)], _count(k)).drop("__m")


def random_rows(samples: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, the same for the same seed whatever the partitioning; all if there are fewer."""
    return samples.orderBy(seeded_order(seed, *KEY), *KEY).limit(_count(n))


def weighted_random_rows(samples: DataFrame, n: int, seed: int, weight: str) -> DataFrame:
    """n rows without replacement with chances by weight; rows of weight zero come only after all others."""
    return samples.orderBy(weighted_order(seed, F.col(weight), *KEY), seeded_order(seed, *KEY), *KEY).limit(_count(n))


def select_samples(samples: DataFrame, entropy: int, disagreement: int, top_random: int, per_paper: int, random: int, weighted: int, seed: int, weight: str | None = None) -> DataFrame:
    """Ordered union of all strategies with column strategy; each takes from what earlier ones left, so no row repeats."""
    steps = [
        ("entropy", lambda s: highest_entropy(s, entropy)),
        ("disagreement", lambda s: most_disagreement(s, disagreement)),
        ("top_random", lambda s: random_rows(top_of_papers(s, per_paper), top_random, seed)),
        ("random", lambda s: random_rows(s, random, seed + 1)),
    ]
    if weight:
        steps.append(("weighted", lambda s: weighted_random_rows(s, weighted, seed + 2, weight)))
    left, out = samples, None
    for name, step in steps:
        got = step(left).withColumn("strategy", F.lit(name))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(*KEY), KEY, "left_anti")
    return out
