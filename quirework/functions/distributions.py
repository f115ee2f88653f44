"""Label distributions over five ordered classes, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the four gaps between neighbouring classes in the earth mover's distance.
GAP_WEIGHTS = (0.25, 1.25, 0.75, 0.25)
CLASSES = 5


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; an expression named inside a lambda is worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    both = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), both)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The array scaled to length one; null for a zero or null vector."""
    return bound(norm(a), lambda length: F.when(length > 0, F.transform(a.cast("array<double>"), lambda x: x / length)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where either is null, of length zero, or of another dimension."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def usable_vector(a: Column) -> Column:
    """Not null, not empty, every entry a finite number, not all zero."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) > 0) & fine & F.exists(a, lambda x: x != 0), F.lit(False))


def softmax(logits: Column) -> Column:
    powers = bound(F.array_max(logits), lambda top: F.transform(logits.cast("array<double>"), lambda x: F.exp(x - top)))
    return bound(powers, lambda p: bound(total(p), lambda whole: F.transform(p, lambda x: x / whole)))


def is_distribution(masses: Column, classes: int = CLASSES) -> Column:
    """Right length, finite, not negative, with some mass; false for null."""
    fine = F.forall(masses, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((F.size(masses) == classes) & fine & (total(masses.cast("array<double>")) > 0), F.lit(False))


def normalised(masses: Column, classes: int = CLASSES) -> Column:
    """Masses scaled to sum 1; an invalid distribution ends the query with an error."""
    scaled = bound(total(masses.cast("array<double>")), lambda whole: F.transform(masses.cast("array<double>"), lambda x: x / whole))
    return F.when(is_distribution(masses, classes), scaled).otherwise(
        F.raise_error(F.lit("a distribution needs five finite non-negative masses with a positive sum")).cast("array<double>")
    )


def entropy(distribution: Column) -> Column:
    """Natural-log entropy; a mass of zero adds nothing."""
    return F.aggregate(distribution, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def expected_class(distribution: Column, first: int = 1) -> Column:
    """Mean class with classes numbered from ``first``: 1 for labels and sampling, 0 for passage scores."""
    return F.aggregate(F.transform(distribution, lambda p, i: p * (i + first)), F.lit(0.0), lambda acc, x: acc + x)


def weighted_emd(a: Column, b: Column, weights: tuple[float, ...] = GAP_WEIGHTS) -> Column:
    """Earth mover's distance along the ordered classes: each gap's weight times the mass that must cross it."""
    out = F.lit(0.0)
    crossing = F.lit(0.0)
    for i, weight in enumerate(weights):
        crossing = crossing + (F.element_at(a, i + 1) - F.element_at(b, i + 1))
        out = out + F.abs(crossing) * F.lit(weight)
    return out


def yes_share(yes_logit: Column, no_logit: Column) -> Column:
    """Two-way softmax of a yes and a no logit."""
    return 1 / (1 + F.exp(no_logit - yes_logit))


def scaled_sigmoid(logit: Column, scale: float = 5.0) -> Column:
    return 1 / (1 + F.exp(-logit / scale))


def from_log_probabilities(values: Column) -> Column:
    """Probabilities of listed log-probabilities, scaled to sum 1; nulls count as none."""
    powers = F.transform(values, lambda x: F.coalesce(F.exp(x), F.lit(0.0)))
    return bound(powers, lambda p: bound(total(p), lambda whole: F.transform(p, lambda x: x / whole)))
