"""Scalar scores as Column expressions."""

from __future__ import annotations

from itertools import accumulate, takewhile
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from wfspark.functions.pay import Value, col


def bradford_score(spells: Value, days: Value) -> Column:
    """Spells squared times days."""
    return col(spells) * col(spells) * col(days)


def bradford_risk(score: Value, thresholds: tuple[float, float, float] = (50, 200, 500)) -> Column:
    low, moderate, substantial = thresholds
    s = col(score)
    return F.when(s.isNull() | (s <= low), "Low Friction").when(s <= moderate, "Moderate Friction").when(s <= substantial, "Substantial Friction").otherwise("Critical Friction")


def logarithmic_mean(a: Value, b: Value, epsilon: float = 1e-12) -> Column:
    """(a - b) / ln(a / b), a where they are equal, 0 unless both are positive."""
    x, y = col(a), col(b)
    return F.when((x <= 0) | (y <= 0), 0.0).when(F.abs(x - y) < epsilon, x).otherwise((x - y) / (F.ln(x) - F.ln(y)))


def _normal(p: Column, epsilon: float) -> Column:
    shifted = F.transform(p, lambda x: x + epsilon)
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def kl_divergence(p: Column, q: Column, epsilon: float = 1e-9) -> Column:
    """Kullback-Leibler divergence of two arrays of masses, in nats; both are shifted by epsilon and scaled to sum 1."""
    terms = F.zip_with(_normal(p, epsilon), _normal(q, epsilon), lambda x, y: x * F.ln(x / y))
    return F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def js_divergence(p: Column, q: Column, epsilon: float = 1e-9) -> Column:
    """Jensen-Shannon distance: the root of the divergence, at most sqrt(ln 2)."""
    a, b = _normal(p, epsilon), _normal(q, epsilon)
    middle = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest((kl_divergence(a, middle, epsilon) + kl_divergence(b, middle, epsilon)) / 2, F.lit(0.0)))


def fractional_weights(d: float, length: int, threshold: float = 1e-4) -> list[float]:
    """Weights of (1 - L)**d up to the first that is smaller than the threshold."""
    if not 0 <= d <= 1 or length < 1 or threshold <= 0:
        raise ValueError("d must lie in [0, 1]; length and threshold must be positive")
    ratios = ((k - 1 - d) / k for k in range(1, length))
    return list(takewhile(lambda w: abs(w) >= threshold, accumulate(ratios, mul, initial=1.0)))
