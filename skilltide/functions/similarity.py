"""Similarity of dense and sparse vectors as JVM expressions, and exact hybrid scores in decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RunParams

DECIMAL = "decimal(26,22)"


def dot(x: Column, y: Column) -> Column:
    """Dot product; arrays of different lengths raise an error."""
    same = F.size(x) == F.size(y)
    value = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return F.when(same & (F.size(x) > 0), value).otherwise(F.raise_error(F.lit("dense vectors need one common length above 0")).cast("double"))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, t: s + t * t))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalize(x: Column) -> Column:
    def scaled(v: Column) -> Column:
        return bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda t: t / n)).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>")))

    return bound(x, scaled)


def sparse_norm(weights: Column) -> Column:
    return norm(F.map_values(weights))


def sparse_cosine(x: Column, y: Column, norm_x: Column, norm_y: Column) -> Column:
    """Cosine over full norms; 0 without a common key or with a zero norm."""
    both = F.map_values(F.map_zip_with(x, y, lambda _, a, b: F.coalesce(a * b, F.lit(0.0))))
    shared = F.aggregate(both, F.lit(0.0), lambda s, t: s + t)
    return F.when((norm_x > 0) & (norm_y > 0), shared / (norm_x * norm_y)).otherwise(F.lit(0.0))


def _whole(n: int) -> Column:
    """An integer as the narrowest decimal: wider ones would cost digits behind the point in products."""
    return F.lit(n).cast(f"decimal({len(str(n))},0)")


def hybrid_exact(dense: Column | None, sparse: Column | None, params: RunParams) -> Column:
    """Weighted sum of the scores' decimal texts times the weights' denominator, as a decimal."""
    a, b, _ = params.integers
    parts = [_whole(w) * s.cast(DECIMAL) for w, s in ((a, dense), (b, sparse)) if w]
    return parts[0] if len(parts) == 1 else parts[0] + parts[1]


def hybrid(exact_score: Column, params: RunParams) -> Column:
    return exact_score.cast("double") / params.integers[2]


def reaches(exact_score: Column, params: RunParams) -> Column:
    """Whether the exact hybrid score reaches the similarity threshold, without rounding."""
    t, w = params.similarity, params.integers[2]
    return exact_score * _whole(t.denominator) >= _whole(t.numerator * w)
