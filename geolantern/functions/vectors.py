"""Vector columns: products, norms and fusion."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import VECTOR_DECIMALS


def as_double(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    squares = F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def cosine_similarity(a, b) -> Column:
    """Cosine of two vectors; 0 when either is the zero vector."""
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def l2_normalize(v, eps: float = 0.0) -> Column:
    """Unit vector. The norm is clamped to ``eps``; the zero vector stays zero."""
    # The norm is bound once through a one-element array instead of per element.
    bound = F.transform(F.array(F.greatest(l2_norm(v), F.lit(float(eps)))), lambda n: F.transform(
        as_double(v), lambda x: F.when(n == 0, 0.0).otherwise(x / n)
    ))
    return bound[0]


def round_vector(v, decimals: int = VECTOR_DECIMALS) -> Column:
    """Query vector as it appears in a workload."""
    return F.transform(as_double(v), lambda x: F.round(x, decimals))


def repeat_vector(v, times: int) -> Column:
    return F.flatten(F.array_repeat(v, times))


def concat_fuse(spatial, semantic, lam: int) -> Column:
    """Unit concatenation of the spatial vector, repeated, and the semantic one."""
    return l2_normalize(F.concat(repeat_vector(as_double(spatial), lam), as_double(semantic)))


def weighted_fuse(text, location, w_text: float = 1.0, w_spatial: float = 1.0) -> Column:
    """Unit weighted sum of a text and a location vector of equal length."""
    return l2_normalize(F.zip_with(
        as_double(text), as_double(location),
        lambda t, l: F.lit(float(w_text)) * t + F.lit(float(w_spatial)) * l,
    ))


def mean_vector(v) -> Column:
    """Aggregate: mean of a vector column, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(v))))


def mean_pool(tokens: DataFrame, group: str, vector: str, mask: str, dim: int) -> DataFrame:
    """Mean of the token vectors with mask 1 per group; zeros when none is active."""
    active = tokens.where(F.col(mask) == 1).groupBy(group).agg(mean_vector(vector).alias(vector))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (
        tokens.select(group).distinct().join(active, group, "left")
        .withColumn(vector, F.coalesce(vector, zeros))
    )
