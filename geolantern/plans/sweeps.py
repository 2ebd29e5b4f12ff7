"""Parameter sweeps: one pass over the points per sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import metres_to_degrees
from ..operators.search import keyword_search
from ..operators.topk import concat_setting, vector_topk, weighted_setting

# Swept radii in metres (0: none), repeats and (text, spatial) weights.
RADII = (2000, 5000, 10000, 20000, 50000, 0)
LAMBDAS = (1, 2, 3, 4)
WEIGHTS = ((1.0, 1.0), (1.0, 0.75), (1.0, 0.5), (1.0, 0.25), (1.0, 0.0))


def lambda_sweep(points: DataFrame, queries: DataFrame, k: int, lambdas=LAMBDAS, **options) -> DataFrame:
    """Concatenation search for every repeat count from the parts ``spatial`` and ``embedding``."""
    settings = {str(x): concat_setting(x) for x in lambdas}
    return vector_topk(points, queries, k, ("spatial", "embedding"), settings, **options)


def weight_sweep(points: DataFrame, queries: DataFrame, k: int, weights=WEIGHTS, **options) -> DataFrame:
    """Weighted-fusion search for every weight pair from the parts ``zt`` and ``zl``."""
    settings = {f"{t}:{s}": weighted_setting(t, s) for t, s in weights}
    return vector_topk(points, queries, k, ("zt", "zl"), settings, **options)


def expand_radii(queries: DataFrame, radii=RADII) -> DataFrame:
    """One query per radius; ``base_qid`` and ``radius_m`` tell them apart."""
    options = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(r).alias("radius_m"),
                 F.lit(metres_to_degrees(r)).cast("double").alias("radius_deg"))
        for i, r in enumerate(radii)
    ])
    wide = queries.drop("radius_deg").withColumn("_r", F.explode(options))
    return wide.withColumnRenamed("qid", "base_qid").select(
        "*", (F.col("base_qid") * len(radii) + F.col("_r.i")).alias("qid"), "_r.radius_m", "_r.radius_deg"
    ).drop("_r")


def radius_sweep(points: DataFrame, queries: DataFrame, k: int, radii=RADII, order: str = "geodesic") -> DataFrame:
    """Spatial-keyword search for every radius."""
    found = keyword_search(points, expand_radii(queries, radii), k, order=order)
    size = len(radii)
    radius = F.element_at(F.array(*[F.lit(r) for r in radii]), (F.col("qid") % size + 1).cast("int"))
    return found.withColumns({"radius_m": radius, "qid": F.floor(F.col("qid") / size)})
