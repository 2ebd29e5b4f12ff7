"""Generated query workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FAMILIES
from ..functions.geo import metres_to_degrees, round_coord
from ..functions.vectors import round_vector
from ..operators.sampling import sample_donors, sample_points
from ..operators.search import keyword_search
from ..operators.topk import vector_topk
from ..session import materialize


def dataset_queries(points: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """(qid, text, lat, lon, tag_key, tag_value): sampled places with sampled donor tags.

    The text of a query is its tag value.
    """
    places = sample_points(points, n, seed).select("draw", "lat", "lon")
    donors = sample_donors(points, n, seed + 1)
    return places.join(donors, "draw").select(
        F.col("draw").alias("qid"), F.col("tag_value").alias("text"),
        round_coord("lat").alias("lat"), round_coord("lon").alias("lon"), "tag_key", "tag_value",
    )


def custom_queries(queries: DataFrame) -> DataFrame:
    """Queries (qid, text, lat, lon) of a file: the whole text is looked up as a tag key."""
    return queries.select(
        "qid", "text", round_coord("lat").alias("lat"), round_coord("lon").alias("lon"),
        F.col("text").alias("tag_key"), F.lit(None).cast("string").alias("tag_value"),
    )


def build_workload(
    queries: DataFrame, ks, radius_m: float | None, source: str, vectors: dict[str, str], order_by: str = "planar"
) -> DataFrame:
    """Every query in every family and for every k, as typed workload rows.

    ``vectors`` maps a family to the query column with its vector; the plain family asks
    for the tag. A radius applies to the plain and the semantic family only.
    """
    radius = F.lit(metres_to_degrees(radius_m)).cast("double")
    no_text, no_vector = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    rows = []
    for family in ("", *vectors):
        if family not in FAMILIES:
            raise ValueError(f"unknown family {family!r}")
        plain, fused = family == "", family not in ("", "embedded_")
        rows.append(F.struct(
            F.lit(family).alias("family"),
            (F.lit(None).cast("double") if fused else radius).alias("radius_deg"),
            (F.col("tag_key") if plain else no_text).alias("tag_key"),
            (F.col("tag_value") if plain else no_text).alias("tag_value"),
            (no_vector if plain else round_vector(vectors[family])).alias("qvec"),
            F.lit(order_by if plain else "similarity").alias("order_by"),
        ))
    wide = queries.select("qid", "lat", "lon", F.explode(F.array(*rows)).alias("q"))
    return wide.select(
        F.lit(source).alias("source"), "q.family", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"),
        "qid", "lat", "lon", "q.radius_deg", "q.tag_key", "q.tag_value", "q.qvec", "q.order_by",
    ).withColumn("limit", F.col("k"))


def run_workload(points: DataFrame, workload: DataFrame, vectors: dict[str, str] | None = None) -> DataFrame:
    """Results of typed workload rows, as loaded from statement files or built.

    Queries of one kind run as one batch whatever file they come from: a file's key
    columns return with its results. ``vectors`` maps a vector family to the column of
    ``points`` that holds its vectors; queries of another length than that column's
    vectors find nothing.
    """
    vectors = vectors or {"embedded_": "embedding", "concat_embedded_": "concat",
                          "contrastive_embedded_": "contrastive"}
    keys = [c for c in ("experiment", "source", "family", "k") if c in workload.columns]
    rows = materialize(workload.withColumnRenamed("qid", "line"), "workload")
    # Numbered after writing, so that the numbers hold; a query is one row of the table.
    rows = materialize(rows.withColumn("qid", F.monotonically_increasing_id()), "workload-rows")
    kinds = rows.groupBy("family", "order_by", F.size("qvec").alias("dim")).agg(F.max("limit").alias("limit")).collect()
    found = None
    for kind in kinds:
        mine = rows.where(
            (F.col("family") == kind["family"]) & (F.col("order_by") == kind["order_by"])
            & (F.size("qvec").eqNullSafe(kind["dim"]))
        )
        if kind["order_by"] == "similarity":
            column = vectors[kind["family"]]
            asked = mine.select("qid", "lat", "lon", "radius_deg", F.col("qvec").alias(column))
            got = vector_topk(points, asked, kind["limit"], parts=(column,))
        else:
            order = "planar" if kind["order_by"] == "planar" else "geodesic"
            got = keyword_search(points, mine, kind["limit"], order).withColumn("similarity", F.lit(None).cast("double"))
        got = got.select("qid", "rank", "id", "tags", "distance", "similarity")
        found = got if found is None else found.unionByName(got)
    if found is None:
        raise ValueError("the workload is empty")
    named = rows.select("qid", *keys, "line", "limit")
    return (
        found.join(named, "qid").where(F.col("rank") <= F.col("limit"))
        .select(*keys, F.col("line").alias("qid"), "rank", "id", "tags", "distance", "similarity")
    )
