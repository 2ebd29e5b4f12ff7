"""Vector tables keyed by id, and incremental embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: columns of a stored vector table.
EMBEDDING_SCHEMA = "id long, embedding array<float>"


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)


def write_embeddings(embeddings: DataFrame, path: str, mode: str = "append") -> None:
    out = embeddings.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    out.write.mode(mode).parquet(path)


def missing_embeddings(points: DataFrame, existing: DataFrame) -> DataFrame:
    """Points without a stored vector."""
    return points.join(existing.select("id"), "id", "left_anti")


def is_complete(points: DataFrame, existing: DataFrame) -> bool:
    return missing_embeddings(points, existing).isEmpty()


def incremental_embed(points: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame]) -> int:
    """Embed only points that ``path`` lacks and append them; returns their number.

    ``encode`` maps points to (id, embedding). A run that died is resumed by the next.
    """
    spark = points.sparkSession
    try:
        existing = read_embeddings(spark, path)
        todo = missing_embeddings(points, existing)
    except Exception as error:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing, todo = None, points
    before = existing.count() if existing is not None else 0
    write_embeddings(encode(todo), path)
    return read_embeddings(spark, path).count() - before
