"""Point files and the point table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import parse_tags

# Columns of a point file.
CSV_SCHEMA = "id long, lat double, lon double, tags string"
_CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "multiLine": "false"}


def read_pois_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Points of a CSV file; missing or malformed tags become an empty dictionary.

    ``multi_line`` accepts line breaks inside quotes but reads each file in one task.
    """
    options = {**_CSV_OPTIONS, "multiLine": str(multi_line).lower()}
    raw = spark.read.schema(CSV_SCHEMA).options(**options).csv(path)
    return raw.withColumn("tags", parse_tags("tags"))


def write_pois_csv(points: DataFrame, path: str) -> None:
    """Points as CSV with the tags as JSON text, line breaks escaped by JSON."""
    out = points.select("id", "lat", "lon", F.to_json("tags").alias("tags"))
    out.write.mode("overwrite").options(header="true", escape='"', quote='"').csv(path)


def valid_coords(points: DataFrame) -> DataFrame:
    """Points with both coordinates; a blank coordinate reads as NULL."""
    return points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def nonempty_tags(points: DataFrame) -> DataFrame:
    return points.where(F.size("tags") > 0)


def first_per_id(records: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per id: the first in ``seq`` order, or any where order is not given."""
    if seq is None:
        return records.dropDuplicates(["id"])
    # min_by combines on the map side, so a heavily repeated id costs one row per task.
    rest = [c for c in records.columns if c not in ("id", seq)]
    first = records.groupBy("id").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return first.select("id", *[F.col("_row")[c].alias(c) for c in rest])


def insert_ignore(existing: DataFrame | None, records: DataFrame, seq: str | None = None) -> DataFrame:
    """Rows to append so that the first row of each id wins and known ids are ignored."""
    fresh = first_per_id(records, seq)
    if existing is None:
        return fresh
    return fresh.join(existing.select("id"), "id", "left_anti")


def check_vectors(points: DataFrame, dim: int, column: str = "embedding") -> None:
    """Fail if a vector is present whose length is not ``dim``."""
    wrong = points.where(F.col(column).isNotNull() & (F.size(column) != dim)).limit(1).count()
    if wrong:
        raise ValueError(f"column {column} has vectors that are not {dim} long")


def attach_embeddings(points: DataFrame, embeddings: DataFrame, how: str = "inner", check: bool = False) -> DataFrame:
    """Points with their vectors, joined on id; ``check`` compares the row counts."""
    joined = points.join(embeddings.select("id", "embedding"), "id", how)
    if check and points.count() != embeddings.count():
        raise ValueError("points and embeddings differ in number")
    return joined


def create_table(points: DataFrame, name: str, dim: int | None = None, buckets: int = 0) -> DataFrame:
    """Replace table ``name``, verify it and refresh its statistics.

    ``buckets`` buckets the table by id, so later joins with its vectors do not shuffle.
    """
    spark = points.sparkSession
    if dim is not None:
        check_vectors(points, dim)
    writer = points.write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, "id").sortBy("id")
    writer.saveAsTable(name)
    if not spark.catalog.tableExists(name):
        raise RuntimeError(f"table {name} was not created")
    analyze_table(spark, name)
    return spark.table(name)


def append_table(records: DataFrame, name: str, seq: str | None = None) -> None:
    """Append with first-wins semantics against the stored ids."""
    spark = records.sparkSession
    fresh = insert_ignore(spark.table(name), records, seq)
    fresh.select(spark.table(name).columns).write.mode("append").insertInto(name)


def analyze_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    flat = [f.name for f in spark.table(name).schema if f.dataType.typeName() in ("long", "integer", "double", "string")]
    if flat:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(flat)}")


def with_sequence(records: DataFrame, *order) -> DataFrame:
    """Arrival order by explicit columns, per id only: no global sort."""
    by_id = Window.partitionBy("id").orderBy(*order)
    return records.withColumn("seq", F.row_number().over(by_id))
