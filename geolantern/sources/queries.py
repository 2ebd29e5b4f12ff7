"""Query files: keyword with coordinates, or text whose coordinates are inferred."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

POSITION = ("part", "block", "pos")


def query_path(poi_path: str, folder: str = "data/queries") -> str:
    """Query file of a point file: named by the part before the first ``_`` or ``.``."""
    return os.path.join(folder, re.split(r"[_.]", os.path.basename(poi_path))[0] + ".csv")


def with_position(rows: DataFrame) -> DataFrame:
    """Add (part, block, pos): line order by file name, then within the file, split or not."""
    return rows.withColumns({
        "part": F.col("_metadata.file_name"), "block": F.col("_metadata.file_block_start"),
        "pos": F.monotonically_increasing_id(),
    })


def number_rows(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number rows 0, 1, ... per group; the last order column is a dense position.

    Positions are ranked inside buckets and shifted by the counts of earlier buckets,
    so no task sorts more than one bucket of rows.
    """
    *lead, pos = order
    cut = rows.withColumn("_bucket", F.floor(F.col(pos) / 65_536))
    keys = [*group, *lead, "_bucket"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(*lead, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys).orderBy(pos)
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1).join(starts, keys)
    return numbered.withColumn(out, F.col("_start") + F.col("_i")).drop("_bucket", "_start", "_i")


def parse_txt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split lines into triples (text, lat, lon) and plain texts, positions kept.

    A line is cut at commas if it has one, else at white space. Three or more parts with
    numbers in the second and third place make a triple.
    """
    value = strip(F.col("value"))
    kept = lines.select(*POSITION, value.alias("value")).where(F.col("value") != "")
    commas = F.transform(F.split("value", ","), strip)
    parts = F.when(F.contains("value", F.lit(",")), commas).otherwise(F.split("value", r"(?U)\s+"))
    cut = kept.withColumn("parts", parts)
    lat, lon = (F.get("parts", F.lit(i)).try_cast("double") for i in (1, 2))
    cut = cut.withColumns({"lat": lat, "lon": lon})
    is_triple = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    triples = cut.where(is_triple).select(F.get("parts", F.lit(0)).alias("text"), "lat", "lon", *POSITION)
    return triples, cut.where(~is_triple).select(F.col("value").alias("text"), *POSITION)


def parse_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split headerless CSV rows into triples and plain texts, positions kept.

    The number of columns of the file decides: three or more give triples, rows with bad
    numbers are skipped; one gives texts; two give nothing.
    """
    columns = [c for c in rows.columns if c not in POSITION]
    none = rows.where(F.lit(False)).select(
        F.lit("").alias("text"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), *POSITION
    )
    if len(columns) >= 3:
        first, second, third = columns[:3]
        triples = rows.select(
            strip(F.col(first)).alias("text"), F.col(second).try_cast("double").alias("lat"),
            F.col(third).try_cast("double").alias("lon"), *POSITION,
        ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        return triples, none.select("text", *POSITION)
    if len(columns) == 1:
        texts = rows.select(F.col(columns[0]).alias("text"), *POSITION).where(strip(F.col("text")) != "")
        return none, texts
    return none, none.select("text", *POSITION)


def read_queries(spark: SparkSession, path: str, infer=None) -> DataFrame:
    """(qid, text, lat, lon) of a query file; ``infer`` adds lat and lon to texts.

    Texts without coordinates follow the explicit triples, each group in file order.
    """
    if path.lower().rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", "false").option("escape", '"').csv(path)
        triples, texts = parse_csv(with_position(raw))
    else:
        triples, texts = parse_txt(with_position(spark.read.text(path)))
    found = triples.withColumn("grp", F.lit(0))
    if infer is not None:
        found = found.unionByName(
            infer(texts).select("text", "lat", "lon", *POSITION).withColumn("grp", F.lit(1))
        )
    elif not texts.isEmpty():
        raise ValueError("the file has texts without coordinates: pass infer")
    return number_queries(found)


def number_queries(found: DataFrame) -> DataFrame:
    """Number queries 0, 1, ... in (grp, part, block, pos) order."""
    numbered = number_rows(found, [], ["grp", *POSITION], "qid")
    return numbered.select("qid", "text", "lat", "lon")
