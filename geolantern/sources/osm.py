"""Points from OSM XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the parts of an OSM node that are read.
NODE_SCHEMA = "_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"


#: What a record of the text ends at: every closing tag, so that the ways after the nodes are short records too.
CLOSING = "</"


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Tagged nodes of OSM XML as (id, lat, lon, tags).

    Ways, relations and untagged nodes are dropped; of a repeated key the last value
    counts. A file is split between tasks like any text (unless it is compressed by gzip): it is cut at closing tags, and
    what such a cut leaves of a tagged node, from its opening tag on, is parsed. Tags must be empty elements
    (``<tag k="" v=""/>``), as OSM writers make them; others raise an error.
    """
    cut = spark.read.option("lineSep", CLOSING).text(path).where(
        F.when(F.col("value").startswith("tag"), F.raise_error(F.lit("OSM tags must be empty elements: <tag k=\"\" v=\"\"/>")).cast("boolean"))
        .otherwise(F.col("value").contains("<node"))
    )
    # Nodes do not nest: the last one opened is the one closed here, unless it closed itself.
    rest = cut.select(F.substring_index("value", "<node", -1).alias("rest")).where(
        F.col("rest").contains("<tag") & ~F.substring_index("rest", "<", 1).rlike(r"/>\s*$"))
    parsed = rest.select(F.from_xml(F.concat(F.lit("<node"), "rest", F.lit("</node>")), NODE_SCHEMA).alias("node"))
    tagged = parsed.select("node.*").where(F.size("tag") > 0)
    # An entry survives if no later entry has its key: last value wins.
    last = F.filter("tag", lambda t, i: F.array_position(
        F.transform(F.slice("tag", i + 2, F.size("tag")), lambda later: later["_k"]), t["_k"]
    ) == 0)
    tags = F.map_from_entries(F.transform(last, lambda t: F.struct(t["_k"], F.coalesce(t["_v"], F.lit("")))))
    return tagged.select(
        F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags")
    )


def clip(points: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Points inside a bounding box; the bounds reach the parquet scan."""
    return points.where(
        F.col("lat").between(F.lit(float(min_lat)), F.lit(float(max_lat)))
        & F.col("lon").between(F.lit(float(min_lon)), F.lit(float(max_lon)))
    )
