"""Stored access tables that searches read: places in Z-order, and postings by term and place.

A table is a folder of Parquet files in key order with a manifest of the key range of every file. A search
turns its queries into key ranges, opens only the files whose range they touch, and pushes the ranges
down so that row groups are skipped within them. Both tables order places alike, so a query with a tag
and a radius is met by the postings of its term within its circle, and nothing else is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_small, materialize
from .search import FEW_QUERIES, _inspect, asked_terms, postings, search_terms

# Bits of a coordinate in a place key, and files of a table.
PLACE_BITS, FILES = 20, 200
# Key ranges up to which they are pushed down as literals.
PUSHED_RANGES = 64
# Room for rounding when a circle is turned into cells.
MARGIN_DEG = 1e-9


def _spread(x: Column) -> Column:
    """Puts a zero bit in front of each of the lowest 20 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _steps(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of a place in the finest grid; places beyond the globe count as at its edge."""
    def step(value, low, extent):
        at = F.floor((value - low) / extent * (1 << PLACE_BITS))
        return F.greatest(F.lit(0).cast("long"), F.least(at.cast("long"), F.lit((1 << PLACE_BITS) - 1).cast("long")))

    return step(lat, -90.0, 180.0), step(lon, -180.0, 360.0)


def place_key(lat="lat", lon="lon") -> Column:
    """Interleaved bits of latitude and longitude: near keys are near places."""
    row, column = _steps(F.col(lat), F.col(lon))
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(column))


def circle_ranges(queries: DataFrame) -> DataFrame:
    """(qid, low, high): the key ranges of at most four cells that cover each query's circle.

    Queries without radius get the range of the whole globe.
    """
    reach = F.col("radius_deg") + MARGIN_DEG
    # Cells at least as high and wide as the circle: it touches two in each direction at most.
    level = F.floor(F.log2(180.0 / F.greatest(2 * reach, F.lit(180.0 / (1 << PLACE_BITS))))).cast("int")
    level = F.greatest(F.lit(0), F.least(level, F.lit(PLACE_BITS)))
    drop = F.lit(PLACE_BITS) - F.col("level")

    def shifted(name, column, by):
        return F.call_function(name, column, by)

    boxes = queries.withColumn("level", F.when(F.col("radius_deg").isNull(), 0).otherwise(level))
    low = _steps(F.col("lat") - reach, F.col("lon") - reach)
    high = _steps(F.col("lat") + reach, F.col("lon") + reach)
    for name, a, b in (("row", low[0], high[0]), ("column", low[1], high[1])):
        a, b = (shifted("shiftright", F.coalesce(x, F.lit(0).cast("long")), drop) for x in (a, b))
        boxes = boxes.withColumn(name, F.explode(F.sequence(a, b)))
    key = F.shiftleft(_spread(F.col("row")), 1).bitwiseOR(_spread(F.col("column")))
    return boxes.select(
        "qid", shifted("shiftleft", key, 2 * drop).alias("low"),
        (shifted("shiftleft", key + 1, 2 * drop) - 1).alias("high"))


def _write(rows: DataFrame, path: str, keys: list[str], files: int) -> None:
    """Files in key order; the id is part of the range key, so a hot key spreads over several files."""
    ordered = rows.repartitionByRange(files, *keys, "id").sortWithinPartitions(*keys, "id")
    ordered.write.mode("overwrite").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), *keys)
    facts = [f(k).alias(f"{side}_{k}") for k in keys for side, f in (("low", F.min), ("high", F.max))]
    stored.groupBy("file").agg(F.count("*").alias("n"), *facts).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def write_places(points: DataFrame, path: str, files: int = FILES) -> None:
    """Store points by place, all their columns (tags, vectors) with them."""
    _write(points.withColumn("place", place_key()), path, ["place"], files)


def write_postings(points: DataFrame, path: str, files: int = FILES) -> None:
    """Store (term, place, id, lat, lon) of every tag key and every key and value of the points."""
    terms = postings(points.select("id", "lat", "lon", "tags")).drop("tags")
    _write(terms.withColumn("place", place_key()), path, ["term", "place"], files)


def _read(spark: SparkSession, path: str, touched: DataFrame) -> DataFrame:
    """The rows of the files that ``touched(file)`` names; their number is bounded by that of the table's files."""
    rows = spark.read.parquet(f"{path}/rows")
    files = [r[0] for r in touched.distinct().collect()]
    return spark.read.schema(rows.schema).parquet(*files) if files else rows.limit(0)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _within(ranges: DataFrame) -> tuple[Column | None, bool]:
    """A pushed-down test of the ranges, if they are few."""
    few = ranges.select("low", "high").distinct().limit(PUSHED_RANGES + 1).collect()
    if len(few) > PUSHED_RANGES:
        return None, False
    test = F.lit(False)
    for r in few:
        test = test | F.col("place").between(r["low"], r["high"])
    return test, True


def places_near(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """The stored points that can lie in the circle of some query; all if one has no radius.

    A batch of more than ``FEW_QUERIES`` queries reads the whole table.
    """
    if not is_small(queries, FEW_QUERIES):
        return spark.read.parquet(f"{path}/rows").drop("place")
    ranges = materialize(circle_ranges(queries), "place-ranges")
    manifest = _manifest(spark, path)
    # At most four ranges for each of FEW_QUERIES queries against a row per file.
    touched = manifest.join(F.broadcast(ranges), (manifest["low_place"] <= ranges["high"]) & (manifest["high_place"] >= ranges["low"]), "left_semi")
    rows = _read(spark, path, touched.select("file"))
    test, _ = _within(ranges)
    return (rows if test is None else rows.where(test)).drop("place")


def postings_of(spark: SparkSession, path: str, queries: DataFrame, near: bool = True) -> DataFrame:
    """The stored postings of the queries' terms, and with ``near`` only those that can lie in the circles.

    ``queries`` is as for ``keyword_search``. A batch of more than ``FEW_QUERIES`` reads the whole table.
    """
    asked = asked_terms(queries)
    if not is_small(asked, FEW_QUERIES):
        return spark.read.parquet(f"{path}/rows").join(asked.select("term").distinct(), "term", "left_semi")
    circles = asked.select("qid", F.col("qlat").alias("lat"), F.col("qlon").alias("lon"), F.col("radius_deg") if near else F.lit(None).cast("double").alias("radius_deg"))
    ranges = circle_ranges(circles).join(asked.select("qid", "term"), "qid").select("term", "low", "high").distinct()
    ranges = materialize(ranges, "term-ranges")
    m, r = _manifest(spark, path), ranges
    # A file of one term has a range of places; one of several terms holds any place of those between its ends.
    place = (m["low_place"] <= r["high"]) & (m["high_place"] >= r["low"])
    meets = (m["low_term"] <= r["term"]) & (m["high_term"] >= r["term"]) & ((m["low_term"] < m["high_term"]) | place)
    rows = _read(spark, path, m.join(F.broadcast(ranges), meets, "left_semi").select("file"))
    terms = [x[0] for x in ranges.select("term").distinct().collect()]
    rows = rows.where(F.col("term").isin(terms))
    test, _ = _within(ranges)
    return rows if test is None else rows.where(test)


def keyword_search(
    spark: SparkSession, postings_path: str, places_path: str, queries: DataFrame, k: int, near: bool = True, **options
) -> DataFrame:
    """``search.keyword_search`` from the stored postings, read by term alone or (``near``) by term and place.

    Tags are fetched for the results only, from the files of the places where those lie.
    """
    asked = asked_terms(queries)
    terms = postings_of(spark, postings_path, queries, near).select("term", "id", "lat", "lon", "place")
    found = materialize(search_terms(terms, asked, _inspect(asked), k, **options), "stored-found")
    m = _manifest(spark, places_path)
    at = found.select("place").distinct()
    if is_small(at):
        touched = m.join(F.broadcast(at), at["place"].between(m["low_place"], m["high_place"]), "left_semi")
        places = _read(spark, places_path, touched.select("file"))
    else:
        places = spark.read.parquet(f"{places_path}/rows")
    tags = places.select("place", "id", "tags")
    ids = found.select("place", "id").distinct()
    tags = tags.join(F.broadcast(ids) if is_small(ids) else ids, ["place", "id"], "left_semi")
    return found.join(tags, ["place", "id"]).select("qid", "rank", "id", "tags", "distance")
