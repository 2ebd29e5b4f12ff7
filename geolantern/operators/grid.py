"""Grid cells: the access table for places and the radius join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import planar_distance, within_degrees
from ..session import is_small

# Copies of a small side, and slices of a hot cell, where neither side is broadcast.
SALTS = 16
DEFAULT_CELL_DEG = 0.05
# Width of the cells of the smallest radii, zero included.
SMALLEST_DEG = 1e-6


def with_cell(points: DataFrame, size: float) -> DataFrame:
    """Add the grid cell (cy, cx) of cells ``size`` degrees wide."""
    return points.withColumns({
        "cy": F.floor(F.col("lat") / F.lit(float(size))),
        "cx": F.floor(F.col("lon") / F.lit(float(size))),
    })


def grid_table(points: DataFrame, size: float = DEFAULT_CELL_DEG) -> DataFrame:
    """Points per cell."""
    return with_cell(points, size).groupBy("cy", "cx").agg(F.count("*").alias("n"))


def covering_cells(queries: DataFrame, size: float) -> DataFrame:
    """Queries exploded to the cells their radius box touches."""
    width = F.lit(float(size))

    def span(col):
        low = F.floor((F.col(col) - F.col("radius_deg")) / width)
        return F.sequence(low, F.floor((F.col(col) + F.col("radius_deg")) / width))

    return queries.withColumn("cy", F.explode(span("lat"))).withColumn("cx", F.explode(span("lon")))


def equi_join(
    points: DataFrame, lookup: DataFrame, keys: list[str], small: bool | None = None, salt_on: str = "id"
) -> DataFrame:
    """Join a large side to a lookup: broadcast if its checked size allows, else salted.

    ``small`` passes on the outcome of a check already made.

    The salt cuts every key of the large side into slices, so a key that holds a third
    of the rows is spread over ``SALTS`` tasks; AQE splits further.
    """
    if is_small(lookup) if small is None else small:
        return points.join(F.broadcast(lookup), keys)
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def radius_join(points: DataFrame, queries: DataFrame, size: float | None = None) -> DataFrame:
    """Every (query, point) pair within the radius of the query, planar, in degrees.

    An equi-join on grid cells with the exact test on top. Queries fall into classes: cells of a
    class are as wide as the power of two that its radii come up to, so a query touches at most
    nine cells of its class and meets no more points for another's larger radius. A point is
    matched once per class there is. ``size`` puts all queries into one class of that width.
    Queries without radius take no part: their answer is the whole table.
    """
    asked = queries.where(F.col("radius_deg").isNotNull()).select(
        "qid", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.col("radius_deg").cast("double").alias("radius_deg")
    )
    if size is None:
        asked = asked.withColumn("width", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("radius_deg", F.lit(SMALLEST_DEG))))))
        # Powers of two between the smallest width and a whole turn: some thirty at most.
        widths = sorted(r[0] for r in asked.select("width").distinct().collect())
    else:
        asked, widths = asked.withColumn("width", F.lit(float(size))), [float(size)]
    if not widths:
        widths = [DEFAULT_CELL_DEG]

    def cell(column):
        return F.floor(F.col(column) / F.col("width"))

    def span(column):
        return F.sequence(
            F.floor((F.col(column) - F.col("radius_deg")) / F.col("width")),
            F.floor((F.col(column) + F.col("radius_deg")) / F.col("width")))

    cells = asked.withColumn("cy", F.explode(span("qlat"))).withColumn("cx", F.explode(span("qlon")))
    placed = points.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])) if len(widths) > 1 else F.lit(widths[0]))
    placed = placed.withColumns({"cy": cell("lat"), "cx": cell("lon")})
    pairs = equi_join(placed, cells, ["width", "cy", "cx"])
    near = pairs.where(within_degrees("lat", "lon", "qlat", "qlon", F.col("radius_deg")))
    return near.withColumn("planar", planar_distance("lat", "lon", "qlat", "qlon")).drop("width", "cy", "cx")
