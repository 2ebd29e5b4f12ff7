"""The top-k query families over a table of points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISTANCE_DECIMALS, MAX_METRES_PER_DEGREE, METRES_PER_DEGREE, SPHERE_SLACK
from ..functions.geo import haversine, planar_distance, with_geodesic, within_degrees
from ..session import BROADCAST_ROWS, materialize
from .grid import DEFAULT_CELL_DEG, equi_join
from .topk import concat_setting, vector_topk

# Distinct keys up to which a query batch filters tag entries by a literal list.
LITERAL_KEYS = 64
# Queries up to which every cell of a term is tested; above, coarser grids come first.
FEW_QUERIES = 1000
COARSER = 16
# Matches are counted in cells so many levels finer than the grid; a cell is split while it holds more
# matches than this per result.
FINER_LEVELS, DENSE_PER_RESULT = 2, 100

_PAIR_MARK, _KEY_MARK = "\x01", "\x02"


def pair_term(key, value) -> Column:
    return F.concat(key, F.lit(_PAIR_MARK), value)


def key_term(key) -> Column:
    return F.concat(key, F.lit(_KEY_MARK))


def query_terms(queries: DataFrame) -> DataFrame:
    """Queries with the ``term`` they look for: a key and value, or a key alone."""
    pair = F.when(F.col("tag_value").isNotNull(), pair_term("tag_key", "tag_value"))
    return queries.withColumn("term", F.coalesce(pair, key_term("tag_key")))


def postings(points: DataFrame, pairs: bool = True, keys: bool = True, only_keys=None) -> DataFrame:
    """One row per point and term: every (key, value) and every key of its tags."""
    entries = F.map_entries("tags")
    if only_keys is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(list(only_keys)))
    lists = []
    if pairs:
        lists.append(F.transform(entries, lambda e: pair_term(e["key"], e["value"])))
    if keys:
        lists.append(F.transform(entries, lambda e: key_term(e["key"])))
    terms = F.concat(*lists)
    return points.withColumn("term", F.explode(terms)).where(F.col("term").isNotNull())


def posting_table(points: DataFrame) -> DataFrame:
    """Keyword access table: (key, value, id)."""
    return points.select("id", F.explode("tags").alias("key", "value"))


def document_frequency(points: DataFrame) -> DataFrame:
    """Points per key and value."""
    return posting_table(points).groupBy("key", "value").agg(F.count("*").alias("df"))


class _Batch(NamedTuple):
    """What a query batch looks for, found by one job over a bounded head of it."""

    small: bool
    queries: int
    pairs: bool
    keys: bool
    only_keys: list[str] | None


def _inspect(asked: DataFrame) -> _Batch:
    head = asked.select("tag_key", "tag_value").limit(BROADCAST_ROWS + 1).agg(
        F.count("*").alias("n"), F.count("tag_value").alias("pairs"), F.collect_set("tag_key").alias("names")
    ).first()
    if head["n"] > BROADCAST_ROWS:
        return _Batch(False, head["n"], True, True, None)
    few = head["names"] if len(head["names"]) <= LITERAL_KEYS else None
    return _Batch(True, head["n"], head["pairs"] > 0, head["pairs"] < head["n"] or not head["n"], few)


def _terms_of(points: DataFrame, asked: DataFrame, batch: _Batch) -> DataFrame:
    """Postings restricted to the kinds, keys and terms a query batch looks for."""
    rows = postings(points, batch.pairs, batch.keys, batch.only_keys)
    if not batch.small:
        # The equi-join on the terms that follows drops foreign ones.
        return rows
    return rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")


def keyword_join(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (query, point) pair where the point carries the key, or key and value."""
    asked = query_terms(queries).withColumnsRenamed({"lat": "qlat", "lon": "qlon"})
    batch = _inspect(asked)
    return equi_join(_terms_of(points, asked, batch), asked, ["term"], batch.small).drop("term")


def _rank(df: DataFrame, k: int, *order) -> DataFrame:
    by_query = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _candidate_cells(near: DataFrame, k: int, order: str, radius_mode: str, size: float) -> DataFrame:
    """Of (query, cell) rows, the cells that can hold one of the k nearest matches.

    Every match of a cell lies within ``reach`` and no match is nearer than ``gap``.
    Cells fully inside the radius whose reaches come first and that together hold k
    matches bound the k-th distance; every cell that begins beyond the bound is out.
    The windows sort cells, whose number depends on the grid and not on the points.
    """
    half_deg = size * 0.5 ** 0.5
    half_m = half_deg * MAX_METRES_PER_DEGREE
    near = near.withColumns({
        "clat": (F.col("cy") + 0.5) * F.lit(size), "clon": (F.col("cx") + 0.5) * F.lit(size),
    })
    near = near.withColumns({
        "deg": planar_distance("clat", "clon", "qlat", "qlon"),
        "metres": haversine("clat", "clon", "qlat", "qlon"),
    })
    by_degrees = (F.col("deg") - half_deg, F.col("deg") + half_deg)
    by_metres = (
        F.col("metres") * (1 - SPHERE_SLACK) - half_m, F.col("metres") * (1 + SPHERE_SLACK) + half_m
    )
    gap, reach = by_degrees if order == "planar" else by_metres
    begins, ends = by_degrees if radius_mode == "degrees" else by_metres
    radius = F.col("radius_deg") * (1.0 if radius_mode == "degrees" else METRES_PER_DEGREE)
    near = near.where(radius.isNull() | (begins <= radius)).withColumns({
        "gap": gap, "reach": reach, "whole": radius.isNull() | (ends <= radius),
    })
    by_query = Window.partitionBy("qid").orderBy("reach", "cy", "cx")
    running = by_query.rowsBetween(Window.unboundedPreceding, 0)
    seen = near.withColumn("seen", F.sum(F.when(F.col("whole"), F.col("n"))).over(running))
    enough = F.when(F.col("whole") & (F.col("seen") >= k), F.col("reach"))
    bounded = seen.withColumn("bound", F.min(enough).over(Window.partitionBy("qid")))
    # The margin covers rounding in the distances compared.
    margin = F.lit(1e-9 if order == "planar" else 0.001)
    kept = bounded.where(F.col("bound").isNull() | (F.col("gap") <= F.col("bound") + margin))
    return kept.select("qid", "qlat", "qlon", "radius_deg", "term", "cy", "cx", "n")


def _layer(counts: DataFrame, depth: int) -> DataFrame:
    """Matches per term and cell of ``cell / COARSER**depth`` degrees, from the finest counts."""
    if depth == FINER_LEVELS:
        return counts
    ratio = COARSER ** (FINER_LEVELS - depth)
    parent = {c: F.floor(F.col(c) / ratio) for c in ("cy", "cx")}
    return counts.withColumns(parent).groupBy("term", "cy", "cx").agg(F.sum("n").alias("n"))


def _descend(parents: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """The counted cells of a depth inside candidate cells of the depth above it."""
    layer = _layer(counts, depth).withColumns({
        "py": F.floor(F.col("cy") / COARSER), "px": F.floor(F.col("cx") / COARSER)})
    above = parents.drop("n").withColumnsRenamed({"cy": "py", "cx": "px"})
    return equi_join(above, layer, ["term", "py", "px"], salt_on="qid").drop("py", "px")


def _search_cells(
    counts: DataFrame, asked: DataFrame, batch: _Batch, k: int, order: str, radius_mode: str, cell: float
) -> tuple[DataFrame, list[int]]:
    """Candidate cells of every query with their ``depth``, and the depths there are.

    The counts are the leaves of a tree of cells. A large batch starts at coarse cells, so that a
    query never meets all cells of its term. Below the grid only cells with far more matches than results are
    wanted are split, down to the finest counts, so a query does not meet a whole city either.
    Only counts are read for that; points of one finest cell are not told apart.
    """
    few = batch.small and batch.queries <= FEW_QUERIES
    first = 0 if few else -2
    layer = _layer(counts, first)
    near = layer.join(F.broadcast(asked), "term") if few else equi_join(asked, layer, ["term"], salt_on="qid")
    settled, depths = None, []
    for depth in range(first, FINER_LEVELS + 1):
        found = _candidate_cells(near, k, order, radius_mode, cell / COARSER**depth)
        if depth >= 0:
            # Written once: its size is then known before the next pass is planned.
            found = materialize(found, "cells")
            dense = found.where(F.col("n") > DENSE_PER_RESULT * k)
            last = depth == FINER_LEVELS or dense.isEmpty()
            here = (found if last else found.where(F.col("n") <= DENSE_PER_RESULT * k)).drop("n").withColumn("depth", F.lit(depth))
            settled = here if settled is None else settled.unionByName(here)
            depths.append(depth)
            if last:
                break
            found = dense
        near = _descend(found, counts, depth + 1)
    return settled, depths


def _nested_cell(points: DataFrame, cell: float, depth: int) -> DataFrame:
    """Cells of ``cell / COARSER**depth`` degrees; those of all depths nest exactly."""
    return points.withColumns(_nested(cell, depth))


def _nested(cell: float, depth: int) -> dict[str, Column]:
    finest, ratio = cell / COARSER**FINER_LEVELS, COARSER ** (FINER_LEVELS - depth)
    return {c: F.floor(F.floor(F.col(place) / F.lit(finest)) / ratio) for c, place in (("cy", "lat"), ("cx", "lon"))}


def _settled_pairs(terms: DataFrame, found: DataFrame, depths: list[int], cell: float) -> DataFrame:
    """Candidate (query, point) pairs: one read of the points, each matched at every depth in use."""
    if depths == [0]:
        return equi_join(_nested_cell(terms, cell, 0), found.drop("depth"), ["term", "cy", "cx"]).drop("cy", "cx")
    places = F.array(*[
        F.struct(F.lit(d).alias("depth"), *[c.alias(n) for n, c in _nested(cell, d).items()]) for d in depths])
    here = terms.withColumn("_at", F.explode(places)).select(*terms.columns, "_at.*")
    return equi_join(here, found, ["term", "depth", "cy", "cx"]).drop("depth", "cy", "cx")


def keyword_search(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    order: str = "geodesic",
    radius_mode: str = "degrees",
    cell: float = DEFAULT_CELL_DEG,
) -> DataFrame:
    """The ``k`` nearest points that carry a tag, per query.

    ``queries``: qid, lat, lon, tag_key, tag_value (NULL: key existence) and radius_deg
    (NULL: none). ``order`` ranks by ``geodesic`` metres or ``planar`` degrees; the
    distance returned is always geodesic. With ``radius_mode="metres"`` the radius is
    applied to the geodesic distance.

    Two passes over the points: counts per term and cell bound the k-th distance of
    each query, then only cells within the bound are read as candidates, smaller ones
    where places are dense.
    """
    asked = asked_terms(queries)
    batch = _inspect(asked)
    terms = _terms_of(points.select("id", "lat", "lon", "tags"), asked, batch)
    return search_terms(terms, asked, batch, k, order, radius_mode, cell)


def asked_terms(queries: DataFrame) -> DataFrame:
    """Keyword queries as the search wants them, each with its term."""
    return query_terms(queries).select(
        "qid", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"),
        "tag_key", "tag_value", "term", F.col("radius_deg").cast("double").alias("radius_deg"),
    )


def search_terms(
    terms: DataFrame, asked: DataFrame, batch: _Batch, k: int, order: str = "geodesic",
    radius_mode: str = "degrees", cell: float = DEFAULT_CELL_DEG,
) -> DataFrame:
    """The keyword search over ``terms(term, id, lat, lon, ...)``, a row per point and term; further
    columns are returned with the results."""
    payload = [c for c in terms.columns if c not in ("term", "id", "lat", "lon")]
    counts = _nested_cell(terms, cell, FINER_LEVELS).groupBy("term", "cy", "cx").agg(F.count("*").alias("n"))
    counts = materialize(counts, "cell-counts")
    found, depths = _search_cells(counts, asked.drop("tag_key", "tag_value"), batch, k, order, radius_mode, cell)
    pairs = _settled_pairs(terms, found, depths, cell).drop("term")
    planar_radius = radius_mode == "degrees"
    if planar_radius:
        pairs = pairs.where(
            F.col("radius_deg").isNull()
            | within_degrees("lat", "lon", "qlat", "qlon", F.col("radius_deg"))
        )
    if order == "planar":
        pairs = pairs.withColumn("planar", planar_distance("lat", "lon", "qlat", "qlon"))
        if not planar_radius:
            pairs = _within_metres(with_geodesic(pairs, "lat", "lon", "qlat", "qlon"))
        best = _rank(pairs, k, "planar", "id")
        best = with_geodesic(best, "lat", "lon", "qlat", "qlon")
    else:
        pairs = with_geodesic(pairs, "lat", "lon", "qlat", "qlon")
        if not planar_radius:
            pairs = _within_metres(pairs)
        best = _rank(pairs.withColumn("distance", F.round("distance", DISTANCE_DECIMALS)), k, "distance", "id")
    return best.select("qid", "rank", "id", *payload, F.round("distance", DISTANCE_DECIMALS).alias("distance"))


def _within_metres(pairs: DataFrame) -> DataFrame:
    metres = F.col("radius_deg") * METRES_PER_DEGREE
    return pairs.where(metres.isNull() | (F.col("distance") <= metres))


def semantic_search(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", **options) -> DataFrame:
    """Top-k by cosine similarity with an optional planar radius per query."""
    return vector_topk(points, queries, k, parts=(vector,), **options)


def fused_search(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", **options) -> DataFrame:
    """Top-k by cosine similarity of fused vectors; a radius is never applied."""
    return vector_topk(points, queries.drop("radius_deg"), k, parts=(vector,), **options)


def concat_search(points: DataFrame, queries: DataFrame, k: int, lam: int = 2, **options) -> DataFrame:
    """Concatenation search from the stored spatial and semantic parts, unfused."""
    found = vector_topk(
        points, queries.drop("radius_deg"), k, parts=("spatial", "embedding"),
        settings={str(lam): concat_setting(lam)}, **options,
    )
    return found.drop("setting")


def nearest_point(points: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """Most similar point per query, lowest id on ties, with its coordinates."""
    found = vector_topk(
        points, queries, 1, parts=(vector,), payload=("lat", "lon"), ranked_by_distance=False
    )
    return found.select("qid", "id", "lat", "lon", "similarity")


def multi_k(ranked: DataFrame, ks=(1, 5, 10, 20, 50)) -> DataFrame:
    """Results for several k from one ranking at the largest k."""
    return ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))


def parse_bench_query(text) -> tuple[Column, Column, Column]:
    """Text, latitude and longitude of ``text|lat|lon``; blank text becomes ``poi``."""
    from ..constants import EMPTY_TEXT
    from ..functions.text import strip

    cells = F.split(text, r"\|")
    words = F.when(strip(cells[0]) != "", cells[0]).otherwise(F.lit(EMPTY_TEXT))
    return words, cells[1].try_cast("double"), cells[2].try_cast("double")
