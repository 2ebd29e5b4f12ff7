"""Stored access tables: equal to the plain search, and only the files in reach are read."""

import math

import pytest
from pyspark.sql import functions as F

from geolantern.operators import grid, search, stored

N = 4000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    points = spark.range(N).select(
        "id", (-39 + 2.0 * F.rand(1)).alias("lat"), (143 + 3.0 * F.rand(2)).alias("lon"),
        F.create_map(F.lit("amenity"), F.concat(F.lit("a"), (F.col("id") % 5).cast("string"))).alias("tags"))
    points.write.parquet(f"{folder}/points")
    points = spark.read.parquet(f"{folder}/points")
    stored.write_places(points, f"{folder}/places", 24)
    stored.write_postings(points, f"{folder}/postings", 24)
    return points, f"{folder}/places", f"{folder}/postings"


def queries(spark, radius):
    rows = [(i, -38.5 + i / 100, 144.5 + i / 100, "amenity", f"a{i % 3}" if i % 4 else None, radius) for i in range(6)]
    return spark.createDataFrame(rows, "qid long, lat double, lon double, tag_key string, tag_value string, radius_deg double")


def rows(found):
    return sorted((r["qid"], r["rank"], r["id"], tuple(r["tags"].items()), round(r["distance"], 6)) for r in found.collect())


@pytest.mark.parametrize("radius", [None, 0.05, 0.0, 40.0])
def test_equals_the_plain_search(spark, tables, radius):
    points, places, terms = tables
    asked = queries(spark, radius)
    plain = rows(search.keyword_search(points, asked, 7))
    assert rows(search.keyword_search(stored.places_near(spark, places, asked), asked, 7)) == plain
    for near in (True, False):
        assert rows(stored.keyword_search(spark, terms, places, asked, 7, near)) == plain


def test_large_batches_read_the_whole_tables(spark, tables, monkeypatch):
    points, places, terms = tables
    asked = queries(spark, 0.05)
    plain = rows(search.keyword_search(points, asked, 3))
    monkeypatch.setattr(stored, "FEW_QUERIES", 2)
    assert rows(search.keyword_search(stored.places_near(spark, places, asked), asked, 3)) == plain
    assert rows(stored.keyword_search(spark, terms, places, asked, 3)) == plain


def test_files_read(spark, tables):
    _, places, terms = tables
    near, far = queries(spark, 0.05), queries(spark, None)
    assert len(stored.places_near(spark, places, far).inputFiles()) == 24
    assert len(stored.places_near(spark, places, near).inputFiles()) <= 6
    # The term of a key that all points have fills half of the postings' files.
    one = near.where("tag_value IS NULL").limit(1)
    by_term = stored.postings_of(spark, terms, one, near=False).inputFiles()
    both = stored.postings_of(spark, terms, one).inputFiles()
    assert len(both) <= 4 < 10 <= len(by_term) <= 14 and set(both) < set(by_term)
    nowhere = near.withColumn("lat", F.lit(10.0))
    assert stored.places_near(spark, places, nowhere).count() == 0


def test_ranges_hold_every_point_of_a_circle(spark):
    places = [(-90.0, -180.0, 0.3), (90.0, 180.0, 0.3), (0.0, 0.0, 0.0), (-37.8, 144.9, 0.018), (45.0, 90.0, 0.0001), (10.0, 10.0, 200.0)]
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "qid long, lat double, lon double, radius_deg double")
    ranges = stored.circle_ranges(asked)
    assert ranges.groupBy("qid").count().agg(F.max("count")).first()[0] <= 4
    angle = [(math.cos(t / 10), math.sin(t / 10)) for t in range(63)] + [(0.0, 0.0)]
    points = [(i, lat + r * a, lon + r * b) for i, (lat, lon, r) in enumerate(places) for a, b in angle]
    points = spark.createDataFrame(points, "q long, lat double, lon double").withColumn("place", stored.place_key())
    met = points.join(ranges, (F.col("q") == F.col("qid")) & F.col("place").between(F.col("low"), F.col("high")), "left_anti")
    assert met.count() == 0


def test_radius_classes_meet_few_candidates(spark, tables, monkeypatch):
    points, _, _ = tables
    radii = [0.018, 0.45]
    asked = spark.createDataFrame(
        [(i, -38.5 + i / 1000, 144.5, radii[i % 2]) for i in range(60)], "qid long, lat double, lon double, radius_deg double")
    met = []
    plain = grid.equi_join
    monkeypatch.setattr(grid, "equi_join", lambda *a, **k: met.append(plain(*a, **k)) or met[-1])
    found = {(r["qid"], r["id"]) for r in grid.radius_join(points, asked).collect()}
    # By cells as wide as the largest radius a small circle would meet some 9 * 0.5 ** 2 square degrees.
    small = met[0].where("radius_deg < 0.1").count()
    assert small < 30 * N * 9 * 0.032 ** 2 / 6 * 2
    one = {(r["qid"], r["id"]) for r in grid.radius_join(points, asked, 0.45).collect()}
    assert found == one and len(found) > 1000
