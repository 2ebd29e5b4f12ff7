"""Searches against brute force, with hot keys, equal places and every join route."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolantern.functions import geo
from geolantern.functions.geo import geodesic_numpy
from geolantern.operators import ann, grid, search, topk
from geolantern.plans import metrics
from geolantern.functions import vectors

rng = np.random.default_rng(3)
N = 600
DEG = 0.05


def make_points():
    rows = []
    for i in range(N):
        # A third of the points share one place and one tag.
        if i % 3 == 0:
            lat, lon, tags = -37.8, 144.9, {"amenity": "cafe"}
        else:
            lat, lon = float(-38 + rng.random()), float(144.5 + rng.random())
            tags = {"amenity": "bar"} if i % 2 else {"shop": "books", "name": f"n{i % 7}"}
        rows.append((i, lat, lon, tags))
    return rows


POINTS = make_points()
QUERIES = [
    (0, -37.8, 144.9, "amenity", "cafe", None), (1, -37.8, 144.9, "amenity", "cafe", DEG),
    (2, -37.5, 145.0, "shop", None, None), (3, -37.5, 145.0, "shop", None, 0.2),
    (4, -37.6, 144.7, "name", "n3", 0.3), (5, -37.2, 145.4, "amenity", "bar", None),
    (6, -37.2, 145.4, "amenity", "none", None), (7, -37.9, 145.1, "amenity", None, 0.1),
]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, lat double, lon double, tags map<string,string>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        QUERIES, "qid long, lat double, lon double, tag_key string, tag_value string, radius_deg double"
    )


def metres(a, b, c, d):
    return float(geodesic_numpy(*[np.array([x], dtype=float) for x in (a, b, c, d)])[0])


def brute(k, order, mode="degrees"):
    out = {}
    for qid, qlat, qlon, key, value, radius in QUERIES:
        found = []
        for i, lat, lon, tags in POINTS:
            if key not in tags or (value is not None and tags[key] != value):
                continue
            planar = math.sqrt((lon - qlon) ** 2 + (lat - qlat) ** 2)
            far = metres(lat, lon, qlat, qlon)
            if radius is not None:
                if (planar > radius) if mode == "degrees" else (far > radius * 111_320):
                    continue
            found.append((planar if order == "planar" else round(far, 6), i))
        out[qid] = [i for _, i in sorted(found)[:k]]
    return out


def got(df):
    out = {q[0]: [] for q in QUERIES}
    for row in df.orderBy("qid", "rank").collect():
        out[row["qid"]].append(row["id"])
    return out


@pytest.mark.parametrize("mode", ["degrees", "metres"])
@pytest.mark.parametrize("order", ["geodesic", "planar"])
@pytest.mark.parametrize("k", [1, 12])
def test_keyword_search(points, queries, k, order, mode):
    assert got(search.keyword_search(points, queries, k, order, mode)) == brute(k, order, mode)


def test_keyword_search_without_broadcast(points, queries, monkeypatch):
    """The salted route and the coarse-to-fine cells of a large batch."""
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(grid, "is_small", lambda df, *a: False)
    assert got(search.keyword_search(points, queries, 12, cell=0.01)) == brute(12, "geodesic")


def test_keyword_search_coarse_levels_with_broadcast(points, queries, monkeypatch):
    monkeypatch.setattr(search, "FEW_QUERIES", 0)
    assert got(search.keyword_search(points, queries, 5, "planar", cell=0.01)) == brute(5, "planar")


@pytest.mark.parametrize(("dense", "order", "mode"), [(0, "geodesic", "degrees"), (0, "planar", "metres"), (2, "geodesic", "metres")])
def test_keyword_search_refines_dense_cells(points, queries, monkeypatch, dense, order, mode):
    monkeypatch.setattr(search, "DENSE_PER_RESULT", dense)
    assert got(search.keyword_search(points, queries, 12, order, mode, cell=0.5)) == brute(12, order, mode)


def test_radius_join_routes_agree(points, queries, monkeypatch):
    expected = {
        (q[0], p[0]) for q in QUERIES if q[5] for p in POINTS
        if math.sqrt((p[2] - q[2]) ** 2 + (p[1] - q[1]) ** 2) <= q[5]
    }
    assert {(r.qid, r.id) for r in grid.radius_join(points, queries).collect()} == expected
    monkeypatch.setattr(grid, "is_small", lambda df, *a: False)
    assert {(r.qid, r.id) for r in grid.radius_join(points, queries, 0.03).collect()} == expected


def test_keyword_join_routes_agree(points, queries, monkeypatch):
    first = {(r.qid, r.id) for r in search.keyword_join(points, queries).collect()}
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    assert {(r.qid, r.id) for r in search.keyword_join(points, queries).collect()} == first


def test_fixed_distances(spark):
    rows = [
        (-37.95103341666667, 144.42486788888889, -37.65282113888889, 143.92649552777777),
        (-37.8, 144.9, -37.8, 144.9), (-37.8, 144.9, -37.8, 144.91),
    ]
    df = geo.with_geodesic(spark.createDataFrame(rows, "a double, b double, c double, d double"), "a", "b", "c", "d")
    df = df.withColumn("h", geo.haversine("a", "b", "c", "d"))
    out = df.collect()
    assert [round(r.distance, 3) for r in out] == [54972.271, 0.0, 880.705]
    assert [round(r.h, 4) for r in out] == [54925.5075, 0.0, 878.6135]
    assert geo.metres_to_degrees(10_000) == 0.08983111749910169
    assert geo.metres_to_degrees(0) is None


# --- vectors --------------------------------------------------------------------------

DIM = 8
VECS = rng.normal(size=(N, DIM)).astype("float32")
VECS[::3] = VECS[0]  # a third of the vectors are equal
VECS[5] = 0


@pytest.fixture(scope="module")
def vector_points(spark, points):
    rows = [(i, VECS[i].tolist()) for i in range(N)] + [(N, None), (N + 1, [1.0])]
    vecs = spark.createDataFrame(rows, "id long, embedding array<float>")
    extra = [(N, -37.8, 144.9, {}), (N + 1, -37.8, 144.9, {})]
    more = spark.createDataFrame(extra, points.schema)
    return points.unionByName(more).join(vecs, "id").repartition(6)


@pytest.fixture(scope="module")
def vector_queries(spark):
    rows = [(q[0], q[1], q[2], q[5], VECS[q[0] * 3].tolist() if q[0] % 2 else rng.normal(size=DIM).tolist()) for q in QUERIES]
    return spark.createDataFrame(rows, "qid long, lat double, lon double, radius_deg double, embedding array<double>")


def vector_brute(asked, k):
    out = {}
    for qid, qlat, qlon, radius, vec in asked:
        vec, found = np.asarray(vec), []
        for i, lat, lon, _ in POINTS:
            if radius is not None and math.sqrt((lon - qlon) ** 2 + (lat - qlat) ** 2) > radius:
                continue
            v = VECS[i].astype("float64")
            scale = np.linalg.norm(v) * np.linalg.norm(vec)
            sim = round(float(v @ vec / scale), 9) if scale else 0.0
            found.append((-sim, round(metres(lat, lon, qlat, qlon), 6), i))
        out[qid] = [f[2] for f in sorted(found)[:k]]
    return out


def test_vector_topk(vector_points, vector_queries):
    asked = [tuple(r) for r in vector_queries.collect()]
    assert got(topk.vector_topk(vector_points, vector_queries, 15)) == vector_brute(asked, 15)


def test_vector_topk_blocks(vector_points, vector_queries):
    asked = [tuple(r) for r in vector_queries.collect()]
    found = topk.vector_topk(vector_points, vector_queries, 7, block_queries=3)
    assert got(found) == vector_brute(asked, 7)


def test_vector_topk_small_batches_compact(vector_points, vector_queries, spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    asked = [tuple(r) for r in vector_queries.collect()]
    try:
        assert got(topk.vector_topk(vector_points, vector_queries, 4)) == vector_brute(asked, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")


def test_more_k_than_points(vector_points, vector_queries):
    found = topk.vector_topk(vector_points, vector_queries.where("radius_deg is null"), 10_000)
    assert found.groupBy("qid").count().select("count").distinct().collect()[0][0] == N


def test_settings_equal_fused_vectors(vector_points, vector_queries):
    """Scores from parts equal scores of fused vectors, for both kinds of fusion."""
    other = F.transform("embedding", lambda x, i: F.sin(x.cast("double") * 3 + i))
    pts = vector_points.where(F.size("embedding") == DIM).withColumn("b", vectors.l2_normalize(other)).withColumn(
        "a", vectors.l2_normalize("embedding")
    )
    ask = vector_queries.withColumn("b", vectors.l2_normalize(other)).withColumn("a", vectors.l2_normalize("embedding"))
    for setting, fuse in (
        (topk.weighted_setting(1.0, 0.25), vectors.weighted_fuse("a", "b", 1.0, 0.25)),
        (topk.concat_setting(3), vectors.concat_fuse("a", "b", 3)),
    ):
        parts = topk.vector_topk(pts, ask, 9, ("a", "b"), {"x": setting}).drop("setting")
        fused = topk.vector_topk(pts.withColumn("f", fuse), ask.withColumn("f", fuse), 9, ("f",))
        left = {(r.qid, r["rank"]): (r.id, round(r.similarity, 7)) for r in parts.collect()}
        right = {(r.qid, r["rank"]): (r.id, round(r.similarity, 7)) for r in fused.collect()}
        assert left == right


def test_multi_k_is_a_prefix(points, queries):
    found = search.keyword_search(points, queries, 10)
    many = search.multi_k(found, (1, 5, 10)).collect()
    for k in (1, 5, 10):
        assert {(r.qid, r.id) for r in many if r.k == k} == {(r.qid, r.id) for r in found.where(F.col("rank") <= k).collect()}


def test_inverted_lists(vector_points, vector_queries, spark, tmp_path):
    model = ann.train_ivf(vector_points.where(F.size("embedding") == DIM), 8)
    table = ann.ivf_table(vector_points.where(F.size("embedding") == DIM), model)
    ann.write_ivf(table, str(tmp_path / "ivf"))
    stored = spark.read.schema(table.schema).parquet(str(tmp_path / "ivf"))
    exact = topk.vector_topk(vector_points, vector_queries, 10)
    assert got(ann.ivf_search(stored, vector_queries, 10, model, nprobe=8)) == got(exact)
    part = ann.ivf_search(stored, vector_queries, 10, model, nprobe=4)
    recall = metrics.recall_at_k(part, exact, 10).first()[0]
    assert 0.4 <= recall <= 1.0


def test_ivf_fits_a_bounded_sample(spark, tmp_path, monkeypatch):
    """Centroids come from a bounded sample; every row is indexed, and all lists probed are the exact search."""
    rng = np.random.default_rng(6)
    rows = [(i, 0.0, 0.0, rng.normal(size=4).tolist()) for i in range(2000)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, embedding array<double>")
    seen, real = [], ann.KMeans.fit
    monkeypatch.setattr(ann.KMeans, "fit", lambda self, df: seen.append(df.count()) or real(self, df))
    monkeypatch.setattr(ann, "FIT_PER_LIST", 50, raising=False)
    model = ann.train_ivf(points, 4)
    assert 100 < seen[0] < 400
    table = ann.ivf_table(points, model)
    ann.write_ivf(table, str(tmp_path / "ivf"))
    stored = spark.read.schema(table.schema).parquet(str(tmp_path / "ivf"))
    assert stored.count() == 2000
    asked = points.where("id % 50 = 0").withColumnRenamed("id", "qid")

    def found(df):
        return {(r["qid"], r["rank"], r["id"]) for r in df.collect()}

    exact = found(topk.vector_topk(points, asked, 10, payload=()))
    assert found(ann.ivf_search(stored, asked, 10, model, nprobe=4, payload=())) == exact



def test_hyperplane_buckets(vector_points, vector_queries):
    exact = topk.vector_topk(vector_points, vector_queries, 10)
    found = ann.lsh_search(vector_points, vector_queries, 10, ann.hyperplanes(DIM, 12, 3))
    assert metrics.recall_at_k(found, exact, 10).first()[0] > 0.7


def test_metrics(vector_points, vector_queries):
    exact = topk.vector_topk(vector_points, vector_queries, 10, payload=("embedding",))
    assert metrics.recall_at_k(exact, exact, 10).first()[0] == 1.0
    series = {r.qid: r.coherence for r in metrics.coherence_series(exact, "embedding").collect()}
    for qid, value in series.items():
        rows = np.array([r.embedding for r in exact.where(F.col("qid") == qid).collect()], dtype="float64")
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm != 0)
        assert abs(value - float((rows @ rows.T).mean())) < 1e-9


# --- vectors that cannot be searched -------------------------------------------------

DIRTY = "id long, lat double, lon double, tags map<string,string>, embedding array<double>"


def _dirty_points(spark):
    good = [(i, 0.0, 0.001 * i, {"a": "b"}, [1.0, 0.1 * i]) for i in range(12)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, 0.0, 0.0, None, [nan, 1.0]), (101, 0.0, 0.0, None, [inf, 1.0]), (102, 0.0, 0.0, None, None),
           (103, 0.0, 0.0, None, [1.0]), (104, 0.0, 0.0, None, [None, 1.0])]
    return spark.createDataFrame(good + bad, DIRTY)


def _asked(spark, vectors):
    return spark.createDataFrame([(i, 0.0, 0.0, v) for i, v in enumerate(vectors)],
                                 "qid long, lat double, lon double, embedding array<double>")


@pytest.mark.parametrize("block", [100, 2])
def test_bad_point_vectors_cost_no_other_row(spark, block):
    asked = _asked(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    found = topk.vector_topk(_dirty_points(spark), asked, 5, block_queries=block).collect()
    assert len(found) == 15 and {r["id"] for r in found} <= set(range(12))
    assert [r["id"] for r in sorted(found, key=lambda r: (r["qid"], r["rank"]))][:5] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("block", [100, 2])
@pytest.mark.parametrize("last", [None, [1.0], [float("nan"), 1.0], [1.0, None]])
def test_bad_query_vectors_are_refused(spark, block, last):
    asked = _asked(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], last])
    with pytest.raises(ValueError, match="query vectors"):
        topk.vector_topk(_dirty_points(spark), asked, 5, block_queries=block)


@pytest.mark.parametrize("queries", [4096, 1])
def test_groups_score_only_pairs_that_share_one(spark, queries):
    mine = _dirty_points(spark).where("id < 12").withColumn("g", F.array(F.col("id") % 3, F.col("id") % 2 + 10))
    asked = _asked(spark, [[1.0, 0.0], [0.0, 1.0]]).withColumn("g", F.array(F.col("qid"), F.lit(10)))
    found = topk.vector_topk(mine, asked, 20, groups="g", block_queries=queries).collect()
    want = {(q, i) for q in range(2) for i in range(12) if i % 3 == q or i % 2 == 0}
    assert sorted((r["qid"], r["id"]) for r in found) == sorted(want)


@pytest.fixture(scope="module")
def many_points(spark):
    local = np.random.default_rng(12)
    rows = [(i, 0.0, float(i) / 1e4, {}, v) for i, v in enumerate(local.normal(size=(6000, 6)).tolist())]
    return spark.createDataFrame(rows, DIRTY).repartition(64)


def test_floors_keep_most_rows_out_of_the_ranking(spark, many_points):
    asked = _asked(spark, np.random.default_rng(13).normal(size=(20, 6)).tolist())
    plain = topk.vector_candidates(many_points, asked, 10, floors=False)
    bounded = topk.vector_candidates(many_points, asked, 10, floors=True)
    # Every split sends k rows a query without floors. The 4 splits of the first pass leave about 16 k.
    assert plain.count() == 64 * 20 * 10 and bounded.count() < 64 * 20 * 10 / 2.5
    first, second = (
        sorted((r["qid"], r["rank"], r["id"]) for r in topk.vector_topk(many_points, asked, 10, floors=f).collect())
        for f in (False, True))
    assert first == second


def test_floors_with_radius_groups_and_few_matches(spark, many_points):
    asked = _asked(spark, np.random.default_rng(14).normal(size=(6, 6)).tolist()).withColumns({
        "radius_deg": F.when(F.col("qid") % 2 == 0, 0.001), "g": F.array(F.col("qid") % 3)})
    mine = many_points.withColumn("g", F.array(F.col("id") % 3, F.col("id") % 5))
    for how in ({}, {"groups": "g"}, {"block_queries": 2}):
        first, second = (
            sorted((r["qid"], r["rank"], r["id"]) for r in topk.vector_topk(mine, asked, 30, floors=f, **how).collect())
            for f in (False, True))
        assert first == second


def test_blocks_do_not_exchange_points(spark, many_points, tmp_path, capsys):
    many_points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    asked = _asked(spark, np.random.default_rng(15).normal(size=(40, 6)).tolist())
    found = topk.vector_candidates(points, asked, 3, block_queries=4, floors=False)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    got_rows = sorted((r["qid"], r["rank"], r["id"]) for r in topk.vector_topk(points, asked, 3, block_queries=4).collect())
    assert got_rows == sorted((r["qid"], r["rank"], r["id"]) for r in topk.vector_topk(points, asked, 3).collect())
