"""Sources, tags, texts, encoders, training and profiles on small fixtures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolantern import session
from geolantern.constants import METHOD_FAMILY, PREPOSITIONS
from geolantern.functions import geo, tags, text, vectors
from geolantern.operators import encode, sampling, train
from geolantern.plans import compare, metrics, profile
from geolantern.sources import embeddings, osm, pois, queries, workloads


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        '<?xml version="1.0"?><osm><node id="1" lat="1.5" lon="2.5"><tag k="a" v="x"/><tag k="b" v="y &amp; z"/><tag k="a" v="w"/></node>'
        '<node id="2" lat="1" lon="2"/><way id="3"><tag k="a" v="x"/></way><node id="4" lat="0" lon="0"><tag k="c" v="d"/></node></osm>'
    )
    rows = osm.read_osm(spark, str(tmp_path / "a.osm")).orderBy("id").collect()
    assert [(r.id, r.lat, r.lon, r.tags) for r in rows] == [
        (1, 1.5, 2.5, {"a": "w", "b": "y & z"}), (4, 0.0, 0.0, {"c": "d"})
    ]



OSM_NODES = """<?xml version='1.0' encoding='UTF-8'?>
<osm version="0.6">
<bounds minlat="0" maxlat="1"/>
<node id="1" lat="0.5" lon="1.5"/>
<node id="2" lat="0.5" lon="-1.5" user="a &gt; b />"><tag k="name" v="caf&#233; &amp; &lt;b&gt; é😀"/>
  <tag k='amenity' v='"x"'/> </node ><node id="3" lat="1" lon="2"></node>
<node id="4" lat="2" lon="3"><!-- kept --><tag k="a" v=""/></node>%s
<node id="8" lat="2" lon="3"/><way id="5"><nd ref="4"/><tag k="highway" v="node"/></way>
<relation id="6"><member type="node" ref="4" role=""/><tag k="type" v="x"/></relation></osm>"""


@pytest.mark.parametrize("most", [17, 64, 300, 100_000])
def test_osm_file_is_split(spark, tmp_path, most):
    """Wherever the splits fall, every tagged node is found once."""
    more = "".join(f'<node id="{i}" lat="1" lon="2"><tag k="n" v="{i}"/></node>\n' for i in range(100, 140))
    (tmp_path / "a.osm").write_text(OSM_NODES % more, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        read = osm.read_osm(spark, str(tmp_path / "a.osm"))
        tasks = read.rdd.getNumPartitions()
        got = {r["id"]: (r["lat"], r["lon"], r["tags"]) for r in read.collect()}
        assert read.count() == len(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {2: (0.5, -1.5, {"name": "café & <b> é😀", "amenity": '"x"'}), 4: (2.0, 3.0, {"a": ""})}
    assert got == want | {i: (1.0, 2.0, {"n": str(i)}) for i in range(100, 140)}
    assert tasks > 1 or most == 100_000


def test_osm_tags_that_are_not_empty_elements(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1" lon="2"><tag k="a" v="b"></tag><tag k="c" v="d"></tag></node></osm>')
    with pytest.raises(Exception, match="empty elements"):
        osm.read_osm(spark, str(tmp_path / "a.osm")).collect()


def test_tag_parsing(spark):
    raw = ['{"a": "b"}', "{'a': 'x'}", "", None, "[1]", '{"a": ', '{"n": 5}']
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(tags.parse_tags("raw").alias("t"))
    assert [r.t for r in df.collect()] == [{"a": "b"}, {"a": "x"}, {}, {}, {}, {}, {"n": "5"}]


def test_concat_text(spark):
    rows = [('{"a": "b", "c": "d"}', " x "), ("{bad", "x"), (None, None), ("plain", None), ("{}", "  ")]
    df = spark.createDataFrame(rows, "m string, n string").select(tags.concat_text("m", "n").alias("t"))
    assert [r.t for r in df.collect()] == ["a: b; c: d; x", "x", "poi", "plain", "poi"]


def test_prepositions(spark):
    texts = [
        "Art galleries near St Kilda", "Dandenong", "Walk from A in B", "inside story", "éin foo", "in\tx", "Cafe by  ",
        None, "IN Town\nat home", "begin to end",
    ]

    def expected(value):
        value = "" if value is None else value
        for word in PREPOSITIONS:
            hit = re.search(rf"\b{word}\b (.+)", value.lower())
            if hit:
                return hit.group(1).strip()
        return value

    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.after_preposition("t").alias("x"))
    assert [r.x for r in df.collect()] == [expected(t) for t in texts]


def test_query_files(spark, tmp_path):
    two = tmp_path / "two.csv"
    two.write_text("a,1\nb,2\n")
    assert queries.read_queries(spark, str(two)).count() == 0
    three = tmp_path / "three.csv"
    three.write_text("cafe,-37.8,144.9\nbad,x,1\n bar ,1,2,extra\n")
    got = [tuple(r) for r in queries.read_queries(spark, str(three)).orderBy("qid").collect()]
    assert got == [(0, "cafe", -37.8, 144.9), (1, "bar", 1.0, 2.0)]
    mixed = tmp_path / "mixed.txt"
    mixed.write_text("good coffee\ncafe, -37.8, 144.9\n\nbar 1 2\nwhere is it\n")
    found = queries.read_queries(spark, str(mixed), lambda t: t.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)}))
    assert [r.text for r in found.orderBy("qid").collect()] == ["cafe", "bar", "good coffee", "where is it"]
    with pytest.raises(ValueError):
        queries.read_queries(spark, str(mixed))
    assert queries.query_path("data/city_cleaned.csv") == "data/queries/city.csv"


def test_workload_round_trip(spark, tmp_path):
    rows = [
        ("custom", "", 10, 0, -37.8, 144.9, 0.0898, "name", "O'Dowd \"x\" \\ y", None, "geodesic", 10),
        ("custom", "", 10, 1, -37.8, -144.9, None, "Where's it?", None, None, "planar", 10),
        ("custom", "embedded_", 10, 0, -37.8, 144.9, 0.5, None, None, [0.25, -1e-6], "similarity", 10),
        ("dataset", "concat_embedded_", 5, 0, -37.8, 144.9, None, None, None, [1.0], "similarity", 5),
    ]
    schema = (
        "source string, family string, k int, qid long, lat double, lon double, radius_deg double, tag_key string, "
        "tag_value string, qvec array<double>, order_by string, limit int"
    )
    df = spark.createDataFrame(rows, schema)
    workloads.write_statements(df, str(tmp_path / "w" / "exp"))
    back = workloads.load_workload(spark, str(tmp_path / "w"))
    expected = {(r[0], r[1], r[3]): r for r in rows}
    got = back.collect()
    assert len(got) == len(rows)
    for r in got:
        want = expected[r.source, r.family, r.qid]
        assert (r.experiment, r.k, r.lat, r.lon, r.radius_deg, r.tag_key, r.tag_value, r.limit) == (
            "exp", want[2], want[4], want[5], want[6], want[7], want[8], want[11]
        )
        assert (r.qvec is None) == (want[9] is None)
        assert r.order_by == {"geodesic": "distance"}.get(want[10], want[10])
    workloads.write_workload(df, str(tmp_path / "typed"))
    typed = workloads.read_workload(spark, str(tmp_path / "typed"))
    assert typed.where("family = ''").count() == 2 and typed.count() == 4


def test_existing_statement_files(spark, tmp_path):
    folder = tmp_path / "old"
    folder.mkdir()
    point = "ST_SetSRID(ST_MakePoint(144.95, -37.81), 4326)"
    head = f"SELECT id, tags, ST_Distance(geom::geography, {point}::geography) AS distance"
    (folder / "dataset_queries_k10.sql").write_text(
        f"{head} FROM PoIs WHERE ST_DWithin(geom, {point}, 0.0179)   AND tags @> '{{\"amenity\": \"fuel\"}}'::jsonb ORDER BY distance LIMIT 10;\n\n"
        f"{head} FROM PoIs WHERE tags ? 'Where''s food?'  ORDER BY geom <-> {point} LIMIT 5;\n"
    )
    rows = workloads.load_workload(spark, str(tmp_path)).orderBy("qid").collect()
    assert [(r.qid, r.lon, r.lat, r.radius_deg, r.tag_key, r.tag_value, r.order_by, r.limit) for r in rows] == [
        (0, 144.95, -37.81, 0.0179, "amenity", "fuel", "distance", 10),
        (1, 144.95, -37.81, None, "Where's food?", None, "planar", 5),
    ]


def test_tables(spark):
    first = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, lat double")
    assert pois.create_table(first, "points_t").count() == 2
    more = spark.createDataFrame([(2, 9.0, 1), (3, 3.0, 2), (3, 4.0, 1)], "id long, lat double, seq int")
    pois.append_table(more, "points_t", "seq")
    assert sorted(tuple(r) for r in spark.table("points_t").collect()) == [(1, 1.0), (2, 2.0), (3, 4.0)]
    bad = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    with pytest.raises(ValueError):
        pois.check_vectors(bad, 2)


def test_incremental_embed(spark, tmp_path):
    points = spark.createDataFrame([(i, {"a": str(i)}) for i in range(10)], "id long, tags map<string,string>")
    path = str(tmp_path / "e")

    def run(todo):
        return encode.semantic_embed(todo, encode.HashingEncoder(16))

    assert embeddings.incremental_embed(points.where("id < 4"), path, run) == 4
    assert embeddings.incremental_embed(points, path, run) == 6
    assert embeddings.incremental_embed(points, path, run) == 0
    assert embeddings.is_complete(points, embeddings.read_embeddings(spark, path))


def test_encoders(spark):
    df = spark.createDataFrame([(0, "Cafe  cafe, BAR"), (1, " "), (2, None), (3, "poi")], "id long, t string")
    rows = {r.id: np.array(r.embedding) for r in encode.HashingEncoder(32)(df, "t").collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in rows.values())
    assert np.allclose(rows[1], rows[3]) and np.allclose(rows[2], rows[3])

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    plug = encode.ModelEncoder(load, batch_size=2)
    assert {r.id: r.embedding for r in plug(df, "t").collect()}[0] == [15.0, 1.0]
    weights = encode.Projection.initial(32, 8, 16)
    pts = df.withColumns({"lat": F.col("id") - 37.5, "lon": F.col("id") + 144.0})
    for r in encode.encode_pair(pts, weights, "t", encode.HashingEncoder(32)).collect():
        zt = weights.text_w @ rows[r.id] + weights.text_b
        assert np.allclose(r.zt, zt / np.linalg.norm(zt), atol=1e-6)
        lon, lat = np.radians(r.lon), np.radians(r.lat)
        bands = np.array(weights.bands)
        feats = np.concatenate([np.sin(lon * bands), np.cos(lon * bands), np.sin(lat * bands), np.cos(lat * bands)])
        zl = weights.loc_w2 @ np.maximum(weights.loc_w1 @ feats + weights.loc_b1, 0) + weights.loc_b2
        assert np.allclose(r.zl, zl / np.linalg.norm(zl), atol=1e-6)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(
        vectors.l2_normalize("a").alias("u"), vectors.l2_normalize("z").alias("zero"),
        vectors.cosine_similarity("a", "z").alias("c"), vectors.l2_normalize("a", 10.0).alias("clamped"),
    ).first()
    assert (row.u, row.zero, row.c, row.clamped) == ([0.6, 0.8], [0.0, 0.0], 0.0, [0.3, 0.4])


def test_gradients():
    rng = np.random.default_rng(0)
    weights = encode.Projection.initial(6, 4, 5)
    params = {n: np.atleast_1d(np.asarray(getattr(weights, n), dtype=float)) for n in train._PARAMS}
    x, f = rng.normal(size=(7, 6)), rng.normal(size=(7, 16))
    _, grads = train.batch_step(params, x, f)
    for name, grad in grads.items():
        index = tuple(0 for _ in grad.shape)
        step = 1e-6
        before = params[name][index]
        params[name][index] = before + step
        up = train.batch_step(params, x, f)[0]
        params[name][index] = before - step
        down = train.batch_step(params, x, f)[0]
        params[name][index] = before
        assert abs((up - down) / (2 * step) - grad[index]) < 1e-5, name


def test_training(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        lat, lon = float(rng.uniform(-40, 40)), float(rng.uniform(-170, 170))
        rows.append((i, lat, lon, [float(v) for v in (np.sin(lat / 20), np.cos(lon / 60), np.sin(lon / 60), 1.0)]))
    pairs = spark.createDataFrame(rows, "id long, lat double, lon double, vector array<double>")
    start = encode.Projection.initial(4, 8, 16)
    for workers in (1, 4):
        weights, history = train.train(pairs, start, epochs=4, batch_size=32, lr=5e-3, workers=workers)
        losses = [h[1] for h in history]
        assert losses[-1] < losses[0] - 0.1
        assert weights.text_w.shape == (8, 4)


def _training_pairs(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.uniform(-40, 40)), float(rng.uniform(-170, 170)), rng.normal(size=4).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, lat double, lon double, vector array<double>")


def test_training_step_is_one_job(spark):
    """Rows are dealt out once for many steps: a step is one job, not a shuffle of its own."""
    context = spark.sparkContext
    context.setJobGroup("steps", "training")
    try:
        train.train(_training_pairs(spark, 640), encode.Projection.initial(4, 6, 8), epochs=2, batch_size=16, lr=5e-3, workers=2)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 40 <= len(context.statusTracker().getJobIdsForGroup("steps")) < 60


def test_training_step_as_step_gradient(spark):
    """One step of training equals the mean gradient of the same batches and one update."""
    pairs, start = _training_pairs(spark, 60), encode.Projection.initial(4, 6, 8)
    weights, history = train.train(pairs, start, epochs=1, batch_size=16, lr=5e-3, workers=3)
    batch = F.pmod(F.xxhash64(F.lit(1), F.lit(1), "id"), F.lit(3)).alias("batch_id")
    rows = pairs.select(batch, "id", "vector", geo.sinusoidal_features("lat", "lon", start.bands).alias("features"))
    params = train.parameters(start)
    loss, grads, _ = train.step_gradient(rows, params)
    train.adamw(params, *[{k: np.zeros_like(v) for k, v in params.items()} for _ in range(2)], grads, 1, 5e-3, 0.01)
    assert abs(history[0][1] - loss) < 1e-9
    assert np.abs(weights.text_w - params["text_w"]).max() < 1e-9


def test_training_pieces_hold_every_row_once(spark, monkeypatch):
    """Chunks and pieces of a step hold the rows of its bucket with their batches, in order of id, values unchanged."""
    monkeypatch.setattr(train, "CHUNK_BYTES", 300)
    rng = np.random.default_rng(9)
    ids = [*range(60), None, 7, 7]
    rows = [(i, *rng.uniform(-80, 80, 2).tolist(), rng.normal(size=3).tolist()) for i in ids]
    for kind in ("float", "double"):
        pairs = spark.createDataFrame(rows, f"id long, lat double, lon double, vector array<{kind}>")
        layout = train._layout(pairs, 3, 5)
        assert layout == (3, {"float": "float32", "double": "float64"}[kind], "uint8")
        stored = train._store_buckets(pairs, len(rows), 4, 5, 2, 0, layout)
        assert stored.count() > 4
        hashed = pairs.select("*", F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(4)).alias("bucket"),
                              F.pmod(F.xxhash64(F.lit(1), F.lit(2), "id"), F.lit(5)).alias("batch")).collect()
        dealt = train._deal(stored, [2, 0, 3], 2, 2, layout)
        parts = dealt.glom().collect()
        assert len(parts) == 6
        for at, part in enumerate(parts):
            got = []
            for _, (_, n, vector, place, batch) in sorted(part, key=lambda piece: piece[1][0]):
                places, batches = train._unpacked(place, "float64", 2, n), train._unpacked(batch, "uint8", n)
                got += [(*p, *v, b) for p, v, b in zip(
                    places.T.tolist(), train._unpacked(vector, layout[1], n, 3).tolist(), batches.tolist())]
            mine = [r for r in hashed if r.bucket == [2, 0, 3][at // 2] and r.batch % 2 == at % 2]
            want = [((-1 if r.id is None else r.id), (r.lat, r.lon, *r.vector, r.batch)) for r in mine]
            assert sorted(got) == sorted(w for _, w in want)
            place_id = {w[:2]: i for i, w in want}
            assert [place_id[g[:2]] for g in got] == sorted(i for i, _ in want)


def test_training_refuses_vectors_of_other_length(spark):
    for bad in ("array(1D, 2D, 3D)", "CAST(NULL AS array<double>)"):
        pairs = _training_pairs(spark, 40).withColumn("vector", F.when(F.col("id") == 5, F.expr(bad)).otherwise(F.col("vector")))
        with pytest.raises(Exception, match="NULL or has not 4 numbers"):
            train.train(pairs, encode.Projection.initial(4, 6, 8), epochs=1, batch_size=16, workers=2)


def test_features_of_arrays_are_those_of_columns(spark):
    rows = [(90.0, -180.0), (-37.9, 144.7), (0.0, 0.0), (-90.0, 180.0), (None, 3.0)]
    found = spark.createDataFrame(rows, "lat double, lon double").select(geo.sinusoidal_features("lat", "lon", (1.0, 3.0)).alias("f")).collect()
    lat, lon = np.array([[np.nan if v is None else v for v in r] for r in rows]).T
    want = np.array([[np.nan if v is None else v for v in r.f] for r in found])
    assert np.allclose(train.features_of(lat, lon, (1.0, 3.0)), want, atol=1e-14, rtol=0, equal_nan=True)


def test_a_batch_takes_one_exponential_of_its_matrix(monkeypatch):
    """Rows and columns share it, also where the similarities are far apart; the loss is that of the plain form."""
    rng, weights = np.random.default_rng(4), encode.Projection.initial(6, 4, 5)
    x, f = rng.normal(size=(30, 6)), rng.normal(size=(30, 16))
    sizes, exp = [], np.exp
    for log_scale in (-9.0, 0.0, 3.0, 20.0):
        params = train.parameters(weights) | {"log_scale": np.array([log_scale])}
        yt = x @ params["text_w"].T + params["text_b"]
        yl = np.maximum(f @ params["loc_w1"].T + params["loc_b1"], 0) @ params["loc_w2"].T + params["loc_b2"]
        zt, zl = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-6) for y in (yt, yl))
        want = train.info_nce(zt, zl, log_scale)
        with monkeypatch.context() as patched:
            patched.setattr(np, "exp", lambda v, *a, **k: (sizes.append(np.size(v)), exp(v, *a, **k))[1])
            loss, grads = train.batch_step(params, x, f)
        assert abs(loss - want) < 1e-12 * max(1.0, abs(want))
        assert all(np.isfinite(g).all() for g in grads.values())
    assert sizes.count(30 * 30) == 4


def test_order_statistics(spark):
    values = [0.0] * 300 + [float(v) for v in np.random.default_rng(5).normal(size=701)] + [1e9]
    df = spark.createDataFrame([(v, 2.0) for v in values], "x double, y double")
    row = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert row["x"]["median"] == float(np.median(values)) and row["y"]["median"] == 2.0
    few = profile.order_statistics(df, [("x", 1), ("x", 301), ("x", 1002)])
    ordered = sorted(values)
    assert few == {("x", 1): ordered[0], ("x", 301): ordered[300], ("x", 1002): 1e9}


def test_order_statistics_in_two_reads(spark):
    """Many values, ties and gaps: every rank exact, each source row read twice at most."""
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=60_000), np.full(30_000, 0.25), rng.normal(1e12, 1, size=9_999), [-1e300]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "x double").repartition(4)
    path = session.scratch_path(spark, "ranks")
    rows.write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        reads.add(1)
        return x

    targets = [("x", r) for r in (1, 2, 50_000, 50_001, 59_999, 90_001, 100_000)]
    got = profile.order_statistics(spark.read.parquet(path).select(seen("x").alias("x")), targets)
    ordered = np.sort(values)
    assert got == {(c, r): ordered[r - 1] for c, r in targets}
    assert reads.value <= 2 * (len(values) + 5)


def test_order_statistics_without_the_sketch(spark):
    """Ends that miss the rank are noticed; many distinct values are narrowed by bins."""
    df = spark.range(200_000).select((F.col("id") * 1.5).alias("x"))
    found, left = profile._enclosed(df, {("x", 10): (100.0, 200.0), ("x", 150_000): (None, None)})
    assert left == [("x", 10)] and found == {("x", 150_000): 149_999 * 1.5}
    with pytest.raises(ValueError):
        profile.order_statistics(df, [("x", 200_001)])


def test_batches(spark):
    rows = spark.range(1000)
    first = sampling.shuffled_batches(rows, 64, epoch=1).collect()
    sizes = {}
    for r in first:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sum(sizes.values()) == 1000 and max(sizes.values()) == 64
    second = {r.id: r.batch_id for r in sampling.shuffled_batches(rows, 64, epoch=2).collect()}
    assert any(second[r.id] != r.batch_id for r in first)


def test_method_families():
    assert [METHOD_FAMILY[m] for m in ("no_index", "pgvector_embedding", "concat_embedding", "contrastive_embedding")] == [
        "", "embedded_", "concat_embedded_", "contrastive_embedded_"
    ]


# --- metrics over several runs -------------------------------------------------------

def test_recall_of_several_sources(spark):
    rows = [(s, q, r + 1, 10 * q + r) for s in "ab" for q in range(2) for r in range(3)]
    truth = spark.createDataFrame(rows, "source string, qid long, rank int, id long")
    series = metrics.recall_series(truth, truth, 3).collect()
    assert len(series) == 4 and all(r["recall"] == 1.0 for r in series)


def test_recall_of_an_empty_prediction(spark):
    truth = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 1, 6)], "source string, qid long, rank int, id long")
    none = truth.limit(0).withColumn("method", F.lit("m"))
    series = metrics.recall_series(none, truth, 3).collect()
    assert sorted((r["source"], r["qid"], r["recall"]) for r in series) == [("a", 1, 0.0), ("a", 2, 0.0)]


def test_rows_of_queries_without_results(spark):
    results = spark.createDataFrame(
        [("m", 1, 1, 5, 2.0, [1.0, 0.0]), ("n", 2, 1, 6, 3.0, [0.0, 1.0])],
        "method string, qid long, rank int, id long, distance double, v array<double>")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    ranges = metrics.range_series(results, 3, asked).collect()
    assert sorted((r["method"], r["qid"], r["spatial_range"]) for r in ranges if r["spatial_range"]) == [("m", 1, 2.0), ("n", 2, 3.0)]
    coherence = metrics.coherence_series(results, "v", asked).collect()
    assert len(ranges) == len(coherence) == 6 and sum(r["coherence"] for r in coherence) == 2.0


def test_coherence_from_tags(spark):
    results = spark.createDataFrame(
        [(1, 1, {"a": "x"}), (1, 2, {"a": "x"}), (2, 3, {"a": "x"}), (2, 4, {"b": "y z"})], "qid long, id long, tags map<string,string>")
    series = metrics.coherence_series(metrics.with_tag_vectors(results), "embedding").collect()
    by = {r["qid"]: r["coherence"] for r in series}
    assert abs(by[1] - 1.0) < 1e-6 and by[2] < 0.9


def test_scratch_tables_are_removed_together(spark):
    import os

    from geolantern import session

    frame = session.materialize(spark.range(3), "kept")
    path = session.scratch_path(spark, "other")
    spark.range(2).write.parquet(path)
    assert frame.count() == 3 and os.path.isdir(os.path.dirname(path))
    session.drop_scratch(spark)
    assert not os.path.exists(os.path.dirname(path))


def test_draws_are_placed_without_one_task(spark):
    """Only the bounded bucket counts go through a single task."""
    import contextlib
    import io

    from geolantern.operators import sampling

    rows = spark.range(5000).withColumns({"lat": F.col("id") * 0.001, "lon": F.col("id") * 0.002})
    drawn = sampling.sample_points(rows, 3000, seed=5)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        drawn.explain()
    main = shown.getvalue().split("Subqueries")[0]
    assert "Window [last(" not in main
    assert drawn.count() == 3000 and drawn.select("draw").distinct().count() == 3000


def test_training_does_not_depend_on_cores(tmp_path):
    """The same weights from one core and from four, in processes of their own."""
    import json
    import os
    import subprocess
    import sys

    script = tmp_path / "train.py"
    script.write_text("""
import json, sys
import numpy as np
from pyspark.sql import SparkSession
from geolantern.operators import encode, train
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", sys.argv[2]).getOrCreate()
rng = np.random.default_rng(2)
rows = [(i, float(rng.uniform(-40, 40)), float(rng.uniform(-170, 170)), rng.normal(size=4).tolist()) for i in range(300)]
pairs = spark.createDataFrame(rows, "id long, lat double, lon double, vector array<double>")
weights, history = train.train(pairs, encode.Projection.initial(4, 6, 8), epochs=2, batch_size=16, lr=5e-3, workers=3)
print("RESULT" + json.dumps([weights.text_w.tolist(), weights.loc_w2.tolist(), weights.log_scale, history]))
""")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def run(master, parts):
        out = subprocess.run([sys.executable, str(script), master, parts], capture_output=True, text=True, timeout=300,
                             env={**os.environ, "PYTHONPATH": root})
        line = next(x for x in out.stdout.splitlines() if x.startswith("RESULT"))
        return json.loads(line[6:])

    def flat(x):
        return [v for y in x for v in flat(y)] if isinstance(x, list) else [x]

    one, four = flat(run("local[1]", "2")), flat(run("local[4]", "7"))
    assert len(one) == len(four) and max(abs(a - b) for a, b in zip(one, four)) < 1e-9


def test_a_batch_too_large_for_a_task_is_refused(spark):
    pairs = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0])] * 20, "batch_id long, zt array<double>, zl array<double>")
    with pytest.raises(Exception, match="needs more than 1000 bytes"):
        train.info_nce_loss(pairs, 0.0, batch_bytes=1000).collect()
