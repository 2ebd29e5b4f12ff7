"""Point, vector and query views derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolantern.constants import METRES_PER_DEGREE
from geolantern.operators.encode import Projection
from geolantern.session import spread

RADIUS_M = 10_000
RADIUS_DEG = RADIUS_M / METRES_PER_DEGREE
K = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(key: str, step: int, prime: int, low: float, width: float) -> str:
    return (
        f"CAST({low} AS DOUBLE)+CAST({width} AS DOUBLE)*CAST(({key}*{step})%{prime} AS DOUBLE)"
        f"/CAST({prime} AS DOUBLE)"
    )


def _lat(key: str) -> str:
    return _spread(key, 7919, 100003, -38.2, 0.8)


def _lon(key: str) -> str:
    return _spread(key, 104729, 100019, 144.5, 1.1)


_AMENITY = (
    "CASE WHEN event_type='view' THEN 'cafe' WHEN event_type='click' THEN 'bench' "
    "WHEN event_type='purchase' THEN 'restaurant' WHEN event_type='signup' THEN 'toilets' END"
)
_VALUE = (
    "CASE WHEN n_nationkey%4=0 THEN 'cafe' WHEN n_nationkey%4=1 THEN 'bench' "
    "WHEN n_nationkey%4=2 THEN 'restaurant' ELSE 'toilets' END"
)
_KEY = "CASE WHEN n_nationkey%3=0 THEN 'amenity' WHEN n_nationkey%3=1 THEN 'shop' ELSE 'name' END"


def _poi_columns(k: str) -> str:
    return (
        f"event_id AS id, {_lat('event_id')} AS lat, {_lon('event_id')} AS lon, {_AMENITY} AS amenity, "
        f"CASE WHEN {k}%2=0 THEN 'clothes' END AS shop, "
        f"CASE WHEN {k}%3=0 THEN concat('poi ', CAST(user_id AS VARCHAR(20))) END AS name, "
        "event_type, value, user_id"
    )


def flat_pois(spark: SparkSession, sf: str) -> DataFrame:
    """Points with their tags as columns."""
    k = "CAST(get_json_object(props,'$.k') AS INT)"
    return spread(table(spark, sf, "events"), "event_id").selectExpr(*_split(_poi_columns(k)))


def _split(columns: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def tag_map(*names: str) -> Column:
    pairs = [part for n in names for part in (F.lit(n), F.col(n))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def pois(spark: SparkSession, sf: str) -> DataFrame:
    """(id, lat, lon, tags)."""
    return flat_pois(spark, sf).select("id", "lat", "lon", tag_map("amenity", "shop", "name").alias("tags"))


def shifted(vector: str, key: str) -> Column:
    """Distinct vector per key: a shared vector shifted by the key."""
    return F.transform(F.col(vector), lambda x, i: x.cast("double") + F.lit(0.2) * (
        (F.col(key) * 31 + i * 17) % 101
    ).cast("double") / F.lit(101.0))


def with_vec_id(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    count = table(spark, sf, "embeddings").agg(F.count("*").alias("n")).scalar()
    return df.withColumn("vec_id", F.col("id") % count)


def with_raw(spark: SparkSession, sf: str, df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows with the vector that their id maps to, as column ``raw``; the only join that vectors need.

    Further vectors are derived from it, so rows meet the table before they are wide.
    """
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias(raw))
    return with_vec_id(spark, sf, df).join(vectors, "vec_id").drop("vec_id")


def vector_pois(spark: SparkSession, sf: str, shared: bool = False) -> DataFrame:
    """Points with ``embedding``: distinct vectors, or the shared ones for tie tests."""
    joined = with_raw(spark, sf, pois(spark, sf), "embedding")
    return joined if shared else joined.withColumn("embedding", shifted("embedding", "id"))


def queries(spark: SparkSession, sf: str, radius: float | None = None, by: str = "pair") -> DataFrame:
    """One query per nation: place, text, tag and radius."""
    nation = table(spark, sf, "nation")
    value = _VALUE if by == "pair" else "CAST(NULL AS STRING)"
    key = "'amenity'" if by == "pair" else _KEY
    return nation.selectExpr(
        "CAST(n_nationkey AS BIGINT) AS qid", f"round({_lat('n_nationkey')}, 8) AS lat",
        f"round({_lon('n_nationkey')}, 8) AS lon", "n_name AS text", f"{key} AS tag_key", f"{value} AS tag_value",
    ).withColumn("radius_deg", F.lit(radius).cast("double"))


def vector_queries(spark: SparkSession, sf: str, radius: float | None = None) -> DataFrame:
    """Queries with ``embedding``."""
    asked = queries(spark, sf, radius).withColumn("vec_id", F.col("qid") * 7)
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    joined = asked.join(vectors, "vec_id")
    return joined.withColumn("embedding", shifted("embedding", "vec_id")).drop("vec_id")


def closed_form_weights(text_dim: int, dim: int = 32, hidden: int = 64) -> Projection:
    """Weights with a closed form, so that SQL can compute them too."""
    import numpy as np

    def layer(n_out, n_in, salt):
        i, j = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
        w = (((i * 37 + j * 53 + salt) * 7919) % 1009 / 1009.0 - 0.5) / np.sqrt(n_in)
        b = ((np.arange(n_out) * 71 + salt) * 104729 % 997 / 997.0 - 0.5) / np.sqrt(n_in)
        return w, b

    return Projection(*layer(dim, text_dim, 1), *layer(hidden, 16, 2), *layer(dim, hidden, 3), float(np.log(1 / 0.07)))


# --- the same views as SQL common table expressions -------------------------------------

_JSON_K = "CAST(json_extract(props,'$.k') AS INT)"

P = f"p AS (SELECT {_poi_columns(_JSON_K)} FROM events)"

EV = (
    P + ", pv AS (SELECT p.*, list_transform(e.embedding, lambda x, i: CAST(x AS DOUBLE)+CAST(0.2 AS DOUBLE)"
    "*CAST((p.id*31+(i-1)*17)%101 AS DOUBLE)/CAST(101 AS DOUBLE)) AS ev, "
    "list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS shared "
    "FROM p JOIN embeddings e ON e.vec_id = p.id % (SELECT count(*) FROM embeddings))"
)


def q_sql(radius: float | None = None, by: str = "pair", name: str = "q") -> str:
    value = _VALUE if by == "pair" else "CAST(NULL AS VARCHAR)"
    key = "'amenity'" if by == "pair" else _KEY
    rad = "CAST(NULL AS DOUBLE)" if radius is None else f"CAST({radius!r} AS DOUBLE)"
    return (
        f"{name} AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, round({_lat('n_nationkey')}, 8) AS qlat, "
        f"round({_lon('n_nationkey')}, 8) AS qlon, n_name AS text, {key} AS tag_key, {value} AS tag_value, "
        f"{rad} AS radius_deg FROM nation)"
    )


QV = (
    "qv AS (SELECT q.*, list_transform(e.embedding, lambda x, i: CAST(x AS DOUBLE)+CAST(0.2 AS DOUBLE)"
    "*CAST((e.vec_id*31+(i-1)*17)%101 AS DOUBLE)/CAST(101 AS DOUBLE)) AS qev "
    "FROM q JOIN embeddings e ON e.vec_id = q.qid*7)"
)


def geodesic_sql(source: str, keep: str, name: str, lat1="lat", lon1="lon", lat2="qlat", lon2="qlon") -> str:
    """CTEs that end in ``name``: the rows of ``source`` with the spheroidal ``distance``."""
    a, f = "CAST(6378137.0 AS DOUBLE)", "(CAST(1 AS DOUBLE)/CAST(298.257223563 AS DOUBLE))"
    b = f"({a}*(1-{f}))"
    ctes = [
        f"{name}_0 AS (SELECT {keep}, atan((1-{f})*tan(radians({lat1}))) AS u1, "
        f"atan((1-{f})*tan(radians({lat2}))) AS u2, radians({lon2})-radians({lon1}) AS dl FROM {source})",
        f"{name}_r0 AS (SELECT {keep}, dl, dl AS lam, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, "
        f"CAST(0 AS DOUBLE) AS ss, CAST(0 AS DOUBLE) AS cs, CAST(0 AS DOUBLE) AS sg, CAST(0 AS DOUBLE) AS ca, "
        f"CAST(0 AS DOUBLE) AS cm FROM {name}_0)",
    ]
    for i in range(6):
        base = f"{keep}, dl, s1, c1, s2, c2"
        ctes += [
            f"{name}_a{i} AS (SELECT {base}, sin(lam) AS sl, sqrt(pow(c2*sin(lam),2)+pow(c1*s2-s1*c2*cos(lam),2)) AS ss, "
            f"s1*s2+c1*c2*cos(lam) AS cs FROM {name}_r{i})",
            f"{name}_b{i} AS (SELECT {base}, ss, cs, atan2(ss,cs) AS sg, "
            f"CASE WHEN ss=0 THEN CAST(0 AS DOUBLE) ELSE c1*c2*sl/ss END AS sa FROM {name}_a{i})",
            f"{name}_c{i} AS (SELECT {base}, ss, cs, sg, sa, 1-sa*sa AS ca, "
            f"CASE WHEN 1-sa*sa=0 THEN CAST(0 AS DOUBLE) ELSE cs-2*s1*s2/(1-sa*sa) END AS cm, "
            f"{f}/16*(1-sa*sa)*(4+{f}*(4-3*(1-sa*sa))) AS cc FROM {name}_b{i})",
            f"{name}_r{i + 1} AS (SELECT {base}, ss, cs, sg, ca, cm, "
            f"dl+(1-cc)*{f}*sa*(sg+cc*ss*(cm+cc*cs*(2*cm*cm-1))) AS lam FROM {name}_c{i})",
        ]
    ctes += [
        f"{name}_u AS (SELECT {keep}, ss, cs, sg, cm, ca*({a}*{a}-{b}*{b})/({b}*{b}) AS us FROM {name}_r6)",
        f"{name}_k AS (SELECT {keep}, ss, cs, sg, cm, 1+us/16384*(4096+us*(-768+us*(320-175*us))) AS ka, "
        f"us/1024*(256+us*(-128+us*(74-47*us))) AS kb FROM {name}_u)",
        f"{name} AS MATERIALIZED (SELECT {keep}, {b}*ka*(sg-kb*ss*(cm+kb/4*(cs*(2*cm*cm-1)-kb/6*cm*(4*ss*ss-3)*(4*cm*cm-3)))) "
        f"AS distance FROM {name}_k)",
    ]
    return ", ".join(ctes)


HAVERSINE = (
    "2*CAST(6371008.7714 AS DOUBLE)*asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin((radians(qlat)-radians(lat))/2),2)"
    "+cos(radians(lat))*cos(radians(qlat))*pow(sin((radians(qlon)-radians(lon))/2),2))))"
)
PLANAR = "sqrt((lon-qlon)*(lon-qlon)+(lat-qlat)*(lat-qlat))"


def tokens_sql(source: str, key: str, text: str, name: str, dim: int) -> str:
    """CTE ``name``: (key, bucket, count) of the signed token hashes of a text."""
    return (
        f"{name}_t AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda t: t <> '')) AS tok FROM {source}), "
        f"{name}_h AS (SELECT {key}, CAST('0x' || substr(md5(tok),1,8) AS BIGINT) AS h FROM {name}_t), "
        f"{name} AS (SELECT {key}, h % {dim} AS bucket, "
        f"CAST(sum(1 - 2*((h // {dim}) % 2)) AS DOUBLE) AS c FROM {name}_h GROUP BY ALL)"
    )


def dense_sql(source: str, key: str, tokens: str, name: str, dim: int) -> str:
    """CTE ``name``: (key, vec DOUBLE[dim]) of float-rounded unit token vectors."""
    return (
        f"{name}_n AS (SELECT {key}, sqrt(sum(c*c)) AS norm FROM {tokens} GROUP BY {key}), "
        f"{name}_g AS (SELECT s.{key}, g.b FROM {source} s, (SELECT unnest(range({dim})) AS b) g), "
        f"{name} AS (SELECT g.{key}, list(CASE WHEN coalesce(n.norm,0)=0 THEN CAST(0 AS DOUBLE) ELSE "
        f"CAST(CAST(coalesce(t.c,0)/n.norm AS FLOAT) AS DOUBLE) END ORDER BY g.b) AS vec "
        f"FROM {name}_g g LEFT JOIN {tokens} t ON t.{key}=g.{key} AND t.bucket=g.b "
        f"LEFT JOIN {name}_n n ON n.{key}=g.{key} GROUP BY g.{key})"
    )


def _layer_sql(n_out: int, n_in: int, salt: int, name: str) -> str:
    return (
        f"{name} AS (SELECT i, list((((i*37+j*53+{salt})*7919)%1009/CAST(1009 AS DOUBLE)-CAST(0.5 AS DOUBLE))"
        f"/sqrt(CAST({n_in} AS DOUBLE)) ORDER BY j) AS w, "
        f"((i*71+{salt})*104729%997/CAST(997 AS DOUBLE)-CAST(0.5 AS DOUBLE))/sqrt(CAST({n_in} AS DOUBLE)) AS b "
        f"FROM (SELECT unnest(range({n_out})) AS i) a, (SELECT unnest(range({n_in})) AS j) c GROUP BY i)"
    )


def _unit_sql(source: str, key: str, value: str, name: str) -> str:
    """Ordered unit vector of (key, i, value), rounded to float."""
    return (
        f"{name}_s AS (SELECT {key}, list({value} ORDER BY i) AS v, "
        f"greatest(sqrt(sum({value}*{value})), CAST(0.000001 AS DOUBLE)) AS n FROM {source} GROUP BY {key}), "
        f"{name} AS (SELECT {key}, list_transform(v, lambda x: CAST(CAST(x/n AS FLOAT) AS DOUBLE)) AS vec FROM {name}_s)"
    )


def location_sql(source: str, key: str, lat: str, lon: str, name: str, dim: int = 32, hidden: int = 64) -> str:
    """CTE ``name``: (key, vec) of the location network with the closed-form weights."""
    bands = (1, 2, 4, 8)
    feats = [f"{fn}(radians({c})*{b})" for c in (lon, lat) for fn in ("sin", "cos") for b in bands]
    return ", ".join([
        _layer_sql(hidden, 16, 2, f"{name}_w1"), _layer_sql(dim, hidden, 3, f"{name}_w2"),
        f"{name}_f AS (SELECT {key}, [{', '.join(feats)}] AS f FROM {source})",
        f"{name}_x AS (SELECT {key}, list(greatest(list_dot_product(f, w)+b, CAST(0 AS DOUBLE)) ORDER BY i) AS hid "
        f"FROM {name}_f, {name}_w1 GROUP BY {key})",
        f"{name}_y AS (SELECT {key}, i, list_dot_product(hid, w)+b AS y FROM {name}_x, {name}_w2)",
        _unit_sql(f"{name}_y", key, "y", name),
    ])


def text_projection_sql(source: str, key: str, vec: str, name: str, text_dim: int, dim: int = 32) -> str:
    """CTE ``name``: (key, vec) of the text projection with the closed-form weights."""
    return ", ".join([
        _layer_sql(dim, text_dim, 1, f"{name}_w"),
        f"{name}_y AS (SELECT {key}, i, list_dot_product({vec}, w)+b AS y FROM {source}, {name}_w)",
        _unit_sql(f"{name}_y", key, "y", name),
    ])


def checksum(vector) -> Column:
    """Position-weighted sum of a vector."""
    weighted = F.transform(F.col(vector).cast("array<double>"), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6)


def checksum_sql(vector: str) -> str:
    return f"round(list_sum(list_transform({vector}, lambda x, i: x*i)), 6)"
