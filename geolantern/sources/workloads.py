"""Stored query workloads: one statement per line, or typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COORD_DECIMALS, VECTOR_DECIMALS
from .queries import POSITION, number_rows, with_position

# The statement format of workload files.
_POINT = "ST_SetSRID(ST_MakePoint({lon}, {lat}), 4326)"
_SELECT = "SELECT id, tags, ST_Distance(geom::geography, {point}::geography) AS distance"
_SIMILARITY = ", 1.0 - (embedding <=> ARRAY[{vector}]::vector) AS similarity"

# The fields of a statement, by pattern.
_NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
_FIELDS = {
    "lon": rf"ST_MakePoint\({_NUMBER},",
    "lat": rf"ST_MakePoint\(-?[^,]+, {_NUMBER}\)",
    "radius_deg": rf"ST_DWithin\(geom, ST_SetSRID\(ST_MakePoint\([^)]*\), 4326\), {_NUMBER}\)",
    "limit": r"LIMIT ([0-9]+);",
}
_PAIR = r"tags @> '((?:[^']|'')*)'::jsonb"
_KEY = r"tags \? '((?:[^']|'')*)'"
_VECTOR = r"ARRAY\[([^\]]*)\]::vector"
_ORDER = r"ORDER BY (distance|similarity|geom <->)"
_FILE = (
    r"([^/]+)/(?:file=)?(custom|dataset)_((?:concat_|contrastive_)?(?:embedded_)?)queries_k([0-9]+)\.sql"
    r"(?:/part-[^/]*)?$"
)


def _extract(line: Column, pattern: str) -> Column:
    hit = F.regexp_extract(line, pattern, 1)
    return F.when(F.regexp_like(line, F.lit(pattern)), hit)


def parse_statements(lines: DataFrame) -> DataFrame:
    """Typed query fields of statement lines in column ``value``; other columns pass."""
    line = F.col("value")
    pair = F.replace(_extract(line, _PAIR), F.lit("''"), F.lit("'"))
    pair_map = F.from_json(pair, "map<string,string>")
    key = F.replace(_extract(line, _KEY), F.lit("''"), F.lit("'"))
    order = _extract(line, _ORDER)
    fields = {
        name: _extract(line, pattern).cast("int" if name == "limit" else "double")
        for name, pattern in _FIELDS.items()
    }
    vector = F.transform(F.split(_extract(line, _VECTOR), ", "), lambda x: x.cast("float"))
    return lines.withColumns({
        **fields,
        "tag_key": F.coalesce(F.get(F.map_keys(pair_map), F.lit(0)), key),
        "tag_value": F.get(F.map_values(pair_map), F.lit(0)),
        "qvec": vector,
        "order_by": F.when(order == "geom <->", F.lit("planar")).otherwise(order),
    })


def load_workload(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of all workload files below ``path``.

    ``qid`` is the zero-based number of the non-blank line within its file.
    """
    name = F.col("_metadata.file_path")
    lines = with_position(
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.sql,part-*}").text(path)
    ).select(
        F.regexp_extract(name, _FILE, 1).alias("experiment"), F.regexp_extract(name, _FILE, 2).alias("source"),
        F.regexp_extract(name, _FILE, 3).alias("family"), F.regexp_extract(name, _FILE, 4).cast("int").alias("k"),
        *POSITION, "value",
    ).where(F.trim("value") != "")
    keys = ["experiment", "source", "family", "k"]
    numbered = number_rows(lines, keys, list(POSITION), "qid").drop(*POSITION)
    return parse_statements(numbered).drop("value")


def statement(row_has_vector: Column) -> Column:
    """Statement text of a typed query row (the text form of a workload)."""
    def fixed(x, n):
        return F.format_string(f"%.{n}f", x)

    lon, lat = fixed(F.col("lon"), COORD_DECIMALS), fixed(F.col("lat"), COORD_DECIMALS)

    def fill(template, **values):
        out, rest = [], template
        while "{" in rest:
            before, rest = rest.split("{", 1)
            name, rest = rest.split("}", 1)
            out += [F.lit(before), values[name]]
        return F.concat(*out, F.lit(rest))

    point = fill(_POINT, lon=lon, lat=lat)
    vector = F.array_join(F.transform("qvec", lambda x: fixed(x.cast("double"), VECTOR_DECIMALS)), ", ")
    head = fill(_SELECT, point=point)
    head = F.when(row_has_vector, F.concat(head, fill(_SIMILARITY, vector=vector))).otherwise(head)

    def quoted(x):
        return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))

    pair = F.concat(F.lit("tags @> "), quoted(F.to_json(F.create_map("tag_key", "tag_value"))), F.lit("::jsonb"))
    tag = F.when(F.col("tag_value").isNotNull(), pair).when(
        F.col("tag_key").isNotNull(), F.concat(F.lit("tags ? "), quoted(F.col("tag_key")))
    )
    radius = F.when(F.col("radius_deg").isNotNull(), F.concat(
        F.lit("ST_DWithin(geom, "), point, F.lit(", "), F.col("radius_deg").cast("string"), F.lit(")")
    ))
    where = F.concat_ws(" AND ", tag, radius)
    order = (
        F.when(F.col("order_by") == "similarity", F.lit("similarity DESC, distance ASC"))
        .when(F.col("order_by") == "planar", F.concat(F.lit("geom <-> "), point)).otherwise(F.lit("distance"))
    )
    return F.concat(
        head, F.lit(" FROM PoIs "), F.when(where != "", F.concat(F.lit("WHERE "), where, F.lit(" "))).otherwise(F.lit("")),
        F.lit("ORDER BY "), order, F.lit(" LIMIT "), F.col("limit").cast("string"), F.lit(";"),
    )


def write_statements(workload: DataFrame, path: str, files: int = 1) -> None:
    """Workload as statement text, one line per query, one folder per workload file.

    Lines keep the order of qid; ``files`` range parts spread a long workload.
    """
    name = F.concat("source", F.lit("_"), "family", F.lit("queries_k"), "k", F.lit(".sql"))
    lines = workload.select(name.alias("file"), "qid", statement(F.col("qvec").isNotNull()).alias("value"))
    ordered = lines.repartitionByRange(files, "qid").sortWithinPartitions("file", "qid")
    ordered.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def write_workload(workload: DataFrame, path: str) -> None:
    """Typed workload rows as parquet, one folder per source, family and k."""
    # An empty family name has no folder spelling of its own.
    named = workload.withColumn("family", F.when(F.col("family") == "", "plain").otherwise(F.col("family")))
    named.write.mode("overwrite").partitionBy("source", "family", "k").parquet(path)


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.withColumn("family", F.when(F.col("family") == "plain", "").otherwise(F.col("family")))
