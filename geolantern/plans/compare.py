"""Scenario runs: the same queries by several retrieval methods."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import METHOD_FAMILY, SCENARIOS
from ..operators import stored
from ..operators.search import fused_search, keyword_search, semantic_search
from ..session import materialize, scratch_path


def scenario_methods(spark) -> DataFrame:
    """(scenario, method, family) of all scenarios."""
    rows = [(s, m, METHOD_FAMILY[m]) for s, methods in SCENARIOS.items() for m in methods]
    return spark.createDataFrame(rows, "scenario string, method string, family string")


def compare_methods(
    points: DataFrame, queries: DataFrame, methods, ks, vectors: dict[str, str] | None = None, source: str = "dataset"
) -> tuple[DataFrame, DataFrame]:
    """Results and timings, tidy, of every method for every k.

    ``vectors`` maps a vector family to the column of points and queries that holds its
    vector. Methods of one family differ in their access path alone and return the same
    rows, so a family is searched once, at the largest k. All queries run in one job:
    a query's time is its share of the job. Points are written first (insert time). No index
    is built here, so the index time is NULL.
    """
    vectors = vectors or {"embedded_": "embedding", "concat_embedded_": "concat",
                          "contrastive_embedded_": "contrastive"}
    largest = max(ks)
    start = time.perf_counter()
    stored = materialize(points, "compare-points")
    insert = time.perf_counter() - start
    asked = materialize(queries, "compare-queries")
    count = max(1, asked.count())
    results, seconds = {}, {}
    for family in dict.fromkeys(METHOD_FAMILY[m] for m in methods):
        start = time.perf_counter()
        if family == "":
            found = keyword_search(stored, asked, largest).withColumn("similarity", F.lit(None).cast("double"))
        else:
            column = vectors[family]
            search = semantic_search if family == "embedded_" else fused_search
            found = search(stored, asked, largest, vector=column)
        columns = ["qid", "rank", "id", "tags", "distance", "similarity"]
        results[family] = materialize(found.select(columns), "compare-results")
        seconds[family] = (time.perf_counter() - start) / count

    def labelled(df, labels):
        return df.withColumn("_run", F.explode(F.array(*labels))).select("_run.*", *df.columns)

    all_results, all_times = None, None
    for family, found in results.items():
        labels = [
            F.struct(F.lit(m).alias("method"), F.lit(source).alias("source"), F.lit(k).alias("k"))
            for m in methods if METHOD_FAMILY[m] == family for k in ks
        ]
        rows = labelled(found, labels).where(F.col("rank") <= F.col("k"))
        times = labelled(asked.select("qid", F.lit("query").alias("phase"), F.lit(seconds[family]).alias("seconds")), labels)
        all_results = rows if all_results is None else all_results.unionByName(rows)
        all_times = times if all_times is None else all_times.unionByName(times)
    spark = points.sparkSession
    loads = spark.createDataFrame(
        [(m, source, k, None, p, s) for m in methods for k in ks for p, s in (("insert", insert), ("index", None))],
        "method string, source string, k int, qid long, phase string, seconds double",
    )
    return all_results, all_times.unionByName(loads)


#: The stored tables that a method's queries read besides the points.
ACCESS = {
    "spatial_index": ("places",), "keyword_index": ("postings", "places"), "spatial_keyword_index": ("postings", "places"),
    "spatial_and_pgvector_embedding": ("places",),
}


def _measured(df: DataFrame, name: str) -> tuple[DataFrame, int, float]:
    """The frame as written, its rows and the seconds that writing took; rows are counted while they pass."""
    seen, start = Observation(), time.perf_counter()
    done = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return done, int(seen.get["rows"]), time.perf_counter() - start


def run_scenario(
    points: DataFrame, queries: DataFrame, methods, ks, embed: dict | None = None,
    vectors: dict[str, str] | None = None, source: str = "dataset",
) -> tuple[DataFrame, DataFrame]:
    """Builds what every method needs, asks each method by its own access path, and measures both.

    ``embed`` maps a vector family to a function that adds its column (named in ``vectors``) to
    points; ``queries`` has its vectors already. Returns the results of every method and k as
    ``compare_methods`` does, and measures (method, source, k, qid, phase, rows, seconds): ``insert`` of the points,
    ``embed``, ``index`` (0 rows and seconds where a method has no access table) and one ``query``
    row per query, its share of the method's job and the rows it found. Tables that several methods read are
    built once, and each of these methods shows their time. A method is asked once, at the largest k.
    """
    vectors = vectors or {"embedded_": "embedding", "concat_embedded_": "concat", "contrastive_embedded_": "contrastive"}
    embed, spark, largest = embed or {}, points.sparkSession, max(ks)
    inserted, *insert = _measured(points, "scenario-points")
    asked = materialize(queries, "scenario-queries")
    count = max(1, asked.count())
    tables, embedded, loads = {}, {}, []

    def embedded_points(family):
        if family not in embedded:
            embedded[family] = _measured(embed[family](inserted), "scenario-embedded")
        return embedded[family]

    def access(kind, family, rows):
        if (kind, family) not in tables:
            path, start = scratch_path(spark, f"scenario-{kind}"), time.perf_counter()
            (stored.write_places if kind == "places" else stored.write_postings)(rows, path)
            seconds = time.perf_counter() - start
            size = spark.read.parquet(f"{path}/manifest").agg(F.sum("n")).first()[0] or 0  # a row per file
            tables[kind, family] = path, int(size), seconds
        return tables[kind, family]

    results = times = None
    for method in methods:
        family = METHOD_FAMILY[method]
        rows, *built = embedded_points(family) if family else (inserted, 0, 0.0)
        paths = {kind: access(kind, family, rows) for kind in ACCESS.get(method, ())}
        start = time.perf_counter()
        if "postings" in paths:
            found = stored.keyword_search(
                spark, paths["postings"][0], paths["places"][0], asked, largest, near=method == "spatial_keyword_index")
        else:
            read = stored.places_near(spark, paths["places"][0], asked) if paths else rows
            if family == "":
                found = keyword_search(read, asked, largest)
            else:
                search = semantic_search if family == "embedded_" else fused_search
                found = search(read, asked, largest, vector=vectors[family])
        if family == "":
            found = found.withColumn("similarity", F.lit(None).cast("double"))
        found = materialize(found.select("qid", "rank", "id", "tags", "distance", "similarity"), "scenario-results")
        seconds = (time.perf_counter() - start) / count
        runs = F.explode(F.array(*[F.struct(F.lit(method).alias("method"), F.lit(source).alias("source"), F.lit(k).alias("k")) for k in ks]))
        mine = found.withColumn("_run", runs).select("_run.*", *found.columns).where(F.col("rank") <= F.col("k"))
        sizes = mine.groupBy("qid", "k").agg(F.count("*").alias("rows"))
        phase = asked.select("qid", runs.alias("_run")).select("_run.*", "qid").join(sizes, ["qid", "k"], "left").select(
            "method", "source", "k", "qid", F.lit("query").alias("phase"), F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(seconds).alias("seconds"))
        results = mine if results is None else results.unionByName(mine)
        times = phase if times is None else times.unionByName(phase)
        index = sum(t[1] for t in paths.values()), sum((t[2] for t in paths.values()), 0.0)
        loads += [(method, source, k, None, name, *map(float, measure)) for k in ks
                  for name, measure in (("insert", insert), ("embed", built), ("index", index))]
    if results is None:
        raise ValueError("no methods given")
    built = spark.createDataFrame(loads, "method string, source string, k int, qid long, phase string, rows double, seconds double")
    return results, times.unionByName(built.withColumn("rows", F.col("rows").cast("long")))
