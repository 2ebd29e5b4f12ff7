"""Search results: tidy tables and the nested JSON document form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The nested result document.
_ROW = "struct<id:long,tags:string,distance:double,sims:double>"
DOCUMENT_SCHEMA = (
    "insertion_time double, index_creation struct<func:array<string>,time:double>, "
    f"query_results map<string,struct<execution_time:double,results:array<{_ROW}>>>"
)
_FILE = r"([^/_]+)_([^/]+)_results_k([0-9]+)\.json$"
_FOLDER = r"method=([^/]+)/source=([^/]+)/k=([0-9]+)/"


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Results and timings of result documents.

    Method, source and k come from the path: the file name
    ``{source}_{method}_results_k{k}.json`` or folders written by ``write_documents``.
    """
    docs = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", str(multi_line).lower()).option(
        "recursiveFileLookup", "true"
    ).json(path)
    name = F.col("_metadata.file_path")

    def part(folder, file):
        found = F.regexp_extract(name, _FOLDER, folder)
        return F.when(found != "", found).otherwise(F.regexp_extract(name, _FILE, file))

    named = docs.withColumns({"method": part(1, 2), "source": part(2, 1), "k": part(3, 3).cast("int")})
    keys = ["method", "source", "k"]
    per_query = named.select(*keys, F.explode("query_results").alias("qid", "res")).withColumn(
        "qid", F.col("qid").try_cast("long")
    )
    results = per_query.select(*keys, "qid", F.posexplode("res.results").alias("pos", "row")).select(
        *keys, "qid", (F.col("pos") + 1).alias("rank"), "row.id", "row.tags", "row.distance",
        F.col("row.sims").alias("similarity"),
    )
    query_times = per_query.select(
        *keys, "qid", F.lit("query").alias("phase"), F.coalesce("res.execution_time", F.lit(0.0)).alias("seconds")
    )
    loads = named.select(*keys, F.lit(None).cast("long").alias("qid"), F.explode(F.create_map(
        F.lit("insert"), F.coalesce("insertion_time", F.lit(0.0)),
        F.lit("index"), F.coalesce("index_creation.time", F.lit(0.0)),
    )).alias("phase", "seconds"))
    return results, query_times.unionByName(loads)


def result_documents(results: DataFrame, timings: DataFrame, per_document: int = 1000) -> DataFrame:
    """Nested documents per (method, source, k) from tidy tables.

    A run with many queries is cut into documents of ``per_document`` query ids, so no
    task builds an unbounded one; ``read_results`` joins them again.
    """
    keys = ["method", "source", "k"]
    row = F.struct("rank", "id", "tags", "distance", F.col("similarity").alias("sims"))
    # At most k rows per query and run.
    lists = results.groupBy(*keys, "qid").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(r["id"], r["tags"], r["distance"], r["sims"]))
    queries = timings.where(F.col("phase") == "query").join(lists, [*keys, "qid"], "left")
    entry = F.struct(
        F.col("seconds").alias("execution_time"), F.coalesce(plain, F.array().cast(f"array<{_ROW}>")).alias("results")
    )
    part = F.floor(F.col("qid") / per_document).alias("part")
    maps = queries.groupBy(*keys, part).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("qid").cast("string"), entry))).alias("query_results")
    )
    loads = timings.where(F.col("phase") != "query").groupBy(*keys).agg(
        F.max(F.when(F.col("phase") == "insert", F.col("seconds"))).alias("insertion_time"),
        F.struct(
            F.array().cast("array<string>").alias("func"),
            F.max(F.when(F.col("phase") == "index", F.col("seconds"))).alias("time"),
        ).alias("index_creation"),
    )
    return maps.join(loads, keys, "left").drop("part")


def write_results(results: DataFrame, path: str) -> None:
    """Tidy results as parquet, one folder per method, source and k."""
    results.write.mode("overwrite").partitionBy("method", "source", "k").parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested documents as JSON lines, one folder per method, source and k."""
    documents.write.mode("overwrite").partitionBy("method", "source", "k").json(path)
