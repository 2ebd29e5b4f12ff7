"""Evaluation of retrieval results.

Results are rows (method, source, k, qid, rank, id, distance, ...); functions work per
query and per any further key columns that both inputs have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import tags_json
from ..functions.vectors import dot, l2_normalize, mean_vector
from ..operators.encode import HashingEncoder

RUN = ("method", "source", "k")


def _keys(df: DataFrame, *others: DataFrame) -> list[str]:
    common = [c for c in RUN if c in df.columns and all(c in o.columns for o in others)]
    return [*common, "qid"]


def _per_run(queries: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The queries once per run of ``results`` (few: one per method, source and k).

    Run columns that the queries have themselves must agree; without any run they stay,
    and the others are NULL.
    """
    runs = keys[:-1]
    if not runs:
        return queries
    own = [c for c in runs if c in queries.columns]
    lists = results.select(*runs).distinct().agg(F.collect_set(F.struct(*runs)).alias("_runs")).scalar()
    many = queries.withColumn("_run", F.explode_outer(lists))
    agree = F.lit(True)
    for c in own:
        agree = agree & F.col(f"_run.{c}").eqNullSafe(F.col(c))
    many = many.where(F.col("_run").isNull() | agree)
    chosen = [F.coalesce(F.col(f"_run.{c}"), F.col(c)).alias(c) if c in own else F.col(f"_run.{c}").alias(c) for c in runs]
    return many.select(*chosen, *[c for c in queries.columns if c not in runs])


def recall_series(predicted: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Recall per truth query and run: the prediction is cut to ``k``, the truth is not.

    The truth of a prediction is that of the same source and k, where both sides have those
    columns; a method is compared with any truth. ``queries`` adds queries whose truth is
    empty; their recall is 1. An empty prediction has recall 0 for every truth query.
    """
    keys = _keys(predicted)
    shared = [c for c in keys if c in truth.columns and c not in ("method", "qid")]
    true_ids = truth.select(*shared, "qid", "id").distinct()
    hits = predicted.where(F.col("rank") <= k).select(*keys, "id").distinct().join(true_ids, [*shared, "qid", "id"])
    sizes = true_ids.groupBy(*shared, "qid").agg(F.count("*").alias("size"))
    if queries is not None:
        asked = queries.select("qid", *[c for c in shared if c in queries.columns]).distinct()
        asked = _per_run(asked, truth, [*shared, "qid"])
        sizes = asked.unionByName(sizes.select(*asked.columns)).distinct().join(sizes, [*shared, "qid"], "left")
    counts = hits.groupBy(*keys).agg(F.count("*").alias("hits"))
    recall = F.when(F.coalesce("size", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("size"))
    return _per_run(sizes, predicted, keys).join(counts, keys, "left").select(*keys, recall.alias("recall"))


def recall_at_k(predicted: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Mean recall over truth queries, four decimals."""
    series = recall_series(predicted, truth, k, queries)
    return series.groupBy(*_keys(predicted)[:-1]).agg(F.round(F.avg("recall"), 4).alias("recall"))


def coherence_series(results: DataFrame, vector: str, queries: DataFrame | None = None) -> DataFrame:
    """Mean pairwise cosine of the result vectors per query, diagonal included.

    The mean of the k x k matrix equals the squared norm of the mean unit vector, so no
    pair is formed. ``queries`` adds queries without results in a run as 0.
    """
    keys = _keys(results)
    series = results.groupBy(*keys).agg(mean_vector(l2_normalize(vector)).alias("_m")).select(
        *keys, dot("_m", "_m").alias("coherence")
    )
    if queries is not None:
        asked = _per_run(queries.select("qid").distinct(), results, keys)
        series = asked.join(series, keys, "left").fillna({"coherence": 0.0})
    return series


def coherence_at_k(results: DataFrame, vector: str) -> DataFrame:
    """Mean coherence over queries with results, four decimals."""
    keys = _keys(results)[:-1]
    return coherence_series(results, vector).groupBy(*keys).agg(F.round(F.avg("coherence"), 4).alias("coherence"))


def with_tag_vectors(results: DataFrame, encoder=None, out: str = "embedding") -> DataFrame:
    """Results with the encoded text of their tags, for coherence where no vector is stored."""
    encoder = HashingEncoder() if encoder is None else encoder
    texts = results.select("id", tags_json("tags").alias("text")).where("text IS NOT NULL").dropDuplicates(["id"])
    return results.join(encoder(texts, "text", out, keep=["id"]), "id")


def range_series(results: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Largest distance among the first ``k`` results per query and run; NULL without results."""
    series = results.where(F.col("rank") <= k).groupBy(*_keys(results)).agg(F.max("distance").alias("spatial_range"))
    if queries is not None:
        keys = _keys(results)
        series = _per_run(queries.select("qid").distinct(), results, keys).join(series, keys, "left")
    return series


def spread_series(results: DataFrame, k: int) -> DataFrame:
    """Standard deviation over mean of the distances of the first ``k`` results."""
    ratio = F.when(F.avg("distance") != 0, F.stddev_pop("distance") / F.avg("distance"))
    return results.where(F.col("rank") <= k).groupBy(*_keys(results)).agg(ratio.alias("spatial_cv"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Average and largest query time, insert and index time per run, four decimals."""
    def of(phase, fn):
        return F.round(fn(F.when(F.col("phase") == phase, F.col("seconds"))), 4)

    return timings.groupBy(*RUN).agg(
        of("query", F.avg).alias("average_execution_time"), of("query", F.max).alias("max_execution_time"),
        of("insert", F.max).alias("insertion_time"), of("index", F.max).alias("index_creation_time"),
    )


def metric_series(results: DataFrame, timings: DataFrame, k: int, vector: str | None = None) -> DataFrame:
    """Tidy (method, source, k, qid, metric, value): execution, spatial range, coherence."""
    keys = [*RUN, "qid"]
    asked = timings.where(F.col("phase") == "query").select(*keys, "seconds")

    def tidy(df, metric, column):
        return df.select(*keys, F.lit(metric).alias("metric"), F.col(column).alias("value"))

    ranges = asked.join(range_series(results, k), keys, "left")
    out = tidy(asked, "execution", "seconds").unionByName(tidy(ranges, "spatial_range", "spatial_range"))
    if vector is not None:
        coherence = asked.join(coherence_series(results, vector), keys, "left")
        rounded = coherence.withColumn("coherence", F.round(F.coalesce("coherence", F.lit(0.0)), 3))
        out = out.unionByName(tidy(rounded, "coherence", "coherence"))
    return out


def method_report(series: DataFrame) -> DataFrame:
    """Mean of every metric per method, source and k; NULLs do not count."""
    return series.groupBy(*RUN, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("queries"))


def ordered_by_query(series: DataFrame) -> DataFrame:
    """Series in numeric query order."""
    return series.orderBy(F.col("qid").try_cast("long"), "qid")
