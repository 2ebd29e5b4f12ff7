"""Approximate search: inverted lists and random hyperplane buckets, exact re-ranking."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from .topk import _matrix, vector_topk

DEFAULT_LISTS = 300
# Points on which a centroid is fitted, on average.
FIT_PER_LIST = 256
# Parts over which the rows of a list are dealt.
LIST_PARTS = 16


def train_ivf(
    points: DataFrame, lists: int = DEFAULT_LISTS, vector: str = "embedding", seed: int = 7, rounds: int = 10
) -> KMeansModel:
    """Centroids of the unit vectors of points: of all, or of some ``FIT_PER_LIST`` for each list.

    The sample is drawn by a hash of the id, so it does not grow with the table. Only the centroids come from it:
    every point is put in a list, and probing all lists is the exact search.
    """
    wanted, n = FIT_PER_LIST * lists, points.count()
    if n > wanted:
        points = points.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) < wanted)
    unit = points.where(F.size(vector) > 0).select(array_to_vector(l2_normalize(vector)).alias("features"))
    return KMeans(k=lists, seed=seed, maxIter=rounds, initMode="random").fit(unit)


def _unit_centroids(model):
    """Unit centroids of a trained model, or of an array of centroids given as they are."""
    import numpy as np

    centers = np.asarray(model.clusterCenters() if isinstance(model, KMeansModel) else model, dtype="float64")
    norm = np.linalg.norm(centers, axis=1, keepdims=True)
    return centers / np.where(norm == 0, 1.0, norm)


def nearest_lists(df: DataFrame, centroids, n: int, vector: str = "embedding", out: str = "lists") -> DataFrame:
    """Add the ``n`` lists with the most similar centroids, nearest first."""
    n = min(n, len(centroids))
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = df.columns

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sims = _matrix(batch.column(names.index(vector))) @ shared.value.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :n].astype("int32")
            offsets = np.arange(0, order.size + 1, n, dtype="int32")
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, out])

    return df.mapInArrow(assign, schema)


def _fitting(points: DataFrame, vector: str, dim: int) -> DataFrame:
    """Points whose vector can be searched: of the right length and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    return points.where((F.size(vector) == dim) & finite)


def ivf_table(points: DataFrame, model, vector: str = "embedding") -> DataFrame:
    """Points with their ``list_id``; ``model``: trained, or an array of centroids."""
    centroids = _unit_centroids(model)
    with_list = nearest_lists(_fitting(points, vector, centroids.shape[1]), centroids, 1, vector)
    return with_list.withColumn("list_id", F.col("lists")[0])


def write_ivf(table: DataFrame, path: str) -> None:
    """Store an inverted-list table, every file in list order, so a search skips the row groups of other lists.

    Rows are dealt by list and a hash of the id: a list that holds a third of the rows is spread over several files,
    and no ranges are drawn, for which all vectors and lists would be computed twice.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(LIST_PARTS))
    table.repartition("list_id", part).sortWithinPartitions("list_id", "id").write.mode("overwrite").parquet(path)


def ivf_search(
    table: DataFrame, queries: DataFrame, k: int, model, nprobe: int = 10,
    vector: str = "embedding", **options,
) -> DataFrame:
    """Top-k among the points of the ``nprobe`` nearest lists of each query.

    Queries meet the points list by list within each task: only pairs of a probed list are scored, and
    no vector is shuffled.
    """
    asked = nearest_lists(queries, _unit_centroids(model), nprobe, vector)
    # Lists are numbered below the number of centroids: a bounded set.
    probed = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]
    # A stored table is read only at the row groups of probed lists.
    points = table.where(F.col("list_id").isin(probed)).withColumn("lists", F.array("list_id"))
    return vector_topk(points, asked, k, parts=(vector,), groups="lists", **options)


def hyperplanes(dim: int, tables: int = 8, bits: int = 8, seed: int = 7):
    import numpy as np

    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def lsh_buckets(df: DataFrame, planes, vector: str = "embedding", out: str = "buckets") -> DataFrame:
    """Add one bucket number per hash table; numbers of different tables differ."""
    import numpy as np

    tables, bits, dim = planes.shape
    flat = np.ascontiguousarray(planes.reshape(tables * bits, dim))
    shared = df.sparkSession.sparkContext.broadcast(flat)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])
    names = df.columns

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        weights = 2 ** np.arange(bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _matrix(batch.column(names.index(vector))) @ shared.value.T > 0
            codes = signs.reshape(batch.num_rows, tables, bits) @ weights + np.arange(tables) * 2**bits
            offsets = np.arange(0, codes.size + 1, tables, dtype="int32")
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1).astype("int64")))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, out])

    return df.mapInArrow(assign, schema)


def lsh_search(
    points: DataFrame, queries: DataFrame, k: int, planes, vector: str = "embedding", **options
) -> DataFrame:
    """Top-k among the points that share a bucket with the query in some hash table."""
    dim = planes.shape[2]
    mine = lsh_buckets(_fitting(points, vector, dim), planes, vector)
    asked = lsh_buckets(queries, planes, vector)
    return vector_topk(mine, asked, k, parts=(vector,), groups="buckets", **options)
