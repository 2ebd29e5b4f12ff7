"""Reproducible sampling of reference points, donor tags and training batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PRIORITY_KEYS
from ..functions.tags import priority_tag
from ..session import BROADCAST_ROWS

HASH_BUCKETS = 4096


def portable_hash(seed: int, *columns) -> Column:
    """48 bits of an MD5: equal in every engine."""
    text = F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def sample_with_replacement(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """min(n, rows) uniform draws with replacement, numbered by ``draw`` from 0.

    Rows are ordered by a hash of their key. Draw i takes the row at hash(i) mod N. Only
    bucket counts are ranked globally; inside a bucket only drawn buckets are ranked.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("_h", portable_hash(seed, key))
    hashed = hashed.withColumn("_b", F.shiftright("_h", 36).cast("int"))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    # At most HASH_BUCKETS rows from here on.
    ends = counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n"))
    total = counts.agg(F.sum("_n").alias("t")).scalar()
    draws = (
        spark.range(n).withColumnRenamed("id", "draw").withColumn("_total", total)
        .where(F.col("draw") < F.col("_total"))
        .withColumn("_at", F.pmod(portable_hash(seed + 1, "draw"), F.col("_total")))
    )
    # The bucket of a draw is the last one that starts at or before it: a binary search in the bounded array of starts.
    starts = ends.where("_n > 0").agg(F.sort_array(F.collect_list(F.struct("_start", "_b"))).alias("s")).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(HASH_BUCKETS.bit_length()))])
    last = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.try_element_at("_starts", at + step)["_start"] <= F.col("_at"), F.lit(False)), at + step).otherwise(at))
    placed = draws.withColumn("_starts", starts).withColumn("_in", F.element_at("_starts", last)).select(
        "draw", F.col("_in._b").alias("_b"), (F.col("_at") - F.col("_in._start") + 1).alias("_i"))
    hint = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    # At most HASH_BUCKETS distinct buckets, at most n placed draws.
    drawn = hashed.join(F.broadcast(placed.select("_b").distinct()), "_b", "left_semi")
    inside = Window.partitionBy("_b").orderBy("_h", key)
    ranked = drawn.withColumn("_i", F.row_number().over(inside))
    return ranked.join(hint(placed), ["_b", "_i"]).drop("_b", "_i", "_h")


def sample_points(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Reference points of a generated workload."""
    return sample_with_replacement(points.select("id", "lat", "lon"), n, seed)


def sample_donors(points: DataFrame, n: int, seed: int = 1, keys=PRIORITY_KEYS) -> DataFrame:
    """(draw, key, value) of donors drawn from the points that have an eligible tag."""
    tagged = points.select("id", priority_tag("tags", keys).alias("kv")).where(F.col("kv").isNotNull())
    drawn = sample_with_replacement(tagged, n, seed)
    return drawn.select("draw", F.col("kv.key").alias("tag_key"), F.col("kv.value").alias("tag_value"))


def shuffled_batches(rows: DataFrame, batch_size: int, epoch: int, seed: int = 0, key: str = "id") -> DataFrame:
    """Add ``batch_id``: random batches of ``batch_size`` rows, new in every epoch.

    Rows are hashed into buckets of about 64 batches; numbering is per bucket, so only
    the last batch of a bucket is short and no global sort is needed.
    """
    total = rows.count()
    buckets = max(1, total // (batch_size * 64))
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(epoch), key))
    hashed = hashed.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    inside = Window.partitionBy("_b").orderBy("_h", key)
    number = F.floor((F.row_number().over(inside) - 1) / batch_size)
    return hashed.withColumn("batch_id", F.col("_b") * F.lit(1_000_000) + number).drop("_h", "_b")
