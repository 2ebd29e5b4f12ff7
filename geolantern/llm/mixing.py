"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral, scaled to the source's
target, is the source's cumulative demand for words; a document's place in the running total of
its source is turned into a training position by inverting that demand. A source whose target
exceeds its size is passed several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_small, materialize
from .common import text_key

WORD = r"[^\x20\x09-\x0D]+"
#: A source is passed at most so many times.
MOST_PASSES = 3
#: Weights by the order of the sources, repeating.
CYCLE = (1, 2, 3)
#: Documents in one piece of a source's running total; a piece is ordered within one task.
PIECE_ROWS = 4_000


def size(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_PASSES) -> DataFrame:
    """``sizes(source, source_size)`` with ``weight``, ``rank`` and ``target``.

    The sources, by code point and NULL last, get the weights of ``cycle`` in turn and share the
    total size by weight. A target stops at ``most`` times its source's size; what is left goes
    to the others by weight until none is above. One row per source: a table of that kind has as
    many rows as there are sources, not documents.
    """
    everything = Window.partitionBy(F.lit(0))
    by_source = everything.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle)).cast("int") + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_source) - 1).withColumn("weight", weight)
    # Sources reach their bound in the order of size per weight: `level` is the common words per
    # weight if all sources before this one stand at their bound and no other does. Too few or
    # too many at their bound both make it smaller, so the largest level is the right one.
    fill = everything.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.lit(float(most)) * F.col("source_size")
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - before(bound)) / (
        F.sum("weight").over(everything) - before("weight"))
    leveled = ranked.withColumn("bound", bound).withColumn("level", level)
    final = F.max("level").over(everything)
    return leveled.withColumn("final", final).select(
        "source", "source_size", "rank", "weight", F.least("bound", F.col("final") * F.col("weight")).alias("target"))


def slope(rank: Column) -> Column:
    """How a source's weight moves over time: falling, level or rising in turn, by up to a half.

    The weight at time t is ``1 + slope * (2 t - 1)`` times its mean, so the integral stays the target.
    """
    return F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (rank % 3).cast("int") + 1)


def position(demand: Column, target: Column, a: Column) -> Column:
    """The time t at which ``target * (t + a (t² - t))`` reaches ``demand``."""
    share = F.least(F.greatest(demand / target, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * share)
    return 2 * share / ((1 - a) + root)


def _order() -> Column:
    """A fixed shuffle of the documents, the same in any SQL engine: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST_PASSES) -> DataFrame:
    """A row per row of ``docs`` with its share in the mix.

    Columns doc_id, source, key (of the text), size, source_size, target, copies, taken (words, repeats
    counted) and positions (training positions of the copies, 0 to 1). Within a source the
    documents follow a fixed shuffle; pass p takes the document whose words end the running
    total c if ``p * source_size + c - size / 2 <= target``, so a source misses its target by at
    most half a document. Empty documents have nothing to take. Equal rows are ordered
    arbitrarily among themselves. No text is shuffled.
    """
    slim = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size(F.col("text")).alias("size"), text_key().alias("key"))
    slim = materialize(slim.withColumn("order", _order()), "mix-sizes")
    goals = materialize(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most), "mix-targets")
    pieces = max(64, -(-slim.count() // PIECE_ROWS))
    piece = F.floor(F.col("order") / (2.0 ** 60) * pieces).cast("int")
    cut = slim.withColumn("piece", piece)
    # Running totals in two steps: over the pieces of a source, a bounded table, then within a piece.
    sums = cut.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    started = sums.withColumn("start", F.coalesce(
        F.sum("words").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )).drop("words")
    started = started.withColumnRenamed("source", "s").join(
        F.broadcast(goals) if is_small(goals) else goals, F.col("s").eqNullSafe(F.col("source"))
    ).withColumnRenamed("piece", "p").drop("source")
    started = materialize(started, "mix-pieces")
    within = Window.partitionBy("source", "piece").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumn("within", F.sum("size").over(within))
    met = run.join(
        F.broadcast(started) if is_small(started) else started,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")),
    )
    middle = F.col("start") + F.col("within") - F.col("size") / 2.0
    demands = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: p * F.col("source_size") + middle),
        lambda d: (d <= F.col("target")) & (F.col("size") > 0),
    )
    a = slope(F.col("rank"))
    return met.withColumn("demands", demands).select(
        "doc_id", "source", "key", "size", "source_size", "target", F.size("demands").cast("long").alias("copies"),
        (F.size("demands") * F.col("size")).cast("long").alias("taken"),
        F.transform("demands", lambda d: position(d, F.col("target"), a)).alias("positions"),
    )


def training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, range-sorted by training position.

    ``mixed`` is the result of ``mix`` for these ``docs``. Rows that agree in doc_id, text and source
    are told apart by counting them on both sides.
    """
    row = F.xxhash64("doc_id", "__key", F.col("source").cast("string"))
    nth = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(1)))
    numbered = docs.withColumn("__key", text_key()).withColumn("__row", row).withColumn("__nth", nth)
    places = mixed.withColumnRenamed("key", "__key").withColumn("__row", row).withColumn("n", nth).where("copies > 0").select(
        F.col("__row"), F.col("doc_id").alias("__d"), F.col("n"), F.explode("positions").alias("__position"))
    met = numbered.join(places, "__row").where((F.col("n") == F.col("__nth")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    return met.select(*docs.columns, "__position").repartitionByRange("__position", "doc_id").sortWithinPartitions(
        "__position", "doc_id").drop("__position")
