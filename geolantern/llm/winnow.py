"""Benchmark decontamination by winnowing, in DataFrame operations only.

A document keeps the k-gram hashes that are smallest in some run of consecutive k-grams, so
every span of ``window`` words that it shares with a benchmark item holds a kept hash of both.
Kept hashes are joined with those of the items; around each hit the windows that hold the
k-gram are compared in full, so neither hash collisions nor short overlaps count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import is_small, materialize
from .common import lower_ascii, text_key

#: All characters but the ASCII ones that are no digits or small letters. Java takes some nine times as long for the same
#: class written as a negated one.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: The same words before A-Z are lower-cased.
ANY_CASE = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"
WINDOW, K = 10, 5
#: Most rows of benchmark hashes (8 bytes each) and of benchmark windows that are broadcast.
HASHES_SENT, SPANS_SENT = 1_000_000, 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _indices(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _gram(tokens: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(tokens, at + j) for j in range(k)])


def kept(df: DataFrame, k: int, run: int) -> DataFrame:
    """``df(.., tokens)`` with ``kept``: array of (h, at, near) of the k-grams that winnowing keeps.

    ``near`` are the words of all runs that the k-gram is part of, ``at`` its place.

    ``run``: k-grams in a winnowing window. A k-gram is kept if it is the smallest of a full
    run that it is part of (all of several equal ones), that is, if the largest of the minima
    of its runs is itself. A text with fewer k-grams than a run keeps none: it has no shared
    span of that length.
    """
    hashes = F.transform(_indices(F.size("tokens") - (k - 1)), lambda i: _gram(F.col("tokens"), i, k))

    def entry(h, i):
        from_ = F.greatest(i - (run - 1), F.lit(0))
        return F.struct(h.alias("h"), i.alias("at"), F.slice("tokens", from_ + 1, i - from_ + k + run - 1).alias("near"))

    df = df.withColumn("grams", hashes)
    if run == 1:
        return df.withColumn("kept", F.transform("grams", entry)).drop("grams")
    minima = F.transform(
        _indices(F.size("grams") - (run - 1)), lambda i: F.least(*[F.get(F.col("grams"), i + j) for j in range(run)])
    )
    smallest = lambda i: F.greatest(*[F.get(F.col("minima"), i - j) for j in range(run)])
    marked = F.transform("grams", lambda h, i: F.when(h == smallest(i), entry(h, i)))
    return df.withColumn("minima", minima).withColumn("kept", F.filter(marked, lambda x: x.isNotNull())).drop("grams", "minima")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side of a checked size; a larger one is joined by shuffling."""
    return F.broadcast(df) if is_small(df, rows) else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted item_ids as strings).

    An item window is ``window`` consecutive words of an item; an item with fewer words, but
    not none, is one window. A document word inside any occurrence of a window is hit. NULL
    texts have no words; items with a NULL id give hits but are not listed. Equal rows share
    their result. ``benchmark`` may be large: its hashes are broadcast only below a checked size.
    """
    if not 1 < k < window:
        raise ValueError("k must lie between 1 and the window")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("tokens")).where(
        F.size("tokens") > 0)
    items = materialize(items.withColumn("len", F.least(F.size("tokens"), F.lit(window))), "winnow-items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # at most `window` values

    spans = items.select("item", "len", F.explode_outer(F.transform(
        _indices(F.size("tokens") - F.col("len") + 1), lambda i: F.array_join(F.slice("tokens", i + 1, F.col("len")), " ")
    )).alias("span"))
    spans = materialize(spans.groupBy("span", "len").agg(F.collect_set("item").alias("items")), "winnow-spans")

    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    tokens = keyed.select("doc_id", "key", words(F.col("text")).alias("tokens"))

    def windows(length: int) -> DataFrame:
        """(doc_id, key, s, len, span): windows around k-grams shared with an item of this length class."""
        size, run = (k, window - k + 1) if length == window else (length, 1)
        wanted = kept(items.where(F.col("len") == length), size, run).select(
            F.explode_outer("kept.h").alias("h")).where("h IS NOT NULL").distinct()
        # Outer: explode() would have the optimizer push its own filter, with all of this inlined, to the scan.
        found = kept(tokens, size, run).select("doc_id", "key", F.explode_outer("kept").alias("x"))
        found = found.select("doc_id", "key", F.col("x.h").alias("h"), F.col("x.at").alias("at"), F.col("x.near").alias("near"))
        met = found.join(_sized(wanted, HASHES_SENT), "h", "left_semi")
        # Extend the hit: all windows in its neighbourhood, compared in full by the join that follows.
        first = F.greatest(F.col("at") - (run - 1), F.lit(0))
        around = F.transform(_indices(F.size("near") - (length - 1)), lambda i: F.struct(
            (first + i).alias("s"), F.array_join(F.slice("near", i + 1, length), " ").alias("span")))
        return met.select("doc_id", "key", F.explode(around).alias("x")).select(
            "doc_id", "key", F.col("x.s").alias("s"), F.lit(length).alias("len"), F.col("x.span").alias("span"))

    none = keyed.where("false").select("doc_id", "key", F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit("").alias("span"))
    near = reduce(DataFrame.unionByName, [windows(n) for n in lengths], none)
    met = near.distinct().join(_sized(spans, SPANS_SENT), ["span", "len"])
    hit = met.groupBy("doc_id", "key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("s", F.col("s") + F.col("len") - 1))))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    rows = keyed.select("doc_id", "key", F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).alias("n_words"))
    return rows.join(hit.withColumnRenamed("doc_id", "d").withColumnRenamed("key", "y"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("y")), "left").select(
        "doc_id", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "key",
    ).withColumn("n_items", F.size("items").cast("long"))
