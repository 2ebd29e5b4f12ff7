"""Profiles of a point table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import KM_PER_DEGREE
from ..functions.geo import bbox_stats
from ..session import materialize

_BINS = 4096
# Distinct values of one narrowed range that may be ranked on the driver.
_FEW = 100_000
# A sketch's error in ranks is at most the number of rows over this.
_SKETCH = 10_000


def order_statistics(df: DataFrame, targets: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """Exact value of the r-th smallest (from 1) of a double column, for all targets.

    ``df`` is read twice: for a mergeable sketch, whose neighbouring quantiles enclose each
    rank, and for the counts of the values between them, which are written. The rank is
    found among those, a few rows in ten thousand. A rank that the sketch failed to enclose is
    looked for in the whole range. NULLs do not count; nothing is sorted.
    """
    columns = sorted({c for c, _ in targets})
    counts = df.agg(*[F.count(c).alias(c) for c in columns], *[
        F.percentile_approx(c, [i / _BINS for i in range(_BINS + 1)], _SKETCH).alias(f"{c}|marks") for c in columns]).first()
    spans = {}
    for column, rank in targets:
        n, marks = counts[column], counts[f"{column}|marks"]
        if not 1 <= rank <= n:
            raise ValueError(f"{column} has no value of rank {rank}")
        slack = n / _SKETCH + 1
        low, high = int((rank - slack) / n * _BINS), int((rank + slack) / n * _BINS) + 1
        spans[column, rank] = marks[low] if low > 0 else None, marks[high] if high < _BINS else None
    found, left = _enclosed(df, spans)
    if left:
        found |= _enclosed(df, {t: (None, None) for t in left})[0]
    return found


def _enclosed(df: DataFrame, spans: dict[tuple[str, int], tuple]) -> tuple[dict[tuple[str, int], float], list]:
    """The targets found between the given ends (None: none), by one read of ``df``, and those that are not there."""
    names, picks = list(spans), []
    for i, (column, rank) in enumerate(names):
        (low, high), value = spans[column, rank], F.col(column)
        place = F.when(value < F.lit(low), F.lit(None)).otherwise(value) if low is not None else value
        inside = value.isNotNull() if high is None else value <= F.lit(high)
        picks.append(F.when(inside, F.struct(F.lit(i).alias("t"), place.alias("v"))))
    rows = df.select(F.explode(F.array_compact(F.array(*picks))).alias("p")).select("p.*")
    stored = materialize(rows.groupBy("t", "v").agg(F.count("*").alias("n")), "profile-values")
    below = {r["t"]: r["n"] for r in stored.where("v IS NULL").collect()}  # one row per target
    stored = stored.where("v IS NOT NULL")
    ends = {r["t"]: r for r in stored.groupBy("t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n")).collect()}
    state, left = {}, []
    for i, target in enumerate(names):
        rank = target[1] - below.get(i, 0)
        if i in ends and 1 <= rank <= ends[i]["n"]:
            state[i] = ends[i]["lo"], ends[i]["hi"], rank
        else:
            left.append(target)
    return {names[i]: v for i, v in _ranked(stored, state).items()}, left


def _ranked(values: DataFrame, state: dict[int, tuple]) -> dict[int, float]:
    """Of values (t, v, n), n times each, the one of each target's rank within its range (lo, hi, rank).

    Ranges are narrowed by counts in equal-width bins until they hold few distinct values.
    """
    found, state = {}, dict(state)
    while True:
        for t, (lo, hi, _) in list(state.items()):
            if lo == hi:
                found[t] = lo
                del state[t]
        if not state:
            return found

        def within():
            inside, at = F.lit(False), F.lit(0)
            for t, (lo, hi, _) in state.items():
                inside = inside | ((F.col("t") == t) & F.col("v").between(F.lit(lo), F.lit(hi)))
                width = (hi - lo) / _BINS
                place = F.least(F.lit(_BINS - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(width or 1.0)).cast("int"))
                at = F.when(F.col("t") == t, place).otherwise(at)
            return values.where(inside).withColumn("bin", at)

        few = within().limit(_FEW + 1).collect()
        if len(few) <= _FEW:
            for row in sorted(few, key=lambda r: (r["t"], r["v"])):
                t = row["t"]
                if t not in found:
                    lo, hi, rank = state[t]
                    if rank <= row["n"]:
                        found[t] = row["v"]
                    state[t] = lo, hi, rank - row["n"]
            return found
        bins = within().groupBy("t", "bin").agg(
            F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("t", "bin").collect()  # at most _BINS rows per target
        for t in list(state):
            rank = state[t][2]
            for row in (r for r in bins if r["t"] == t):
                if rank <= row["n"]:
                    state[t] = row["lo"], row["hi"], rank
                    break
                rank -= row["n"]


def numeric_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, median, min and max of every double column, one row per column."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    stats = {"mean": F.avg, "min": F.min, "max": F.max, "n": F.count}
    row = df.agg(*[fn(c).alias(f"{c}|{s}") for c in columns for s, fn in stats.items()],
                 *[F.percentile_approx(c, 0.5).alias(f"{c}|about") for c in columns]).first()
    targets = [(c, r) for c in columns for r in {(row[f"{c}|n"] + 1) // 2, row[f"{c}|n"] // 2 + 1} if row[f"{c}|n"]]
    exact = {} if approximate else order_statistics(df, targets)
    out = []
    for c in columns:
        middle = [v for (name, _), v in exact.items() if name == c]
        median = row[f"{c}|about"] if approximate else (sum(middle) / len(middle) if middle else None)
        out.append((c, row[f"{c}|mean"], median, row[f"{c}|min"], row[f"{c}|max"]))
    return df.sparkSession.createDataFrame(out, "column string, mean double, median double, min double, max double")


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names and types, with the shape of the table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    listing = df.sparkSession.createDataFrame(rows, "position int, column string, type string")
    size = df.agg(F.count("*").alias("n")).scalar()
    return listing.withColumns({"rows": size, "columns": F.lit(len(rows))})


def dataset_facts(points: DataFrame) -> DataFrame:
    """Row count, extent in degrees and kilometres, area and density; one row."""
    box = bbox_stats(points).select("south", "north", "west", "east", "mean_lat")
    count = points.agg(F.count("*").alias("n")).scalar()
    facts = box.withColumn("row_count", count).withColumns({
        "ns_km": (F.col("north") - F.col("south")) * KM_PER_DEGREE,
        "ew_km": (F.col("east") - F.col("west")) * KM_PER_DEGREE * F.cos(F.radians("mean_lat")),
    }).withColumn("area_km2", F.col("ns_km") * F.col("ew_km"))
    density = F.when(F.col("area_km2") > 0, F.col("row_count") / F.col("area_km2")).otherwise(F.lit(float("nan")))
    return facts.withColumn("rows_per_km2", density)


def tag_frequency(points: DataFrame, by: tuple[str, ...] = ("key",), top: int | None = 50) -> DataFrame:
    """Tag counts by key, value or both; the ``top`` most frequent, names break ties."""
    counts = points.select(F.explode("tags").alias("key", "value")).groupBy(*by).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), *by).limit(top)
