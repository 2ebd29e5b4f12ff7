"""What the operators share: table reading, row keys, sized partitioning and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart by their text; equal rows share a key."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of an id's text, modulo ``parts``; a NULL id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, allowed: Column, rows: dict[int, int]
) -> tuple[DataFrame, float]:
    """A bounded training sample (text, label) and the share of label 1 among all allowed rows.

    ``rows`` has the most rows of each label; within a label those with the smallest hash of
    the id are taken. Only the chosen ids, at most ``sum(rows.values())``, meet the texts, so
    no text is shuffled. Labels other than 0 and 1, NULL ids and NULL texts are left out; of
    several labels of one id the largest counts.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(
        F.max(F.col(column).cast("int")).alias("label"))
    known = materialize(
        known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"), "labels"
    )
    share = known.agg(F.avg("label")).first()[0] or 0.0
    chosen = None
    for label, most in rows.items():
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "labels-chosen")
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(sample.dropDuplicates(["doc_id"]).select("text", "label"), "sample"), float(share)


#: Rows that map_arrow hands over at once.
ROWS_AT_ONCE = 512


def map_arrow(df: DataFrame, columns: list[str], schema: str, fn) -> DataFrame:
    """``fn(*lists of some rows) -> lists`` over the given columns, in the order of ``schema``.

    A batch goes through in slices, so that texts and results are held for few rows at a time.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                out = fn(*(some.column(i) for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out, types)], names=names
                )

    from pyspark.sql.pandas.types import to_arrow_type

    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    names, types, rows = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields], ROWS_AT_ONCE
    return df.select(*columns).mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): connected components of ``edges(a, b)``, root = the smallest node.

    Alternates the large-star and small-star steps; each step shuffles the edges once and is
    written to the shared folder. Minima are combined on the map side and the joins back are
    plain equi-joins, so a hub with a third of the edges is split like any skewed join.
    """
    def minima(pairs, node, other):
        return pairs.groupBy(F.col(node).alias("u")).agg(F.least(F.min(other), F.col("u")).alias("m"))

    def step(e, large: bool):
        pairs = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            pairs = pairs.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = minima(pairs, "u", "v")
        met = pairs.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    e, last = edges.select("a", "b").where("a <> b").distinct(), None
    for _ in range(max_rounds):
        e = materialize(step(step(e, True), False), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
