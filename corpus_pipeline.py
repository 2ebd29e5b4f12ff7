"""A training corpus from raw documents: the stages and a run over them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolantern.llm import mixing, simhash, tokens, toxicity, winnow
from geolantern.llm.common import read, text_key
from geolantern.llm.queries import toxicity_model
from geolantern.session import materialize, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, tuple(docs.columns)).where("score < 0.5").drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id (NULL last) and text key."""
    kept = materialize(simhash.representatives(simhash.near_duplicates(docs)), "simhash-kept")
    return first_rows(docs, kept)


def first_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows with the doc_id and text key of ``kept(doc_id, key, n)``, one of those equal in both.

    Only rows that ``n`` counts more than once are grouped, combined before the exchange.
    """
    ids = kept.select(F.col("doc_id").alias("__id"), F.col("key").alias("__kept"), "n")
    keyed = docs.withColumn("__key", text_key())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__kept"))
    once = keyed.join(ids.where("n = 1"), same, "left_semi").drop("__key")
    several = keyed.join(ids.where("n > 1"), same, "left_semi").groupBy("doc_id", "__key").agg(
        F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("__row"))
    return once.unionByName(several.select("doc_id", "__row.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    hit = winnow.contamination(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("__hit")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and what is read back from them."""
    path = scratch_path(spark, "pipeline-token-files")
    tokens.write(docs, path)
    return tokens.digest(spark, path)


STAGES = [
    ("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("decontamination", drop_contaminated),
    ("mixing", mix_sources), ("tokens", write_tokens),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
