"""Toxicity and quality: held-out accuracy on made-up text, and rows no classifier can learn from."""

import random

import pytest
from pyspark.sql import functions as F

from geolantern.llm import quality, toxicity
from geolantern.llm.common import fold, labelled_sample

SYLLABLES = ["an", "ther", "on", "ing", "ed", "est", "ou", "ly", "ble", "sh", "re", "ha"]
SCHEMA = "doc_id long, text string, lang string, score double"


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def corpus(n, seed):
    """Documents, their toxicity (a slur now and then) and quality (marks after every word)."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randrange(20, 200))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["scoundrel", "wretched,", "nitwit", "Buffoon"])
        if not good:
            words = [w + rng.choice(["%%%", "***", "!!"]) for w in words]
        docs.append((i, " ".join(words), "en", 0.5))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(900, 3)
    docs += [(5, docs[5][1], "en", 0.1), (2000, None, "en", 0.1), (2001, "", None, None), (2002, "long " * 60_000, "en", 0.0), (None, docs[0][1], "x", 0.0)]
    labels += [(5, 1, 0), (7, None, None), (None, 1, 1), (4000, 1, 1), (2000, 0, 1), (9, 7, 9)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def scored(module, tables, column, parts, without, rows):
    docs, labels = tables
    sample, prior = labelled_sample(docs, labels, column, fold(F.col("doc_id"), parts) != without, rows)
    return module.score(docs, module.fit(sample, prior))


@pytest.mark.parametrize(("module", "column", "parts", "without", "cut", "rows"), [
    (toxicity, "toxic", 5, 0, 0.5, {1: 2000, 0: 6000}), (quality, "quality", 4, 2, 0.7, quality.ROWS)])
def test_held_out(tables, module, column, parts, without, cut, rows):
    got = scored(module, tables, column, parts, without, rows).withColumn("held", fold(F.col("doc_id"), parts) == without).collect()
    assert len(got) == 905 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: (i % 4 == 0 if column == "toxic" else i % 3 != 0) for i in range(900)}
    held = [(r["score"] >= cut, truth[r["doc_id"]]) for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    same = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nothing_to_learn(spark, module):
    docs = spark.createDataFrame([(1, "a b", "en", 0.0), (2, None, "en", 0.0)], SCHEMA)
    for labels in ([], [(1, 1, 1)], [(1, None, None)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        sample, prior = labelled_sample(docs, table, "toxic", F.lit(True), {1: 10, 0: 10})
        got = module.score(docs, module.fit(sample, prior)).collect()
        assert len(got) == 2 and all(abs(r["score"] - prior) < 1e-3 for r in got)
    assert module.score(docs.limit(0), module.fit(sample, prior)).count() == 0


def test_sample_is_bounded(tables):
    docs, labels = tables
    sample, prior = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, {1: 20, 0: 30})
    assert sorted(r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()) == [20, 30]
    assert 0.2 < prior < 0.3


def test_slots_of_features():
    f = quality.Features()
    slots, counts = f.of("ab ab ab")
    again, _ = f.of(" ab\tab\nab")
    assert slots.tolist() == again.tolist() and counts.max() >= 3
    assert f.of("")[0].size == 0 and f.of(None)[0].size == 0


def test_quality_does_not_depend_on_neighbours():
    import numpy as np

    from geolantern.llm import quality

    table = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    score = quality.Model(table.tobytes(), 0.1).scorer()
    texts = ["alpha beta", "gamma alpha beta", "beta", "", "alpha beta alpha", "x " * 50]
    alone = [float(score([t])[0]) for t in texts]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        assert dict(zip(order, np.round(score(order), 9))) == dict(zip(texts, np.round(alone, 9)))


def test_quality_scores_where_executors_have_no_copy(tmp_path):
    """A driver that finds the library, and workers that do not."""
    import os
    import subprocess
    import sys

    script = tmp_path / "run.py"
    script.write_text("""
import os, sys
root = os.environ.pop("LIBRARY")
sys.path.insert(0, root)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import numpy as np
from geolantern.llm import quality
docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
model = quality.Model(np.ones(1 << quality.BITS, dtype=np.float32).tobytes(), 0.0)
print("RESULT", [round(r.score, 3) for r in quality.score(docs, model).orderBy("doc_id").collect()])
""")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"LIBRARY": root}
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300, env=env, cwd=str(tmp_path))
    assert "RESULT [0.731, 0.5]" in out.stdout, out.stderr[-2000:]
