"""The pipeline against plain code over the same stages, on a small corpus."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from geolantern.llm import simhash, tokens
from geolantern.llm.queries import toxicity_model
from tests.llm.test_classifiers import corpus
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_text_operators import contamination_brute

BENCH = [(1, "seven little words are not quite enough here but these twelve are"), (2, "short item"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    docs, labels = corpus(400, 4)
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t)) for i, t, *_ in docs]
    rows += [(1000 + i, rows[i][1] + (" " if i % 2 else ""), "en", "a", 1) for i in range(0, 60, 3)]
    rows += [(2000, "x " + BENCH[0][1], "en", "b", 5), (2001, "a short item it is", "en", "c", 5), (2002, None, None, None, None), (2003, "", "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    features, score = toxicity_model(docs, spark.read.parquet(f"{path}/labels.parquet")).scorer()
    kept = [r for r in rows if score(features(r[1])) < 0.5]
    assert len(kept) < len(rows) - 50
    prints = [simhash.fingerprint(r[1]) for r in kept]
    root = list(range(len(kept)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(kept):
        if r[0] < best.get(top(i), (1 << 62,))[0]:
            best[top(i)] = r
    unique = list(best.values())
    assert len(unique) < len(kept)
    hits = {eval(x)[0] for x in contamination_brute([(r[0], r[1]) for r in unique], BENCH) if eval(x)[2]}
    clean = [r for r in unique if r[0] not in hits]
    assert {2000, 2001} & {r[0] for r in unique} <= hits
    copies = {x[0]: x[4] // x[1] for x in mix_brute([(r[0], r[1], r[3]) for r in clean]) if x[1]}
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(tokens.vocabulary())
    at, want = 0, []
    for r in sorted(clean, key=lambda r: r[0]):
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for _ in range(copies.get(r[0], 0)):
            want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = corpus_pipeline.run(spark, path)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
    assert re.fullmatch("toxicity|.*", corpus_pipeline.STAGES[0][0])


def test_near_copies_of_rows_without_or_with_shared_ids(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " "), (None, texts[2]), (9, texts[2]), (None, texts[0])]
    rows += [(5, texts[3]), (5, texts[4]), (3, texts[4]), (7, texts[5]), (7, texts[5]), (7, texts[5])]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r[0] or 0, r[1].strip()) for r in got.collect()))
    assert kept == sorted([(0, texts[0]), (0, texts[1]), (9, texts[2]), (5, texts[3]), (3, texts[4]), (7, texts[5])])
