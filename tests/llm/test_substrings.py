"""Substring dedup and its index against plain counting."""

import random
from collections import Counter

import numpy as np

from geolantern.llm import substrings
from geolantern.llm.fmindex import FMIndex

SCHEMA = "doc_id long, text string, kept int, g long"
SPACES = " \t\n\x0b\x0c\r"


def brute(rows, window=35):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), kept.decode()))
    return out


def compare(spark, rows, **how):
    found = substrings.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows, **how), key=key)


def corpus(rng, n=120):
    vocabulary = [f"w{i}" for i in range(400)] + ["é", " x", "A", "a"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(k) for k in (34, 35, 36, 50, 120, 300)]
    rows = []
    for i in range(n):
        words = text(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if rng.random() < 0.1 and rows:
            words = (rows[-1][1] or "").split()
        rows.append((i, rng.choice(SPACES).join(words), 1, 2))
    return rows


def test_shared_passages(spark):
    compare(spark, corpus(random.Random(7)))


def test_heavy_grams_go_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 2)
    monkeypatch.setattr(substrings, "SHARD", 40)
    compare(spark, corpus(random.Random(8)))


def test_nulls_repeats_within_a_text_and_equal_rows(spark):
    once = " ".join(f"u{i}" for i in range(50))
    rows = [(None, None, 0, 0), (None, "", 0, 0), (1, "ha " * 200, 0, 0), (2, "x", 0, 0), (3, " ".join(["a b"] * 17) + " c", 0, 0)]
    rows += [(4, once, 0, 0)] * 3 + [(5, "k" * 100_000 + " " + " ".join(f"v{i}" for i in range(40)), 0, 0)]
    rows += [(None, " ".join(f"n{i} m" for i in range(40)), 0, 0), (None, " ".join(f"n{i} m" for i in range(39)), 0, 0)]
    compare(spark, rows)


def test_a_long_text_in_slices(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"t{rng.randrange(5000)}" for _ in range(40_000)]
    words[30_000:30_090] = words[100:190]
    hasher = substrings.Hasher()
    whole, _ = hasher.words(np.frombuffer(" ".join(words).encode(), dtype=np.uint8))
    monkeypatch.setattr(substrings, "SLICE", 1000)
    assert (hasher.long_words(" ".join(words).encode()) == whole).all()
    compare(spark, [(1, " ".join(words), 0, 0)])


def test_other_window_and_empty_table(spark):
    compare(spark, corpus(random.Random(10), 40), window=12)
    assert substrings.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_counts_windows():
    rng = random.Random(11)
    for sigma in (2, 5, 300):
        segments = [np.array([rng.randrange(sigma) for _ in range(rng.randrange(6, 14))], dtype=np.uint64) for _ in range(60)]
        weights = [rng.choice([1, 1, 1, 2]) for _ in segments]
        seen = Counter()
        for s, w in zip(segments, weights):
            for i in range(len(s) - 5):
                seen[tuple(s[i:i + 6])] += w
        mask = FMIndex(segments, weights, 14).repeated(6)
        for s, m in zip(segments, mask.tolist()):
            assert m == sum((seen[tuple(s[i:i + 6])] > 1) << i for i in range(len(s) - 5))
