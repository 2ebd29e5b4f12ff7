"""Targets against the stepwise rule, running totals against plain code, positions against the schedule."""

import hashlib
import random
import re

import pytest

from geolantern.llm import mixing


def target_brute(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    open_ = set(names)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.remove(s)
    return target


def rows():
    rng = random.Random(8)
    out = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "a", "b", "B", "é", "z", None])) for i in range(900)]
    return out + [(9000, "x " * 4, "tiny"), (9001, None, "b"), (9002, "", "empty"), (5, "dup dup", "a"), (5, "dup dup", "a"), (None, "no id", "b")]


def brute(data):
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, at, out = target_brute(sizes), dict.fromkeys(sizes, 0), []
    key = lambda r: (int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, len((r[1] or "").split()))
    for d, t, s in sorted(data, key=key):
        n = len((t or "").split())
        at[s] += n
        middle = at[s] - n / 2
        out.append((d, n, sizes[s], round(target[s], 6), n * sum(middle + p * sizes[s] <= target[s] + 1e-9 for p in range(3))))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_mix(spark, parts):
    data = rows()
    docs = spark.createDataFrame([(*r, 3, "x") for r in data], "doc_id long, text string, source string, size int, target string").repartition(parts)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str((*r[:3], round(r[3], 6), r[4])) for r in got) == sorted(map(str, brute(data)))
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(x) - target) <= 60 for (_, target), x in by.items())


def test_positions(spark):
    docs = spark.createDataFrame([(i, "one two three", s) for i in range(300) for s in "abc"], "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    assert all(0 <= p <= 1 for r in mixed for p in r["positions"])
    half = {s: sum(p < 0.5 for r in mixed if r["source"] == s for p in r["positions"]) / sum(len(r["positions"]) for r in mixed if r["source"] == s) for s in "abc"}
    assert half["a"] == pytest.approx(0.625, abs=0.02) and half["b"] == pytest.approx(0.5, abs=0.02) and half["c"] == pytest.approx(0.375, abs=0.02)


def test_training_order(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    got = mixing.training_order(docs, mixed)
    assert got.columns == docs.columns
    want = {}
    for r in mixed.collect():
        want[r["doc_id"], r["size"]] = want.get((r["doc_id"], r["size"]), 0) + r["copies"]
    seen = {}
    for r in got.collect():
        seen[r["doc_id"], len((r["text"] or "").split())] = seen.get((r["doc_id"], len((r["text"] or "").split())), 0) + 1
    assert seen == {k: v for k, v in want.items() if v}


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.training_order(docs, mixing.mix(docs)).count() == 0
