"""The Merkle manifest against a plain tree, and its parts."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from geolantern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n, _ = row
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at - at % 8
        out.append((nodes[lo:at], nodes[at + 1:lo + 8]))
        at //= 8
    return out


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row, leaf(row, row[1])))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        langs[name].sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
    trees = {n: tree([x for _, x in langs[n]]) for n in names}
    upper = tree([trees[n][-1][0] for n in names])
    root, out = upper[-1][0], []
    for i, name in enumerate(names):
        for at, (row, own) in enumerate(langs[name]):
            way = path(trees[name], at) + path(upper, i)
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                node = leaf(row, row[1].translate({c: c + 32 for c in range(65, 91)}))
            for left, right in way:
                node = h([*left, node, *right])
            out.append((row[0], name, own, trees[name][-1][0], root, h(x for a, b in way for x in a + b), node, node == root))
    return out


def compare(spark, rows):
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)


def test_languages_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rng = random.Random(5)
    rows, at = [], 0
    for lang, n in (("en", 700), ("de", 64), ("fr", 65), (None, 9), ("", 1), ("é", 8), ("zz", 2)):
        for _ in range(n):
            at += rng.choice([1, 1, 3, 40_000, 2_000_000_000])
            rows.append((at, rng.choice([f"Text {at}", "", None, "lower"]), lang, rng.choice(["a", None]), rng.choice([at, None]), 1))
    compare(spark, rows)


def test_many_languages(spark):
    compare(spark, [(i, "T", f"l{i % 75}", "s", 1, 0) for i in range(150)])


def test_rows_of_one_id_or_none_and_equal_rows(spark):
    rows = [(None, f"N {i % 40}", "en", "s", 1, 0) for i in range(90)]
    rows += [(5, "Same", "en", "s", 1, 0)] * 30 + [(5, "Other", "en", "s", 1, 0), (-3, "Before", "en", "s", 1, 0), (6, "x" * 300_000, "en", None, 1, 0)]
    compare(spark, rows)


def test_one_row_and_none(spark):
    compare(spark, [(3, "Alone", "en", "s", 5, 0)])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranks_of_dense_and_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIRECTORY_BITS", 9)
    rng = random.Random(6)
    ids = {"a": rng.sample(range(-5000, 60_000), 8000), "b": [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [7] * 5}
    rows = [(g, i) for g, some in ids.items() for i in some]
    found = merkle.ranked(spark.createDataFrame(rows, "g string, id long"), "g", "id").select("g", "id", "rank", "size").collect()
    for g, some in ids.items():
        some = sorted(some)
        assert {(r["id"], r["rank"], r["size"]) for r in found if r["g"] == g} == {(x, some.index(x), len(some)) for x in some}
    assert len(found) == len(rows)


def test_leaves_hash_utf8_lengths(spark):
    row = (1, "Ünï", "de", None, None, 0)
    got = merkle.leaves(spark.createDataFrame([row], SCHEMA)).select(F.lower(F.hex("leaf"))).first()[0]
    assert got == leaf(row, row[1])
