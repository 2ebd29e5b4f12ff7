"""Edit embeddings: shared fingerprints, order of documents, likeness, linked near-duplicates."""

import hashlib
import random

import pytest

from geolantern.llm import edits

ROWS = [(5, "abc " * 40), (3, None), (9, ""), (4, "é😀x" * 9000), (None, "last"), (7, "abc " * 40), (7, "zz top"), (1, "a")]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    out = []
    for i, (doc_id, _) in enumerate(order):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *edits.fingerprints([text, changed, after])))
    return out


def test_rows_and_next(spark):
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in ROWS], "doc_id long, text string, part string, fingerprint double")
    got = edits.with_next(docs.repartition(3)).collect()
    want = expected(ROWS)
    assert sorted(map(str, ((*r[:5],) for r in got))) == sorted(str(w[:5]) for w in want)
    near = {(r["doc_id"], r["fingerprint"]): (r["near_edited"], r["near_next"]) for r in got}
    for doc_id, _, _, own, changed, after in want:
        assert near[doc_id, own] == (edits.likeness(own, changed), edits.likeness(own, after))


def test_rows_of_one_id_in_many_ranges(spark):
    """Texts of one id, of none, and some that differ only after the part that ranges go by."""
    rng = random.Random(8)
    rows = [(d, rng.choice("é😀ab") * rng.randrange(90) + str(i)) for i, d in enumerate([7] * 60 + [None] * 60 + [3, 9])]
    rows += [(7, "same beginning " * 10 + str(i % 5)) for i in range(20)] + [(7, ""), (7, None), (None, None)]
    got = edits.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = expected(rows)
    assert sorted(str((*r[:5],)) for r in got) == sorted(str(w[:5]) for w in want)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert edits.with_next(empty).count() == 0 and edits.near_duplicates(empty).count() == 0
    row = edits.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1.0


def test_likeness():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(20_000))
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(20_000))
    edit = text[:9000] + "X" + text[9001:15_000] + text[15_001:]
    a, b, c = edits.fingerprints([text, edit, other])
    assert edits.fingerprints([text])[0] == a
    assert edits.likeness(a, b) > 0.8 and edits.likeness(a, c) < 0.1 and edits.likeness(a, a) == 1.0
    longer = edits.fingerprints([text + "y" * 30_000])[0]
    assert 0.2 < edits.likeness(a, longer) < 1


def shifted(size, shift, front, many):
    """Likeness of texts to copies with other characters put in, and whether their bands meet."""
    rng = random.Random(size + shift)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    near, met = [], []
    for _ in range(many):
        text = " ".join(rng.choice(words) for _ in range(size // 4))[:size]
        more = "".join(rng.choice("ABCDEFGH ") for _ in range(shift))
        at = 0 if front else rng.randrange(size)
        a, b = edits.fingerprints([text, text[:at] + more + text[at:]])
        near.append(edits.likeness(a, b))
        met.append(bool(set(edits.bands(a)) & set(edits.bands(b))))
    return near, met


@pytest.mark.parametrize("size, many", [(2_000, 24), (20_000, 12), (100_000, 6)])
@pytest.mark.parametrize("shift", [20, 100])
def test_headers_in_front(size, many, shift):
    near, met = shifted(size, shift, True, many)
    assert sum(x >= 0.8 for x in near) >= 0.9 * many, near
    assert all(m for x, m in zip(near, met) if x >= 0.8)


@pytest.mark.parametrize("size, shift, many", [(20_000, 20, 12), (100_000, 100, 6)])
def test_insertions_anywhere(size, shift, many):
    near, met = shifted(size, shift, False, many)
    assert sum(x >= 0.8 for x in near) >= 0.9 * many, near
    assert all(m for x, m in zip(near, met) if x >= 0.8)


def test_prints_do_not_depend_on_neighbours():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc é😀\n") for _ in range(n)) for n in (0, 1, 2, 8, 11, 12, 40, 300, 5000, 70_000)]
    alone = [edits.fingerprints([t])[0] for t in texts]
    assert edits.fingerprints(texts) == alone and edits.fingerprints(texts[::-1]) == alone[::-1]
    assert edits.fingerprints(texts * 9) == alone * 9
    assert [edits.likeness(a, a) for a in alone] == [1.0] * len(alone)


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(3000)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:1500] + "#" + t[1501:]) for i, t in enumerate(base[:2])]
    rows += [(20, base[0]), (30, None), (31, "")]
    got = edits.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["component"] for r in got}
    assert len(got) == len(rows) and all(by[i] == by[10 + i] for i in range(2)) and by[0] == by[20] and by[30] == by[31]
    assert len(set(by.values())) == 5
