"""Token files: ids of the tokenizer itself, round trips of the grammar, starts over all documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from geolantern.llm import tokens
from geolantern.session import scratch_path

TEXTS = [
    None, "", " ", "  ", "plain words here", "a  b   c \n d", "  lead and trail  ", " \n\n x  y\t z", "don't  'll 12 3 it's!",
    "über., naïve,, x%%% <|endoftext|>. a<|endoftext|> b", "a\x1c b\x85 c\xa0 d", "é😀  x", "\0 \0", "word, " * 3000, "zzz" * 20_000,
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokens.vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_the_tokenizer(plain):
    encode = tokens.Encoder(tokens.vocabulary())
    for text, ids in zip(TEXTS, encode(TEXTS)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), text[:40]
    assert encode(TEXTS[::-1]) == encode(TEXTS)[::-1]


def test_known_words_in_new_company_are_not_learnt_again(monkeypatch):
    encode = tokens.Encoder(tokens.vocabulary())
    encode([" one zwölf Один 12 (", "One,", "a\nOne.", "Один"])
    learnt = []
    monkeypatch.setattr(encode, "learn", learnt.extend)
    encode(["One one,\nOne (One. Один, zwölf.\nOne 12,", "Один zwölf, one"])
    assert learnt == []


def test_ids_of_mixed_characters(plain):
    parts = [*" \n\t'.,!_(5²ⅷaBßжΩ字ªʰกำ\u0301\u0650\u200b\0\r\x0b\x1c\x85\xa0\u2003\u2028\u3000😀\U00010400\U0001e900", "  ", "\n\n", "the", "'s", "'ll", "--", "42",
             "<|endoftext|>", "<|"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(2_000)]
    got = tokens.Encoder(tokens.vocabulary())(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == list(map(plain, texts))


def test_blocks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 10)
    texts = ["", None, "abcd", "ü" * 3, "x" * 40, "", "y" * 11, "z", "z" * 9, "z"]
    cut = [b.column(1).to_pylist() for b in tokens.blocks(pa.record_batch({"doc_id": list(range(10)), "text": texts}))]
    assert cut == [["", None, "abcd", "ü" * 3], ["x" * 40], [""], ["y" * 11], ["z", "z" * 9], ["z"]]


def test_round_trip():
    rng = random.Random(1)
    docs = [[rng.randrange(5) for _ in range(rng.randrange(0, 400))] for _ in range(60)] + [[7] * 1000, [], [1, 1, 1], [50_256]]
    packed = tokens.pack([np.array(d, "<u4").tobytes() for d in docs], 11)
    shard = tokens.Shard(packed)
    assert [x.tolist() for x in shard.documents()] == docs
    assert all(shard.document(i).tolist() == d for i, d in enumerate(docs))
    assert shard.starts.tolist() == [11 + sum(map(len, docs[:i])) for i in range(len(docs))]
    assert len(shard.left) > 0 and len(shard.symbols) < sum(map(len, docs)) / 2
    for i in range(len(shard.left)):
        whole = shard.expand(np.array([shard.first + i], dtype="<u4"))
        assert len(whole) == shard.lengths[i]
    assert tokens.Shard(tokens.pack([], 0)).documents()[0].tolist() == []


def test_files(spark, plain):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(97, "plain"), (97, "plain"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int").repartition(4)
    path = scratch_path(spark, "tokens")
    tokens.write(docs, path)
    got = [tuple(r) for r in tokens.digest(spark, path).collect()]
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_no_documents(spark):
    path = scratch_path(spark, "tokens")
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokens.digest(spark, path).count() == 0
