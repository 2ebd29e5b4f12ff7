"""Conversation repair against a search over all edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from geolantern.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def text_of(value):
    return " " if value is None else str(value)


def brute(rows):
    out, convs = [], {}
    for conv, turn, role, text, _ in rows:
        kept = convs.setdefault(conv, [])
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        # Dijkstra over (row, roles so far), with the least audit first among equal costs.
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, tail, repaired = heapq.heappop(heap)
            if i == len(kept) and tail in ("", "a"):
                break
            if (i, tail) in done:
                continue
            done.add((i, tail))
            turns_to = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
            for r in turns_to.replace("s", ""):
                heapq.heappush(heap, (cost + 3, audit + "I", i, r, repaired + (({"u": "user", "a": "assistant"}[r]) + ":",)))
            if i < len(kept):
                _, role, text = kept[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, tail, repaired))
                if faults[i] not in ("b", "d"):
                    more = 3 if faults[i] == "t" else 0
                    if role[:1] and role[:1] in turns_to:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], repaired + (role + ":" + text,)))
                    for r in turns_to.replace("s", ""):
                        name = {"u": "user", "a": "assistant"}[r]
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, r, repaired + (name + ":" + text,)))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                    hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def compare(spark, rows):
    found = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert ordered(found) == ordered(brute(rows))


def test_random_conversations(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "Why?", "", " \t", "Well then.", "so", "é!", " "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "User", ""]
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 2]) + 100 * turn, rng.choice(roles), rng.choice(texts) + rng.choice(["", str(turn) + "."]), turn))
    compare(spark, rows)


def test_nulls_long_conversations_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(None, t, rng.choice(["user", "assistant", None]), rng.choice(["One.", None, f"{t} two."]), 0) for t in range(3000)]
    rows += [(7, None, "user", "Hm.", 1), (7, None, "assistant", "Ah.", 1), (7, 1, "user", "Hm.", 1)] * 2
    rows += [(8, None, None, None, 0), (9, 5, "assistant", "Only.", 0)] + [(10, 3, "user", "x" * 200_000 + "\n", 0)] * 3
    compare(spark, rows)


def test_a_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = conversations.repair(spark.createDataFrame([(conv, 0, "user", "Hi.", 0)], SCHEMA)).first()
    assert tuple(found) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffixes_are_shared(monkeypatch):
    made = []

    class Counting(conversations.Node):
        def __init__(self, letter, after):
            made.append(letter)
            super().__init__(letter, after)

    a = Counting(None, None)
    assert a.cost == [0, 6, 3, 0] and a.audit() == ""


@pytest.mark.parametrize("letters, cost, audit", [
    ("ei", 0, "KK"), ("i", 3, "IK"), ("e", 3, "KI"), ("", 0, ""), ("b", 4, "D"), ("aei", 4, "DKK"), ("hl", 6, "KK")])
def test_small_repairs(letters, cost, audit):
    names = {"e": "i", "i": "m", "b": "f", "a": "b", "h": "l", "l": "p"}  # e: user ok, i: assistant ok, b: blank, h, l: truncated
    node = conversations.Node(None, None)
    for x in reversed(letters):
        node = conversations.Node(names[x], node)
    assert (node.cost[0], node.audit()) == (cost, audit)
