"""Line dedup, decontamination and HTML extraction against plain code; SimHash against all pairs."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from geolantern.llm import html, linededup, simhash, winnow

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text):
    return (text or "").translate(str.maketrans(UP, LOW))


# --- line dedup ----------------------------------------------------------------------

def line_rows():
    rng = random.Random(1)
    common = ["a very common line", "  A VERY common line\t", "short", "", "Ünïcode line ÀB", "another shared line"]
    rows = [(i, "\n".join(rng.choice([*common, f"own line number {i} {j}"]) for j in range(rng.randrange(1, 30)))) for i in range(60)]
    return [*rows, (7, "a very common line\nown text"), (7, "a very common line\nown text"), (100, None), (101, ""), (102, "\n\n"),
            (None, "a very common line\nonly here in null"), (103, "x" * 100_000 + "\n" + "x" * 100_000)]


def line_brute(rows):
    big = 1 << 63
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = folded(line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 10:
                first[k] = min(first.get(k, big), big - 1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keys = [folded(x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        keep = [x for x, k in zip(lines, keys) if len(k) < 10 or first[k] == (big - 1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, parts):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keep int").repartition(parts)
    got = linededup.digest(docs, linededup.bitmaps(docs)).collect()
    assert sorted(str(tuple(r)) for r in got) == line_brute(rows)


def test_one_line_over_many_partitions(spark):
    rows = [(i, "the same line everywhere\n" * 3 + f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.digest(docs, linededup.bitmaps(docs)).collect()
    assert sorted(str(tuple(r)) for r in got) == line_brute(rows)


def test_lines_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.digest(docs, linededup.bitmaps(docs)).count() == 0


# --- decontamination -----------------------------------------------------------------

def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def contamination_brute(rows, items):
    spans = {}
    for item, t in items:
        w = tokens(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[p:p + n]), set()).add(item)
    lengths = {len(s) for s in spans}
    out = []
    for d, t in rows:
        w, hit, found = tokens(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in spans:
                    hit |= set(range(p, p + n))
                    found |= spans[tuple(w[p:p + n])]
        out.append((d, len(w), len(hit), len(found), sorted(str(i) for i in found if i is not None)))
    return sorted(map(str, out))


def test_contamination(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "déjà", "x1", "the", "a"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(50, None), (51, "..."), (0, text(12)), (52, "single-word")]
    rows = [(i, text(rng.randrange(0, 60)) + " " + rng.choice(items)[1:][0].__str__() + " " + text(5)) for i in range(60)]
    rows += [(1, items[4][1]), (1, items[4][1]), (None, items[3][1]), (70, None), (71, ""), (72, items[5][1].upper()), (73, text(30_000))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items").collect()
    assert sorted(str(tuple(r)) for r in got) == contamination_brute(rows, items)


def test_words_are_those_of_the_negated_class_and_faster(spark):
    negated = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    anything = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000, 7), 0xFFFF, 0x10000, 0x10FFFF]]
    rng = random.Random(8)
    rows = [("".join(anything[i:i + 400]),) for i in range(0, len(anything), 400)] + [
        ("".join(rng.choices(anything[:300] + ["the", " ", "A", "\0", "😀"], k=80)),) for _ in range(300)]
    texts = spark.createDataFrame(rows, "text string")
    was = F.regexp_extract_all(winnow.lower_ascii(F.col("text")), F.lit(negated), F.lit(0))
    found = texts.select("text", was.alias("was"), winnow.words(F.col("text")).alias("tokens"),
                         F.regexp_count("text", F.lit(winnow.ANY_CASE)).alias("n")).collect()
    assert len(found) == len(rows) and all(r["was"] == r["tokens"] == re.findall(negated, folded(r["text"])) for r in found)
    assert all(r["n"] == len(r["tokens"]) for r in found)

    long = spark.createDataFrame([("the word, and Another one. " * 20_000,)] * 4, "text string").repartition(4)

    def seconds(pattern):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            long.agg(F.sum(F.regexp_count("text", F.lit(pattern)))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert max(seconds(winnow.WORD), seconds(winnow.ANY_CASE)) < seconds(negated) / 2


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(docs, none).select("n_words", "n_hit").collect() == [(3, 0)]
    assert winnow.contamination(docs.limit(0), none).count() == 0


def test_every_shared_span_is_kept(spark):
    rng = random.Random(5)
    shared = [f"w{rng.randrange(4)}" for _ in range(10)]
    docs = [(i, " ".join([f"q{rng.randrange(9)}" for _ in range(i)] + shared + [f"z{rng.randrange(9)}" for _ in range(i)])) for i in range(30)]
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame([(1, " ".join(shared))], "item_id long, text string"))
    assert all(r["n_hit"] >= 10 for r in got.collect())


# --- simhash -------------------------------------------------------------------------

def test_fingerprint_by_definition():
    import xxhash

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
        grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0

    for t in (None, "", " \t", "One", "É a B c", "a b c d", "a b c d e f A B c d " * 30, "x y z\x0bq\x1fr s t u v"):
        assert simhash.fingerprint(t) == plain(t)


def test_all_links_within_the_radius(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(300)] + [0]
    for p in prints[:120]:
        for bits in (1, 2, 3, 4, 5):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    linked = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame).collect()]

    def classes(pairs):
        root = {p: p for p in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return [top(p) for p in prints]

    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    assert classes(linked) == classes(near)


def test_a_dense_cluster_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK", 200_000)
    monkeypatch.setattr(simhash, "CHUNK", 20_000)
    rng = random.Random(8)
    center = rng.getrandbits(64)
    prints = sorted({center ^ sum(1 << b for b in rng.sample(range(50), rng.randrange(5))) for _ in range(1500)}
                    | {rng.getrandbits(64) for _ in range(50)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    spread = simhash.links(frame).withColumn("task", F.spark_partition_id()).where(
        F.shiftrightunsigned("a", 54) == F.lit(center >> 54))
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spread.collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r in simhash.links(frame).collect():
        a, b = top(r["a"] % (1 << 64)), top(r["b"] % (1 << 64))
        root[max(a, b)] = min(a, b)
    got = [top(p) for p in prints]
    want = {p: p for p in prints}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = a, b
                while want[x] != x:
                    x = want[x]
                while want[y] != y:
                    y = want[y]
                want[max(x, y)] = min(x, y)

    def end(x):
        while want[x] != x:
            x = want[x]
        return x

    assert got == [end(p) for p in prints]
    assert len({r["task"] for r in rows}) > 2


def test_near_duplicates(spark):
    text = " ".join(f"word{i % 97}" for i in range(500))
    rows = [(5, text), (3, text), (9, text + " "), (8, "other words in here"), (4, None), (6, ""), (None, text), (None, "alone in the world today")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fp string")
    got = {(r[0], r[1]): r[2] for r in simhash.near_duplicates(docs).collect()}
    assert got[5, simhash.fingerprint(text) - (1 << 64) if simhash.fingerprint(text) >> 63 else simhash.fingerprint(text)] == 3
    assert got[6, 0] == 4 and got[4, 0] == 4 and len(got) == 8
    assert sum(v is None for v in got.values()) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- html ----------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p>';</script></head><body>"
    "<header class='site'><h1>Site name</h1></header><nav><a href=x>Home</a><a href=y>More</a></nav><div class=\"ad\">Buy the best of it now</div>"
    "<article><h1>A title</h1><p>The first of the long paragraphs that is  in\nthe article and it has <b>bold</b> &lt;signs&gt; &eacute;.<br>End"
    "<p>Short.</p><aside>See also the other</aside><div class='comments'><p>I think that it is the best of all, the rest is not.</p></div></article>"
    "<form><p>Your name and the address</p></form><footer>&copy; the owner</footer></body></html>"
)


def test_html(spark):
    want = "A title\n\nThe first of the long paragraphs that is in the article and it has bold <signs> é. End\n\nShort."
    assert html.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain words, no markup at all &am"), (None, "z", "<p"), (5, "l", PAGE.replace("Short.", "word " * 40_000))]
    got = html.extract(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")).collect()
    texts = [(r["page_id"], r["text"], r["n_chars"]) for r in got]
    assert texts[0] == texts[1] == (1, want, len(want)) and texts[2] == (2, "", 0) and texts[3] == (3, "", 0)
    assert texts[4][1] == "plain words, no markup at all &am" and texts[5] == (None, "", 0) and texts[6][2] > 199_000
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_block_rules_without_structure():
    links = "<div>" + "".join(f"<a href=#{i}>the link {i} of the list</a> " for i in range(20)) + "</div>"
    body = "<div>" + "It is the text of the page that we want to have and it is long. " * 8 + "</div>"
    assert html.main_text(links + body + "<div>The end of it.</div>") == body[5:-6].strip() + "\n\nThe end of it."
