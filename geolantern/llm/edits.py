"""Document fingerprints by randomised edit embedding.

A text is walked by shared random walks: at step j the walk stands on a character, and a random bit
of (j, character) says whether it moves on. The characters met, step by step, are an embedding in
which a few edits change few places, since two walks that part over an edit soon fall into step
again. The fingerprint samples the places of the embedding, one hex digit each.

A shift by s characters takes a walk some s * s steps to make up for. So walks set out from places
that the text itself picks, by the least hash of a few characters, onwards and back. Two pairs
set out in the first half: what a header in front changes is only the far end of the way back. For
a third set the text is cut at a picked place, both parts again, and each of the PIECES is walked from a
place of its own, so that an insertion moves only its own piece. Texts are as like as the best of
the three says.

Sampled places are nested: longer texts use every second, fourth, ... of them, so fingerprints of
texts of any lengths share places. Bands of digits bring likely neighbours together.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, map_arrow, text_key

#: A text's sampled places lie between this and twice this, if it has as many steps.
PLACES = 64
#: Code points walked side by side, and the fewest texts that are; the rest of the longest texts is walked one by one.
CHUNK, SIDE = 4_000_000, 16
#: Steps taken before the sampled places among them are read off.
STRIDE = 256
#: A step has a random bit for each of so many kinds of characters; kind KINDS, the end of a text, never moves on.
KINDS = 30
#: Times that a text is walked whole, pieces that are walked each by itself (a power of two), and the
#: characters that a place is picked by.
WHOLE, PIECES, PICKED_BY = 2, 4, 9
BANDS, DIGITS = 16, 8
#: Beginning of a text by which rows of one id are dealt to ranges.
RANGED_BY = 64
SEED = 20_25


def _mix(x):
    import numpy as np

    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def level(n: int) -> int:
    """How often the sampled places of a text of n code points are halved."""
    return max(0, (2 * n // PLACES).bit_length() - 1)


@lru_cache(maxsize=64)
def places(halved: int):
    """All sampled places of a level, ascending, as far as texts of that level reach."""
    import numpy as np

    span = PLACES << (halved + 1)
    if halved == 0:
        return np.arange(span)
    at = np.arange(span, dtype=np.uint64)
    return np.flatnonzero(_mix(at + np.uint64(SEED)) >> np.uint64(64 - halved) == 0)


@lru_cache(maxsize=4096)
def _bits(stride: int) -> list[int]:
    """The random bits of the steps of one stride, an integer of KINDS bits per step."""
    import numpy as np

    steps = np.arange(stride * STRIDE, (stride + 1) * STRIDE, dtype=np.uint64)
    return (_mix(steps + np.uint64(SEED)) >> np.uint64(64 - KINDS)).tolist()


@lru_cache(maxsize=1024)
def _moves(stride: int):
    """For each step of a stride, by how much it moves on from each kind of character."""
    import numpy as np

    bits = np.array(_bits(stride), dtype=np.int64)[:, None]
    return bits >> np.arange(KINDS + 1) & 1


def fingerprints(texts: list[str]) -> list[str]:
    """``<length in hex>:<onwards>-<back>:<the same from another place>:<...of each piece>`` of each text, a hex digit per sampled place.

    Equal texts give equal prints, whatever texts are beside them.
    """
    out, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            out.extend(_prints(held))
            held, size = [], 0
    return out + (_prints(held) if held else [])


def _prints(texts: list[str]) -> list[str]:
    import numpy as np

    mark, first = _marks(texts)
    some = mark[:-6] * np.uint32(0x9E3779B1) + mark[3:-3] * np.uint32(0x7FEB352D) + mark[6:] * np.uint32(0x846CA68B)
    some ^= some >> np.uint32(16)
    some *= np.uint32(0x21F0AAAD)
    some ^= some >> np.uint32(15)
    other = (some ^ np.uint32(0x3C6EF372)) * np.uint32(0x735A2D97)
    other ^= other >> np.uint32(15)

    def pick(ranks, low: int, high: int, last: int) -> int:
        high = min(high, last - PICKED_BY - 2)
        return low if high <= low else low + int(ranks[low:high].argmin())

    pieces, starts, levels, each = [], [], [], WHOLE + PIECES
    for text, at in zip(texts, first.tolist()):
        end = at + len(text)
        parts = [(at, end)]
        while len(parts) < PIECES:
            cuts = [pick(other, a + (b - a) // 8, b - (b - a) // 8, end) for a, b in parts]
            parts = [half for (a, b), cut in zip(parts, cuts) for half in ((a, cut), (cut, b))]
        pieces += [text] * WHOLE + [text[a - at:b - at] for a, b in parts]
        starts += [pick(ranks, at, at + len(text) // 2, end) - at for ranks in (some, other)]
        # The characters that a piece's place is picked by lie within it.
        starts += [pick(other, a + (b - a) // 8, b - (b - a) // 8, b) - a for a, b in parts]
        levels += [level(len(text))] * each
    # A way back is a way onwards over the turned text.
    ends = [way for text, start in zip(pieces, starts) for way in (text[start:], text[:start][::-1])]
    walked = _walk(ends, [k for k in levels for _ in range(2)])
    ways = [f"{a}-{b}" for a, b in zip(walked[::2], walked[1::2])]
    out = []
    for i, text in zip(range(0, len(ways), each), texts):
        out.append(":".join([f"{len(text):x}", *ways[i:i + WHOLE], "-".join(ways[i + WHOLE:i + each])]))
    return out


def _marks(texts: list[str]):
    """A hash of each character with the two after it, and where each text begins.

    Three closing characters lie before and after each text: no context reaches into the next one.
    """
    import numpy as np

    joined = "\0\0\0" + "\0\0\0".join(texts) + "\0" * 9
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mark = codes[:-2] * np.uint32(0x85EBCA6B) + codes[1:-1] * np.uint32(0xC2B2AE35) + codes[2:] * np.uint32(0x27D4EB2F)
    mark ^= mark >> np.uint32(15)
    mark *= np.uint32(0x2C1B3C6D)
    mark ^= mark >> np.uint32(13)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return mark, 3 + np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])


def _walk(texts: list[str], halved: list[int]) -> list[str]:
    """The digits at the sampled places of each text's level."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    lengths, levels = sizes[order], np.array(halved)[order]
    mark, at = _marks([texts[i] for i in order.tolist()])
    kinds = (mark % np.uint32(KINDS)).astype(np.uint8)
    digits = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[(mark >> np.uint32(7)) & np.uint32(15)]
    kinds[at + lengths], digits[at + lengths] = KINDS, ord("0")
    alike = [(int(k), np.flatnonzero(levels == k)) for k in np.unique(levels)]
    got = {k: [np.zeros((0, len(who)), dtype=np.uint8)] for k, who in alike}
    stride, now = 0, at.copy()
    while (left := int((2 * lengths > stride * STRIDE).sum())) >= SIDE:
        path = np.empty((STRIDE, left), dtype=np.int64)
        now = now[:left]
        for j, moves in enumerate(_moves(stride)):
            path[j] = now
            now += moves[kinds[now]]
        for k, who in alike:
            if who[0] < left:
                some = _between(k, stride)
                got[k].append(np.zeros((len(some), len(who)), dtype=np.uint8))
                on = who[who < left]
                got[k][-1][:, :len(on)] = digits[path[some][:, on]]
        stride += 1
    out = [""] * len(texts)
    for k, who in alike:
        side, cuts = np.ascontiguousarray(np.concatenate(got[k]).T), np.searchsorted(places(k), 2 * lengths[who]).tolist()
        for own, cut, i, n, here in zip(side, cuts, order[who].tolist(), lengths[who].tolist(), now[who[who < len(now)]].tolist() + [0] * len(who)):
            print_ = own[:cut].tobytes()
            if 2 * n > stride * STRIDE:
                rest = slice(here, here + n + 1)
                print_ = (own.tobytes() + digits[rest][_alone(kinds[rest].tobytes(), k, stride, 2 * n)].tobytes())[:cut]
            out[i] = print_.decode()
    return out


def _between(halved: int, stride: int):
    """The sampled places of a stride, counted from its first step."""
    import numpy as np

    spots = places(halved)
    a, b = np.searchsorted(spots, [stride * STRIDE, (stride + 1) * STRIDE])
    return spots[a:b] - stride * STRIDE


def _alone(kinds: bytes, halved: int, stride: int, steps: int):
    """Where one text stands at its sampled places from a stride on."""
    import numpy as np

    path, at = [], 0
    for stride in range(stride, -(-steps // STRIDE)):
        bits, done = _bits(stride), 0
        for spot in [*_between(halved, stride).tolist(), STRIDE]:
            for b in bits[done:spot]:
                at += b >> kinds[at] & 1
            path.append(at)
            done = spot
        path.pop()
    return np.array(path, dtype=np.int64)


def _ways(print_: str) -> tuple[int, list[list[bytes]]]:
    """Level, and for each set of walks the digits of its ways."""
    n, *sets = print_.encode().split(b":")
    return level(int(n, 16)), [ways.split(b"-") for ways in sets]


def _coarser(digits, own: int, wanted: int):
    """The digits at the places that a coarser level keeps."""
    import numpy as np

    if own == wanted:
        return digits
    spots = places(own)[:len(digits)]
    return digits[np.isin(spots, places(wanted)[:np.searchsorted(places(wanted), spots[-1], side="right")], assume_unique=True)] if len(digits) else digits


def likeness(a: str, b: str) -> float:
    """0 to 1: share of equal digits at the common places by the best set of walks, less what chance gives; 1 for equal prints."""
    if a == b:
        return 1.0
    import numpy as np

    (own, xs), (other, ys), best = _ways(a), _ways(b), 0.0
    for x, y in zip(xs, ys):
        if own != other:
            x, y = ([_coarser(np.frombuffer(w, dtype=np.uint8), k, max(own, other)).tobytes() for w in ways]
                    for ways, k in ((x, own), (y, other)))
        longest = [max(len(p), len(q)) for p, q in zip(x, y)]
        if every := sum(longest):
            p = b"".join([w.ljust(n, b"<") for w, n in zip(x, longest)])
            q = b"".join([w.ljust(n, b">") for w, n in zip(y, longest)])
            equal = np.frombuffer(p, dtype=np.uint8) == np.frombuffer(q, dtype=np.uint8)
            best = max(best, int(np.count_nonzero(equal)) / every)
    return max(0.0, (best - 1 / 16) / (15 / 16))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(texts: list[str], following: list[str], next_prints: list[str] | None = None, prints: list[str] | None = None):
    prints = prints or fingerprints(texts)
    next_prints = next_prints or fingerprints(following)
    changed = [edited(t, f) for t, f in zip(texts, following)]
    changed_prints = fingerprints(changed)
    return (
        [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        prints, changed_prints, [likeness(a, b) for a, b in zip(prints, changed_prints)],
        [likeness(a, b) for a, b in zip(prints, next_prints)],
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    Documents follow one another by descending doc_id, NULL last, rows of one id by text; after the
    last comes the first. NULL texts are empty. Texts are shuffled once: a partition of the id
    range finds each next document beside its own, and only the last document of a partition
    is met with the first of the next one in a second, small step. Rows of one id are spread over partitions
    as far as their first RANGED_BY code points differ.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # doc_id, text, print of the document that waits for its next one
        kinds = pa.schema([
            ("part", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
            ("near_next", pa.float64()), ("text", pa.string())])

        def boundary(kind, doc_id, text):
            return pa.RecordBatch.from_pylist([{"part": part, "kind": kind, "doc_id": doc_id, "text": text}], schema=kinds)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, texts = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
                prints = fingerprints(texts)
                if held is None:
                    yield boundary(1, ids[0], texts[0])
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
                held = ids[-1], texts[-1], prints[-1]
                if len(ids) > 1:
                    found = _compare(texts[:-1], texts[1:], prints[1:], prints[:-1])
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, type=f.type) for x, f in zip(
                            ([part] * n, [0] * n, ids[:-1], *found, [None] * n), kinds)], schema=kinds)
        if held is not None:
            yield boundary(2, held[0], held[1])

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    # The sample that ranges are drawn from holds no whole text: texts in order have their beginnings in order.
    ranges = [order[0], F.substring("text", 1, RANGED_BY).asc_nulls_first()]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*ranges).sortWithinPartitions(*order)
    done = materialize(ranged.mapInArrow(run, f"part int, kind tinyint, doc_id long, {FIELDS}, text string"), "edits")
    # One row per partition of the shuffle, whatever the number of documents.
    parts = [r[0] for r in done.where("kind = 1").select("part").orderBy("part").collect()]
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    ends = done.where("kind = 2").select("part", "doc_id", "text").join(following, "part").join(
        done.where("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("following")), "after")

    def last(doc_id, text, following):
        return doc_id, *_compare([t or "" for t in text.to_pylist()], [t or "" for t in following.to_pylist()])

    rest = map_arrow(ends, ["doc_id", "text", "following"], f"doc_id long, {FIELDS}", last)
    return done.where("kind = 0").drop("part", "kind", "text").unionByName(rest)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fingerprint) of every row."""
    def run(doc_id, key, text):
        return doc_id, key, fingerprints([t or "" for t in text.to_pylist()])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text"), ["doc_id", "key", "text"],
                     "doc_id long, key long, fingerprint string", run)


@lru_cache(maxsize=1024)
def _picks(reach: int):
    """The places of each band's digits among the first ``reach`` sampled ones.

    Each digit takes the place of the least hash, so that texts of a few places more or fewer mostly pick alike.
    """
    import numpy as np

    ranks = _mix(np.arange(BANDS * DIGITS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(reach, dtype=np.uint64))
    return ranks.argmin(axis=1).reshape(BANDS, DIGITS)


def bands(print_: str) -> list[int]:
    """Keys of a print's bands, at its own level and the next coarser one; bands take turns over the ways.

    A way of few digits is met as all of them together, a print of few digits has one key.
    """
    import numpy as np

    own, walks = _ways(print_)
    out = []
    for walk, ways in enumerate(walks):
        for wanted in (own, own + 1):
            cut = [_coarser(np.frombuffer(w, dtype=np.uint8), own, wanted) for w in ways]
            for b in range(BANDS):
                some = cut[b % len(cut)]
                if len(some) < DIGITS:
                    some = np.concatenate(cut)
                picked = some[_picks(len(some))[b]] if len(some) >= DIGITS else some
                data = bytes([walk, wanted, b if len(some) >= DIGITS else BANDS]) + picked.tobytes()
                out.append(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True))
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, key, fingerprint, component): rows whose prints are linked by a likeness of ``least`` or more.

    Equal prints are one node. Candidates meet in a band; sorted by print, a band links each print to
    its first and to its predecessor, every link is verified, and ``component`` is the smallest node
    (hash of a print) reachable. Bands never list all pairs; a hot band is one sort by key in Spark.
    """
    from pyspark.sql import Window

    rows = materialize(prints(docs), "edit-prints").withColumn("node", F.xxhash64("fingerprint"))
    nodes = rows.select("node", "fingerprint").distinct()

    def cut(node, fingerprint):
        keys = [bands(p) for p in fingerprint.to_pylist()]
        return node, fingerprint, keys

    banded = map_arrow(nodes, ["node", "fingerprint"], "node long, fingerprint string, bands array<bigint>", cut)
    banded = banded.select("node", "fingerprint", F.explode(F.array_distinct("bands")).alias("band"))
    by_band = Window.partitionBy("band").orderBy("fingerprint")
    met = banded.select(
        F.col("node").alias("a"), F.col("fingerprint").alias("x"),
        F.struct(F.lag("node").over(by_band).alias("b"), F.lag("fingerprint").over(by_band).alias("y")).alias("previous"),
        F.struct(F.first("node").over(by_band).alias("b"), F.first("fingerprint").over(by_band).alias("y")).alias("head"),
    )
    pairs = met.select("a", "x", F.explode(F.array("previous", "head")).alias("other")).select("a", "x", "other.*").where(
        "b IS NOT NULL AND a <> b").dropDuplicates(["a", "b"])

    def verify(a, b, x, y):
        return a, b, [likeness(p, q) >= least for p, q in zip(x.to_pylist(), y.to_pylist())]

    linked = map_arrow(pairs, ["a", "b", "x", "y"], "a long, b long, near boolean", verify).where("near").select("a", "b")
    roots = components(materialize(linked, "edit-links"))
    return rows.join(roots, "node", "left").select(
        "doc_id", "key", "fingerprint", F.coalesce("root", "node").alias("component"))
