"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant within ``radius // 2``
bits of both. Every distinct fingerprint emits all its variants within that half radius, and
variants that collide are verified. The variants are not shuffled one by one: the exchange
goes by the first bits of a variant, so a fingerprint is sent once per prefix that its variants
have, and the task of a prefix lays out the remaining bits. All variants are compared. A prefix with
too many variants, such as that of many near copies of one text, is dealt further by parities of the
variants: the parity of a variant is that of the fingerprint XOR that of the mask, so each part lays
out its own variants only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_small, materialize
from .common import components, map_arrow, text_key

BITS = 64
SEED = 42
MIN_PREFIX, MAX_PREFIX = 10, 24
#: Distinct fingerprints for which a prefix is one bit longer than MIN_PREFIX, times 2**MIN_PREFIX.
ROWS_PER_PREFIX = 1000
#: Variants laid out at once in a task.
CHUNK = 4_000_000
#: Variants of a prefix from which it is dealt to several tasks, and the most parity bits for that and in all.
TASK, TASK_BITS, PARITY_BITS = 32_000_000, 8, 14


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text; 0 for a text without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        joined = b" ".join(tokens)
        ends, at = [], -1
        for token in tokens:
            at += len(token) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:])]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(len(hashes), 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, key): fp is the fingerprint as a signed long. NULL texts have fingerprint 0."""
    def run(ids, texts, keys):
        import numpy as np

        fps = np.array([fingerprint(t, words) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64)
        return ids, fps, keys

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("key")), ["doc_id", "text", "key"],
                     "doc_id long, fp long, key long", run)


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for w in range(most + 1) for c in combinations(range(bits), w)]


def _parities(x):
    """PARITY_BITS parities of random choices of the bits of each value; linear over XOR."""
    import numpy as np

    out = np.zeros(len(x), dtype=np.uint64)
    for b in range(BITS):
        label = ((b + 1) * 0x9E3779B97F4A7C15 >> 20) % (1 << PARITY_BITS)
        out ^= (x >> np.uint64(b) & np.uint64(1)) * np.uint64(label)
    return out.astype(np.int64)


def _fold(root, a, b) -> None:
    """Joins a[i] and b[i]; ``root`` has each node's smallest member before and after."""
    import numpy as np

    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) between distinct fingerprints of ``fps(fp)`` whose closure is that of all pairs
    at most ``radius`` bits apart. Each returned pair is joined by such links within one task."""
    half = radius // 2
    n = fps.count()
    prefix = min(MAX_PREFIX, max(MIN_PREFIX, (max(n, 1) // ROWS_PER_PREFIX).bit_length()))
    low = BITS - prefix

    def signed(x):
        return x - (1 << BITS) if x >> (BITS - 1) else x

    sent = F.explode(F.array([
        F.struct(F.lit(signed(m << low)).cast("long").alias("mask"), F.lit(half - m.bit_count()).cast("byte").alias("left"))
        for m in _masks(prefix, half)
    ]))
    dealt = fps.select("fp", sent.alias("x")).select(
        F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("x.mask")), low).cast("int").alias("prefix"), "fp", "x.left"
    )
    laid_out = F.element_at(F.array([F.lit(len(_masks(low, b))) for b in range(half + 1)]), F.col("left").cast("int") + 1)
    heavy = dealt.groupBy("prefix").agg(F.sum(laid_out.cast("long")).alias("n")).where(F.col("n") > TASK).select(
        F.col("prefix").alias("p"), F.least(F.ceil(F.log2(F.col("n") / TASK)), F.lit(TASK_BITS)).cast("int").alias("bits"))
    heavy = materialize(heavy, "simhash-heavy")
    dealt = dealt.join(F.broadcast(heavy) if is_small(heavy) else heavy, F.col("prefix") == F.col("p"), "left").select(
        "prefix", "fp", "left", F.coalesce("bits", F.lit(0)).alias("bits"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("bits")).cast("int") - 1)))

    def meet(frame):
        import numpy as np
        import pandas as pd

        fp = frame["fp"].to_numpy().view(np.uint64)
        left = frame["left"].to_numpy()
        outer, part = int(frame["bits"].iloc[0]), int(frame["part"].iloc[0])
        rest = fp & np.uint64((1 << low) - 1)
        groups = [(np.flatnonzero(left == b), np.array(_masks(low, b), dtype=np.uint64)) for b in range(half + 1)]
        total = sum(len(i) * len(m) for i, m in groups) >> outer
        inner = 0
        while total >> inner > CHUNK and outer + inner < PARITY_BITS:
            inner += 1
        classes = 1 << (outer + inner)
        of = [([rows[own == c] for c in range(classes)], [masks[set_ == c] for c in range(classes)]) for rows, masks, own, set_ in (
            (rows, masks, _parities(rest[rows]) & (classes - 1), _parities(masks) & (classes - 1)) for rows, masks in groups)]
        root = np.arange(len(fp))
        for wanted in range(part, classes, 1 << outer):
            variants, owner = [], []
            for rows, masks in of:
                for c in range(classes):
                    some, flips = rows[c], masks[c ^ wanted]
                    if len(some) and len(flips):
                        variants.append((rest[some][:, None] ^ flips[None, :]).ravel())
                        owner.append(np.repeat(some.astype(np.int32), len(flips)))
            if not variants:
                continue
            variants, owner = np.concatenate(variants), np.concatenate(owner)
            order = np.argsort(variants)
            variants, owner = variants[order], owner[order]
            same = np.flatnonzero(variants[1:] == variants[:-1])
            a, b = owner[same], owner[same + 1]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            _fold(root, a[near], b[near])
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    return dealt.groupBy("prefix", "part").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, key, root), a row per row of ``docs``.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest doc_id reachable. Texts that are NULL or hold no word have
    fingerprint 0 and are linked like any other; rows with a NULL doc_id take part, and their
    component is NULL only if no member has an id. ``key`` is that of the text and ``root`` the smallest
    fingerprint of the component, which tells components apart that have no id or share one. Copies meet in one fingerprint before
    anything is compared, so they are never paired with each other.
    """
    prints = materialize(fingerprints(docs, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = materialize(distinct, "simhash-distinct")
    linked = materialize(links(distinct.select("fp"), radius), "simhash-links")
    roots = materialize(components(linked), "simhash-roots")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = member.join(smallest, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id", "key", "root")


def representatives(found: DataFrame) -> DataFrame:
    """(doc_id, key, n): of each component of ``near_duplicates`` the row with the smallest doc_id (NULL
    last) and key, and how many rows are equal to it in both. Rows are combined before each exchange."""
    equal = found.groupBy("root", "doc_id", "key", "fp").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "fp", "n"))
    return equal.groupBy("root").agg(first.alias("x")).select("x.doc_id", "x.key", "x.n")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
