"""Line dedup by sorted hashes.

Hashes of all line keys are range-partitioned and sorted by hash, document and position. A
stream over a partition sees the first document of every hash first; lines of later documents
are dropped. A common line may fill many partitions: only the first hash of a partition can have
begun in an earlier one, and those rows wait for the smallest document of their hash.
Texts stay where they are: the result is a compressed keep bitmap per document.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_arrow, text_key

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
NULL_ID = (1 << 63) - 1


def line_key(line: str) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).encode("utf-8", "surrogatepass").lower()


def n_lines(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _ids(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), text_key().alias("key")]


def hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, key, pos, h1, h2): the 128-bit hash of every line key of at least ``min_chars`` code points."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                row, pos, found = [], [], []
                for i, text in enumerate(some.column(2).to_pylist()):
                    for p, line in enumerate(text.split("\n") if text else ()):
                        bare = line.strip(SPACE)
                        if len(bare) >= min_chars:
                            row.append(i)
                            pos.append(p)
                            found.append(xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower()))
                both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                take = np.array(row, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(take)), some.column(1).take(pa.array(take)), pa.array(pos, pa.int32()),
                     pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["d", "key", "pos", "h1", "h2"])

    return docs.select(*_ids(docs), "text").mapInArrow(run, "d long, key long, pos int, h1 long, h2 long")


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, key, pos) of the lines that an earlier document has."""
    def stream(batches):
        import numpy as np
        import pyarrow as pa

        names = ["d", "key", "pos", "h1", "h2", "kind"]
        opening = last = None  # the partition's first hash; (hash, first document) of the running one
        for batch in batches:
            if not batch.num_rows:
                continue
            d, key, pos, h1, h2 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if opening is None:
                opening = (h1[0], h2[0])
            new = np.ones(len(d), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if last is not None and (h1[0], h2[0]) == last[0]:
                new[0] = False
            group = np.cumsum(new)
            firsts = np.concatenate([[last[1] if last else 0], d[new]])
            first = firsts[group]
            last = ((h1[-1], h2[-1]), first[-1])
            waits = (h1 == opening[0]) & (h2 == opening[1])
            out = np.flatnonzero(waits | (d != first))
            kind = waits[out].astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[out]), pa.array(key[out]), pa.array(pos[out]),
                 pa.array(np.where(kind, h1[out], 0)), pa.array(np.where(kind, h2[out], 0)), pa.array(kind)], names=names)
        if last is not None:
            (a, b), doc = last
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32()),
                 pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([2], pa.int8())], names=names)

    order = ["h1", "h2", "d", "pos", "key"]
    ranged = hashes(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = materialize(ranged.mapInArrow(stream, "d long, key long, pos int, h1 long, h2 long, kind tinyint"), "lines")
    # At most two hashes a partition, whatever the number of their rows.
    smallest = seen.where("kind > 0").groupBy("h1", "h2").agg(F.min("d").alias("first"))
    late = seen.where("kind = 1").join(F.broadcast(smallest), ["h1", "h2"]).where("d <> first")
    return seen.where("kind = 0").select("d", "key", "pos").unionByName(late.select("d", "key", "pos"))


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, key, n_lines, n_dropped, keep): a row per distinct document.

    Lines are split at \\n (NULL or empty: one empty line). A line whose key of at least
    ``min_chars`` code points stands in several documents is dropped except in the smallest
    doc_id. ``keep`` is zlib-compressed bits, 1 for a kept line; NULL if all are kept. A NULL
    doc_id counts as the largest. Rows of one doc_id are one document; ``key`` tells their texts
    apart, and equal rows share a bitmap.
    """
    lost = dropped(docs, min_chars).groupBy("d", "key").agg(F.collect_set("pos").alias("lost"))
    rows = docs.select(*_ids(docs), n_lines(F.col("text")).alias("n_lines")).distinct()

    def pack(d, key, n, lost):
        import numpy as np

        counts, keep = [], []
        for lines, some in zip(n.to_pylist(), lost.to_pylist()):
            bits = np.ones(lines, dtype=np.uint8)
            bits[some or []] = 0
            counts.append(len(some or []))
            keep.append(zlib.compress(np.packbits(bits).tobytes()) if some else None)
        return d, key, n, counts, keep

    met = rows.join(lost, ["d", "key"], "left")
    return map_arrow(met, ["d", "key", "n_lines", "lost"], "d long, key long, n_lines long, n_dropped long, keep binary", pack)


def kept_text(text: str | None, keep: bytes | None) -> str:
    import numpy as np

    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return "\n".join([x for x, b in zip(lines, bits) if b])


def digest(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): what the bitmaps leave of the texts."""
    import hashlib

    def run(doc_id, n, lost, text, keep):
        kept = (kept_text(t, k) for t, k in zip(text.to_pylist(), keep.to_pylist()))
        return doc_id, n, lost, [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept]

    met = docs.select("doc_id", *_ids(docs), "text").join(maps, ["d", "key"])
    return map_arrow(met.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", "text", "keep"),
                     ["doc_id", "n_lines", "n_dropped", "text", "keep"],
                     "doc_id long, n_lines long, n_dropped long, kept_sha256 string", run)
