"""Substring dedup with FM-indexes over shards of the corpus.

A window of words can only repeat where its least k-gram hash repeats. Each text is cut into runs of windows
that share that k-gram occurrence; a run and its words are a segment. Segments whose k-gram occurs once
in the corpus are out. Equal segments become one with a count, and the rest are dealt to
shards by k-gram, so that all occurrences of a window meet in one shard, whatever the number of shards. A
shard builds a compressed index of its segments and streams them through it by backward search; what comes
back is, per segment, the windows that occur again. Segments of a k-gram that too many texts share are dealt
window by window instead. Texts that cross the network are zstandard-compressed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import map_arrow
from .fmindex import FMIndex

WINDOW, GRAM = 35, 8
#: Distinct segments a shard holds on average, and those of one k-gram from which they are dealt by window.
SHARD, HEAVY = 8_000, 8_000
#: Bytes of text hashed at once.
SLICE = 2 << 20


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int):
    """base**i and its inverse modulo 2**64, for i < n."""
    import numpy as np

    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), b, np.uint64)]))[:n]
                 for b in (base, pow(base, -1, 1 << 64)))


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5)


class Hasher:
    """Rolling hashes of words and of spans of words; powers are kept between calls."""

    def __init__(self):
        import numpy as np

        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.powers = {}

    def _power(self, which: int, n: int):
        known = self.powers.get(which)
        if known is None or len(known[0]) < n:
            known = self.powers[which] = _powers(_BASES[which], max(n, 1 << 16) * 3 // 2)
        return known[0][:n], known[1]

    def spans(self, values, starts, ends, which: int):
        """A hash of values[start:end] for each pair."""
        import numpy as np

        up, down = self._power(which, len(values))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up)])
        return _mix((sums[ends] - sums[starts]) * down[starts])

    def words(self, data):
        """(hash, start) of the words of bytes, in order."""
        import numpy as np

        blank = np.concatenate([[True], self.space[data], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        return self.spans(self.byte[data], starts, ends, 0), starts

    def long_words(self, data: bytes):
        """The hashes of a text's words; a long text goes through in slices cut at white space."""
        import numpy as np

        view, out, at = np.frombuffer(data, dtype=np.uint8), [], 0
        while at < len(view):
            to = min(len(view), at + SLICE)
            while to < len(view) and not self.space[view[to]]:
                to += 1
            out.append(self.words(view[at:to])[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cut(hasher: Hasher, hashes, sizes, window: int = WINDOW, gram: int = GRAM):
    """The segments of texts whose words' hashes follow each other: (text, start, run, k-gram hash, segment hash).

    A segment is ``run`` windows and so ``run + window - 1`` words; every window of a text is in one.
    """
    import numpy as np

    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - gram + 1)
    grams = hasher.spans(hashes, at, at + gram, 1)
    # The leftmost least k-gram of every window, from ranges twice as long each time.
    width, span = window - gram + 1, 1
    least = at
    while span * 2 <= width:
        left, right = least[:len(least) - span], least[span:]
        least = np.where(grams[right] < grams[left], right, left)
        span *= 2
    if span < width:
        left, right = least[:len(least) - (width - span)], least[width - span:]
        least = np.where(grams[right] < grams[left], right, left)
    of = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(of[:n - window + 1] == of[window - 1:])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (least[valid[1:]] != least[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
    first = valid[new]
    run = np.diff(np.append(np.flatnonzero(new), len(valid)))
    text = of[first]
    begins = np.cumsum(sizes) - sizes
    return text, first - begins[text], run, grams[least[first]], hasher.spans(hashes, first, first + run + window - 1, 2)


def _texts(column):
    """The bytes of every text of a batch, NULL as none."""
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _slices(texts):
    """Ranges of texts of about SLICE bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def _hashes(hasher, texts):
    """Word hashes of several texts one after the other, and how many each has."""
    import numpy as np

    if len(texts) == 1:
        one = hasher.long_words(texts[0])
        return one, np.array([len(one)])
    joined = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    hashes, starts = hasher.words(joined)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, begins))


def _identified(docs: DataFrame) -> DataFrame:
    """(d, k, doc_id, text): d and k tell rows apart by id and text; equal rows share them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(2), text)).alias("d"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def occurrences(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keyed: bool = True) -> DataFrame:
    """(g, s, d, k, start, run): the segments of all texts with k-gram and segment hash; only g if not ``keyed``."""
    schema = "g long, s long, d long, k long, start int, run byte" if keyed else "g long"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            texts = _texts(batch.column("text"))
            for a, b in _slices(texts):
                text, start, length, g, s = cut(hasher, *_hashes(hasher, texts[a:b]), window, gram)
                arrays = [pa.array(g.view(np.int64))]
                if keyed:
                    take = pa.array(text + a)
                    arrays += [pa.array(s.view(np.int64)), batch.column("d").take(take), batch.column("k").take(take),
                               pa.array(start.astype(np.int32)), pa.array(length.astype(np.int8))]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "s", "d", "k", "start", "run"][:len(arrays)])

    return _identified(docs).select(*(["d", "k", "text"] if keyed else ["text"])).mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """(d, k, doc_id, z): the rows with their texts compressed, for joins."""
    def run(d, k, doc_id, text):
        import zstandard as zstd

        return d, k, doc_id, [zstd.ZstdCompressor(level=3).compress(t) for t in _texts(text)]

    return map_arrow(_identified(docs), ["d", "k", "doc_id", "text"], "d long, k long, doc_id long, z binary", run)


def _segments(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(g, s, off, run, a, b, n, words): the words of the wanted segments, from the text that has the first
    of each; heavy ones window by window. a and b identify what is in ``words``."""
    schema = "g long, s long, off int, run int, a long, b long, n long, words binary"
    lists = wanted.groupBy("d", "k").agg(F.collect_list(F.struct("g", "s", "start", "run", "n", "heavy")).alias("wanted"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard as zstd
        from xxhash import xxh3_128_digest

        names = ["g", "s", "off", "run", "a", "b", "n", "words"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                words = zstd.ZstdDecompressor().decompress(batch.column("z")[i].as_py()).split()
                for w in batch.column("wanted")[i].as_py():
                    span = words[w["start"]:w["start"] + w["run"] + window - 1]
                    if not w["heavy"]:
                        rows.append((w["g"], w["s"], 0, w["run"], w["g"], w["s"], w["n"], b" ".join(span)))
                        size += 8 * len(span)
                        continue
                    for off in range(w["run"]):
                        one = b" ".join(span[off:off + window])
                        a, b = np.frombuffer(xxh3_128_digest(one), dtype="<i8").tolist()
                        rows.append((w["g"], w["s"], off, 1, a, b, w["n"], one))
                        size += len(one)
                if size > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    # Equal rows are one text here: its segments' counts already have them all.
    return texts.select("d", "k", "z").dropDuplicates(["d", "k"]).join(lists, ["d", "k"]).mapInArrow(run, schema)


def indexed(segments: DataFrame, shards: int, window: int) -> DataFrame:
    """(a, b, mask): of the distinct ``segments(a, b, run, n, words)`` those with windows that occur again."""
    def search(table):
        import numpy as np
        import pyarrow as pa

        from_words = Hasher()
        found = [from_words.long_words(w) for w in table["words"].to_pylist()]
        index = FMIndex(found, table["n"].to_numpy(), window + int(max(table["run"].to_numpy())) - 1)
        mask = index.repeated(window)
        some = np.flatnonzero(mask)
        return pa.table({"a": table["a"].take(pa.array(some)), "b": table["b"].take(pa.array(some)), "mask": pa.array(mask[some])})

    shard = F.pmod(F.xxhash64("a", F.lit(7)), F.lit(shards)).cast("int").alias("shard")
    dealt = segments.select(shard, "a", "b", "run", "n", "words").repartition(shards, "shard")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long, mask long")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(d, k, spans): per text the starts and masks of its segments with windows that occur again anywhere."""
    often = occurrences(docs, window, gram, keyed=False).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    often = materialize(often, "substring-grams")
    found = materialize(occurrences(docs, window, gram).join(often, "g"), "substring-segments")
    distinct = found.groupBy("g", "s").agg(F.min(F.struct("d", "k", "start", "run")).alias("x"), F.count("*").alias("n"))
    distinct = materialize(distinct.select("g", "s", "n", "x.*"), "substring-distinct")
    shards = max(1, distinct.count() // SHARD)
    heavy = materialize(distinct.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > HEAVY), "substring-heavy")
    wanted = distinct.join(heavy, "g", "left").withColumn("heavy", F.col("m").isNotNull())
    path = scratch_path(docs.sparkSession, "substring-words")
    _segments(packed(docs), wanted, window).write.option("compression", "zstd").parquet(path)
    words = docs.sparkSession.read.parquet(path)
    whole, single = words.where("a = g AND b = s"), words.where("a <> g OR b <> s")
    same = whole.select("a", "b", "run", "n", "words")
    by_window = not heavy.isEmpty()
    if by_window:
        same = same.unionByName(single.groupBy("a", "b").agg(F.first("run").alias("run"), F.sum("n").alias("n"), F.first("words").alias("words")))
    masks = materialize(indexed(same, shards, window), "substring-masks")
    of = masks.join(whole.select("a", "b"), ["a", "b"], "left_semi") if by_window else masks
    of = of.select(F.col("a").alias("g"), F.col("b").alias("s"), "mask")
    if by_window:
        split = single.select("g", "s", "off", "a", "b").join(masks, ["a", "b"])
        of = of.unionByName(split.groupBy("g", "s").agg(F.bit_or(F.expr("shiftleft(mask, off)")).alias("mask")))
    return found.join(of, ["g", "s"]).groupBy("d", "k").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), a row per row of ``docs``: words covered by a window of ``window`` words
    that also starts anywhere else are removed; the kept ones are joined by one space.

    Words are runs of anything but ASCII white space. A NULL text has no words, and neither it nor a text
    shorter than a window loses any. Equal rows are texts of their own: they lose all their windows.
    Windows may repeat within a text, overlapping too. Other columns are left aside.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard as zstd

        names = ["doc_id", "n_words", "n_removed", "kept"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                n, lost, kept = [], [], []
                for z, spans in zip(some.column("z").to_pylist(), some.column("spans").to_pylist()):
                    words = zstd.ZstdDecompressor().decompress(z).split()
                    left = b" ".join(words)
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    for span in spans or ():
                        at_, mask = span["start"], span["mask"]
                        while mask:
                            low = (mask & -mask).bit_length() - 1
                            mask >>= low
                            length = (~mask & (mask + 1)).bit_length() - 1
                            mask >>= length
                            at_ += low
                            cover[at_] += 1
                            cover[at_ + length + window - 1] -= 1
                            at_ += length
                    if spans:
                        stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                        left = b" ".join([words[i] for i in stay.tolist()])
                        lost.append(len(words) - len(stay))
                    else:
                        lost.append(0)
                    n.append(len(words))
                    kept.append(left.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept)], names=names)

    met = packed(docs).join(repeats(docs, window, gram), ["d", "k"], "left")
    return met.select("doc_id", "z", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
