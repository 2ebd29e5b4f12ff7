"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut
into windows of a few words; a window that the toxic dictionary compresses by some bytes
better than the ordinary one speaks for label 1. The thresholds on those differences are
calibrated on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_arrow

#: Most labelled rows used for training: so many of label 1, and so many of label 0.
TOXIC_ROWS, ORDINARY_ROWS = 2_000, 6_000
#: Snippets of BASE_SNIPPET characters of ordinary text that the common part of both is trained on.
BASE_ROWS, BASE_SNIPPET, BASE_BYTES = 2_000, 4_000, 12_000
#: Words in a window, and from one window to the next: every word is measured twice.
WINDOW, STEP = 12, 6
#: Most segments in a dictionary, and how sharp a segment must be.
SEGMENTS, MIN_RATIO, MIN_G, MIN_SHARE_OF_BEST = 200, 6.0, 25.0, 0.1
COUNTED = (1, 2, 3, 4, 6)
SHARED = (2, 3, 4)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stems(tokens) -> set[bytes]:
    """Word beginnings of 4 to 10 bytes and short whole words, each with the space before it."""
    out = set()
    for w in set(tokens):
        if len(w) <= 24:
            out.add(b" " + w + b" ")
        for k in range(4, min(len(w), 10) + 1):
            out.add(b" " + w[:k])
    return out


@dataclass(frozen=True)
class Model:
    """Dictionaries (content bytes) and the calibrated linear score of the window counts."""

    toxic: bytes = b""
    ordinary: bytes = b""
    primer: bytes = b""
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()
    bias: float = 0.0
    window: int = WINDOW
    step: int = STEP

    def scorer(self):
        """text -> features, and features -> score; built once per task."""
        import numpy as np
        import zstandard as zstd

        if not self.weights:
            constant = 1 / (1 + math.exp(-self.bias))
            return (lambda text: ()), (lambda feats: constant)

        def compressor(content):
            params = zstd.ZstdCompressionParameters(
                format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
                window_log=15, chain_log=14, hash_log=14, search_log=6, min_match=4, target_length=32,
                strategy=zstd.STRATEGY_LAZY,
            )
            trained = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=params)
            return zstd.ZstdCompressor(dict_data=trained, compression_params=params).compress

        by_toxic, by_ordinary = compressor(self.toxic), compressor(self.ordinary)
        size, step, primer = self.window, self.step, self.primer

        def features(text):
            tokens = words(text)
            gains = []
            for i in range(0, len(tokens), step):
                # The primer is in both dictionaries: with it even a short window is compressed.
                window = primer + b" " + b" ".join(tokens[i:i + size]) + b" "
                gains.append(len(by_ordinary(window)) - len(by_toxic(window)))
            gain = np.array(gains or [0])
            n = len(gain)
            return [
                float(gain.max()), *(float((gain >= k).sum()) / n ** 0.5 for k in COUNTED),
                *(float((gain >= k).sum()) / n for k in SHARED),
                float(gain.mean()), float(gain.sum()) / n ** 0.5, math.log(max(1, len(tokens))),
            ]

        mean, scale, weights = (np.array(x) for x in (self.mean, self.scale, self.weights))

        def score(feats):
            z = float(((np.array(feats) - mean) / scale) @ weights + self.bias)
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return features, score


def _segments(counts: DataFrame, mine: str, other: str, n_mine: int, n_other: int) -> list[bytes]:
    """The sharpest segments of one class: document counts, rated by the G statistic."""
    c, d = F.col(mine).cast("double"), F.col(other).cast("double")
    total, share = c + d, n_mine / max(1, n_mine + n_other)
    ratio = ((c + 0.5) / (n_mine + 1)) / ((d + 0.5) / (n_other + 1))
    g = 2 * (c * F.log(c / (total * share)) + F.when(d > 0, d * F.log(d / (total * (1 - share)))).otherwise(0.0))
    top = counts.where((c >= max(3, 0.01 * n_mine)) & (ratio > MIN_RATIO)).select("stem", g.alias("g")).where(
        F.col("g") >= MIN_G).orderBy(F.desc("g"), F.desc(F.length("stem")), "stem").limit(SEGMENTS * 20).collect()
    found = [(bytes(r["stem"]), r["g"]) for r in top]
    chosen: list[bytes] = []
    for row in top:
        if row["g"] < MIN_SHARE_OF_BEST * top[0]["g"] or len(chosen) == SEGMENTS:
            break
        stem = bytes(row["stem"])
        # The longest extension that is nearly as sharp: it saves the most bytes.
        stem = max((z for z, g in found if g >= 0.9 * row["g"] and z.startswith(stem)), key=len)
        if not any(z.rstrip() in stem or stem.rstrip() in z for z in chosen):
            chosen.append(stem)
    return chosen


def fit(sample: DataFrame, prior: float) -> Model:
    """Train on ``sample(text, label)``, a bounded set of rows with label 0 or 1.

    ``prior`` is the share of label 1 among all labelled rows. Six tenths of the sample give the
    dictionaries, four tenths the thresholds. With fewer than four rows of a class every score
    is ``prior``.
    """
    import numpy as np

    spark = sample.sparkSession
    constant = min(max(prior, 1e-6), 1 - 1e-6)
    constant = Model(bias=math.log(constant / (1 - constant)))
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 4:
        return constant
    h = F.xxhash64("text", F.lit(7))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(h, "text"))
    sample = materialize(sample.select("text", "label", (rank % 10).alias("part")), "toxicity-sample")
    built = sample.where("part < 6")

    def count(labels, texts):
        from collections import Counter

        seen = {0: Counter(), 1: Counter()}
        for label, text in zip(labels.to_pylist(), texts.to_pylist()):
            seen[label].update(stems(words(text)))
        keys = list(set(seen[0]) | set(seen[1]))
        return keys, [seen[1][k] for k in keys], [seen[0][k] for k in keys]

    parts = spark.sparkContext.defaultParallelism
    counts = map_arrow(built.repartition(parts), ["label", "text"], "stem binary, ones long, zeros long", count)
    counts = materialize(
        counts.groupBy("stem").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).where("ones + zeros >= 3"),
        "toxicity-stems",
    )
    sizes = {r["label"]: r["n"] for r in built.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    toxic = _segments(counts, "ones", "zeros", ones, zeros)
    ordinary = _segments(counts, "zeros", "ones", zeros, ones)

    at = F.pmod(F.xxhash64("text", F.lit(11)), F.greatest(F.length("text") - BASE_SNIPPET, F.lit(1))) + 1
    snippets = built.where("label = 0 AND length(text) > 0").orderBy(F.xxhash64("text", F.lit(3)), "text").limit(BASE_ROWS).select(
        F.substring(F.col("text"), at.cast("int"), F.lit(BASE_SNIPPET)).alias("s")).collect()
    base = _common([b" " + b" ".join(words(r["s"])) + b" " for r in snippets])
    length = max(sum(map(len, toxic)), sum(map(len, ordinary)))

    def content(segments):
        tail = b"".join(reversed(segments))
        return base + b"\x01" * (length - len(tail)) + tail + b"\x01" * 8

    model = Model(content(toxic), content(ordinary), base[-96:-32], (0.0,) * 12, (1.0,) * 12, (1.0,) * 12)

    def measure(labels, texts):
        features, _ = model.scorer()
        return labels, [features(t) for t in texts.to_pylist()]

    rows = map_arrow(
        sample.where("part >= 6").repartition(parts), ["label", "text"], "label int, f array<double>", measure
    ).orderBy("label", "f").collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return constant
    x = np.array([r["f"] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights, bias = _logistic((x - mean) / scale, y, prior)
    return Model(model.toxic, model.ordinary, model.primer, tuple(mean), tuple(scale), tuple(weights), float(bias))


def _common(samples: list[bytes]) -> bytes:
    """Common part of both dictionaries: trained content, or plain text if there is too little."""
    import zstandard as zstd

    try:
        content = zstd.train_dictionary(BASE_BYTES + 1000, samples).as_bytes()[-BASE_BYTES:]
    except zstd.ZstdError:
        content = b"".join(samples)[-BASE_BYTES:]
    return content.rjust(256, b"\x02")


def _logistic(x, y, prior, rounds: int = 3000, rate: float = 0.3, decay: float = 1e-3):
    """Weighted so that the sample's classes count as often as in all labelled rows."""
    import numpy as np

    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        slope = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w -= rate * (x.T @ slope / len(y) + decay * w)
        b -= rate * slope.mean()
    return w, b


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row; NULL texts score like empty ones.

    A column of ``docs`` named score cannot be kept. If ``text`` is kept, it is sent once.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    built, at = [], keep.index("text") if "text" in keep else len(keep)

    def run(*columns):
        if not built:
            built.append(model.scorer())
        features, rate = built[0]
        return *columns[:len(keep)], [rate(features(t)) for t in columns[at].to_pylist()]

    sent = list(keep) if at < len(keep) else [*keep, "text"]
    return map_arrow(docs, sent, schema, run)
