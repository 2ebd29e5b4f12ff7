"""Quality classifier on supervised subword embeddings.

Words and character n-grams are hashed to learned vectors; a document is the mean of its
vectors, and a softmax layer gives the class. Training is numpy stochastic gradient descent on a
bounded sample. Since the output is linear in the mean, scoring needs one number per hash slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Most labelled rows for training by label; their whole texts are used.
ROWS = {0: 2_000, 1: 3_000}
GRAMS = (3, 4, 5)
BITS, DIM = 18, 8
EPOCHS, RATE = 8, 20.0
#: Bytes whose features are computed at once.
CHUNK = 4_000_000

_P = 0x9E3779B97F4A7C15


class Features:
    """Hash slots of words and n-grams of many texts at once; case and punctuation count."""

    def __init__(self, bits: int = BITS, grams: tuple[int, ...] = GRAMS):
        self.bits, self.grams = bits, grams
        self.powers = self.inverse = None

    def _ladder(self, n: int):
        import numpy as np

        if self.powers is None or len(self.powers) < n:
            def ladder(base):
                out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)

            self.powers, self.inverse = ladder(_P), ladder(pow(_P, -1, 1 << 64))
        return self.powers[:n], self.inverse[:n]

    def _slot(self, h, kind: int):
        import numpy as np

        mixed = (h + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def passes(self, data: bytes, ends=None):
        """(positions, slots) per kind of feature over bytes in which white space parts words. ``ends``: where
        the texts of ``data`` end, if it holds several; a text's features are the same among any others."""
        import numpy as np

        b = np.frombuffer(data, dtype=np.uint8)
        n = len(b)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        b64 = np.where(space, 32, b).astype(np.uint64)
        powers, inverse = self._ladder(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b64 + np.uint64(1)) * powers, dtype=np.uint64)])
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        words = (sums[ends] - sums[starts]) * inverse[starts]
        yield starts, self._slot(words, 1)
        # A word that repeats one of the two words before it counts as a feature of its own.
        for back in (1, 2):
            same = words[back:] == words[:-back]
            if ends is not None:
                own = np.searchsorted(ends, starts, side="right")
                same &= own[back:] == own[:-back]
            again = np.flatnonzero(same) + back
            yield starts[again], self._slot(np.full(len(again), 77, dtype=np.uint64), 10 + back)
        rolled = b64
        for k in range(2, max(self.grams) + 1):
            if n < k:
                return
            rolled = rolled[:-1] * np.uint64(_P) + b64[k - 1:]
            if k in self.grams:
                inner = np.zeros(n - k + 1, dtype=bool)
                for j in range(1, k - 1):
                    inner |= space[j:n - k + 1 + j]
                inner |= space[:n - k + 1] & space[k - 1:]
                at = np.flatnonzero(~inner)
                yield at, self._slot(rolled[at], k)

    def of(self, text: str | None):
        """(slots, counts) of one text."""
        import numpy as np

        slots = [s for _, s in self.passes(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ")]
        return np.unique(np.concatenate(slots).astype(np.int32), return_counts=True)


@dataclass(frozen=True)
class Model:
    """Difference of the two classes' logits per hash slot, and the bias."""

    slots: bytes
    bias: float
    bits: int = BITS
    grams: tuple = GRAMS

    def scorer(self):
        import numpy as np

        table = np.frombuffer(self.slots, dtype=np.float32)
        features = Features(self.bits, self.grams)

        def some(texts: list[bytes]):
            data = b" " + b"  ".join(texts) + b" "
            lengths = np.array([len(t) + 2 for t in texts])
            ends = np.cumsum(lengths)
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for at, slot in features.passes(data, ends):
                doc = np.searchsorted(ends, at, side="right")
                # The last text has no separator after it, only the closing space.
                np.minimum(doc, len(texts) - 1, out=doc)
                total += np.bincount(doc, weights=table[slot.astype(np.int64)] if len(table) else None, minlength=len(texts))
                count += np.bincount(doc, minlength=len(texts))
            z = total / np.maximum(count, 1) * bool(len(table)) + self.bias
            return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

        def score(texts: list[str | None]):
            out, held, size = [], [], 0
            for t in texts:
                held.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1]) + 2
                if size > CHUNK:
                    out.append(some(held))
                    held, size = [], 0
            if held:
                out.append(some(held))
            return np.concatenate(out) if out else np.zeros(0)

        return score


def train(rows: list, y, weight, prior: float, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, bits: int = BITS):
    """Vectors and output layer from (slots, counts) per document: (logit per slot, bias).

    Each document's gradient is divided by its number of features, as is its mean.
    """
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (2, dim)).astype(np.float32), np.array([0.0, np.log(prior / (1 - prior))], dtype=np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, counts = rows[i]
            share = counts.astype(np.float32) / counts.sum()
            mean = share @ vectors[slots]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[i]
            now = 1 - done / steps
            back = p @ out
            vectors[slots] -= rate * now * share[:, None] * back[None, :]
            out -= 0.5 * now * np.outer(p, mean)
            bias -= 0.05 * now * p
            done += 1
    delta = (out[1] - out[0]) @ vectors.T
    return delta.astype(np.float32), float(bias[1] - bias[0])


def fit(sample: DataFrame, prior: float) -> Model:
    """Train on ``sample(text, label)``, a bounded set; ``prior``: share of label 1 in all labelled rows.

    With fewer than two rows of a class every score is ``prior``.
    """
    import math

    import numpy as np

    features = Features()

    def extract(labels, texts):
        found = [features.of(t) for t in texts.to_pylist()]
        return labels, [s.astype("<i4").tobytes() for s, _ in found], [c.astype("<u4").tobytes() for _, c in found]

    texts = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism)
    got = map_arrow(texts, ["label", "text"], "label int, slots binary, counts binary", extract)
    # Bounded by the rows of the sample and the number of slots.
    got = got.where("length(slots) > 0").orderBy("label", "slots", "counts").toArrow()
    y = got["label"].to_numpy().astype(np.int64)
    ones = int(y.sum())
    if min(ones, len(y) - ones) < 2:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(b"", math.log(p / (1 - p)))
    rows = [(np.frombuffer(s.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<u4")) for s, c in zip(got["slots"], got["counts"])]
    weight = np.where(y == 1, prior / (ones / len(y)), (1 - prior) / (1 - ones / len(y)))
    table, bias = train(rows, y, weight, prior)
    return Model(table.tobytes(), bias)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row, from whole texts; NULL scores like empty.

    A column of ``docs`` named score cannot be kept. A text's score does not depend on the rows beside it.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    # Of fixed size; plain values, so that executors need no copy of this module.
    sent = docs.sparkSession.sparkContext.broadcast((model.slots, model.bias, model.bits, model.grams))
    built, at = [], keep.index("text") if "text" in keep else len(keep)

    def run(*columns):
        if not built:
            built.append(Model(*sent.value).scorer())
        return *columns[:len(keep)], built[0](columns[at].to_pylist())

    return map_arrow(docs, list(keep) if at < len(keep) else [*keep, "text"], schema, run)
