"""Text and coordinate encoders, as jobs over point or query tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BANDS, EMPTY_TEXT
from ..functions.geo import sinusoidal_features
from ..functions.tags import tag_text
from ..functions.text import strip
from ..functions.vectors import weighted_fuse

EMBEDDING_TYPE = T.ArrayType(T.FloatType())
NORM_EPS = 1e-6


def _rows_to_arrow(matrix):
    import numpy as np
    import pyarrow as pa

    matrix = np.ascontiguousarray(matrix, dtype="float32")
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def _map_vectors(
    df: DataFrame, inputs: list[str], out: str, fn: Callable, keep: Sequence[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (default: all but the inputs) and vector column ``out`` = fn(inputs).

    Only these columns cross to Python, batch by batch.
    """
    keep = [c for c in (keep or df.columns) if c != out and (keep is not None or c not in inputs)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, EMBEDDING_TYPE)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                vectors = _rows_to_arrow(fn(*[batch.column(c) for c in inputs]))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [vectors], names=[*keep, out])

    return df.select(*keep, *[c for c in inputs if c not in keep]).mapInArrow(run, schema)


def hashed_tokens(text) -> Column:
    """Hash of every token of a text: 32 bits of its MD5, portable to any SQL engine."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    tokens = F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))


@dataclass(frozen=True)
class HashingEncoder:
    """Signed feature hashing of tokens to unit vectors: the default text encoder.

    Tokens are cut and hashed in the JVM; a task only scatters numbers. Blank text
    counts as ``poi``.
    """

    dim: int = 384

    def __call__(
        self, df: DataFrame, text: str, out: str = "embedding", keep: Sequence[str] | None = None
    ) -> DataFrame:
        dim = self.dim
        words = F.when(strip(F.coalesce(text, F.lit(""))) != "", F.col(text)).otherwise(F.lit(EMPTY_TEXT))
        hashed = df.withColumn("_hash", hashed_tokens(words))

        def scatter(lists):
            import numpy as np

            values = np.asarray(lists.flatten(), dtype="int64")
            sizes = np.diff(np.asarray(lists.offsets))
            rows = np.repeat(np.arange(len(lists)), sizes)
            sign = 1.0 - 2.0 * ((values // dim) % 2)
            flat = np.bincount(rows * dim + values % dim, weights=sign, minlength=len(lists) * dim)
            matrix = flat.reshape(len(lists), dim)
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm != 0)

        return _map_vectors(hashed, ["_hash"], out, scatter, keep)


@dataclass(frozen=True)
class ModelEncoder:
    """Plug for a pretrained text model.

    ``load`` returns a function from a list of texts to a 2-D array. It is called once
    per task, so the model is loaded on the executors.
    """

    load: Callable[[], Callable]
    batch_size: int = 1024

    def __call__(
        self, df: DataFrame, text: str, out: str = "embedding", keep: Sequence[str] | None = None
    ) -> DataFrame:
        words = F.when(strip(F.coalesce(text, F.lit(""))) != "", F.col(text)).otherwise(F.lit(EMPTY_TEXT))
        load, size, model = self.load, self.batch_size, []

        def encode(texts):
            import numpy as np

            if not model:
                model.append(load())
            values = texts.to_pylist()
            return np.vstack([model[0](values[i:i + size]) for i in range(0, len(values), size)])

        return _map_vectors(df.withColumn("_text", words), ["_text"], out, encode, keep)


@dataclass
class Projection:
    """Weights of the text projection and of the location network (tens of thousands)."""

    text_w: object
    text_b: object
    loc_w1: object
    loc_b1: object
    loc_w2: object
    loc_b2: object
    log_scale: float
    bands: tuple = field(default=BANDS)

    @staticmethod
    def initial(text_dim: int, dim: int = 128, hidden: int = 128, bands=BANDS, seed: int = 0) -> Projection:
        """Uniform initial weights within 1/sqrt(inputs), scale 1/0.07."""
        import numpy as np

        rng = np.random.default_rng(seed)

        def layer(n_out, n_in):
            bound = 1.0 / np.sqrt(n_in)
            return rng.uniform(-bound, bound, (n_out, n_in)), rng.uniform(-bound, bound, n_out)

        text = layer(dim, text_dim)
        first, second = layer(hidden, 4 * len(bands)), layer(dim, hidden)
        return Projection(*text, *first, *second, float(np.log(1 / 0.07)), tuple(bands))

    def text(self, x):
        return _unit(x @ self.text_w.T + self.text_b)

    def location(self, features):
        import numpy as np

        hidden = np.maximum(features @ self.loc_w1.T + self.loc_b1, 0.0)
        return _unit(hidden @ self.loc_w2.T + self.loc_b2)


def _unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)


def _apply(df: DataFrame, weights: Projection, method: str, column: str, out: str, keep=None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(vectors):
        import numpy as np

        rows = np.asarray(vectors.flatten(), dtype="float64").reshape(len(vectors), -1)
        return getattr(shared.value, method)(rows)

    return _map_vectors(df, [column], out, run, keep)


def encode_text(df: DataFrame, weights: Projection, vector: str, out: str = "zt") -> DataFrame:
    """Unit linear projection of text vectors."""
    return _apply(df, weights, "text", vector, out, df.columns)


def encode_coords(df: DataFrame, weights: Projection, out: str = "zl") -> DataFrame:
    """Unit output of the location network over sinusoidal features of lat and lon."""
    features = df.withColumn("_features", sinusoidal_features("lat", "lon", weights.bands))
    return _apply(features, weights, "location", "_features", out, df.columns)


def semantic_embed(points: DataFrame, encoder=None, variant: str = "all", drop_empty: bool = False) -> DataFrame:
    """(id, embedding) of the tag text of points; points without tags read ``poi``."""
    if drop_empty:
        points = points.where(F.size("tags") > 0)
    texts = points.select("id", tag_text("tags", variant).alias("text"))
    return (encoder or HashingEncoder())(texts, "text", keep=["id"])


def encode_pair(
    df: DataFrame, weights: Projection, text: str = "text", encoder=None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add separate text and coordinate embeddings zt and zl."""
    encoder = encoder or HashingEncoder(weights.text_w.shape[1])
    keep = list(df.columns if keep is None else keep)
    projected = _apply(encoder(df, text, "_e", keep), weights, "text", "_e", "zt", keep)
    return encode_coords(projected, weights)


def contrastive_embed(
    points: DataFrame, weights: Projection, w_text: float = 1.0, w_spatial: float = 1.0, encoder=None
) -> DataFrame:
    """(id, embedding): fused text and location embedding of points."""
    texts = points.select("id", "lat", "lon", tag_text("tags", "scalar").alias("text"))
    pair = encode_pair(texts, weights, "text", encoder, ["id", "lat", "lon"])
    fused = weighted_fuse("zt", "zl", w_text, w_spatial).cast(EMBEDDING_TYPE)
    return pair.select("id", fused.alias("embedding"))


def contrastive_queries(
    queries: DataFrame, weights: Projection, w_text: float = 1.0, w_spatial: float = 1.0, encoder=None
) -> DataFrame:
    """Queries (qid, text, lat, lon) with their fused embedding; blank text reads ``poi``."""
    pair = encode_pair(queries, weights, "text", encoder)
    fused = weighted_fuse("zt", "zl", w_text, w_spatial).cast(EMBEDDING_TYPE)
    return pair.withColumn("embedding", fused).drop("zt", "zl")
