"""Contrastive training of the text projection and the location network."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .encode import NORM_EPS, Projection

MIN_SCALE, MAX_SCALE = 1e-3, 100.0
# AdamW decay rates and denominator term.
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8

# Batches whose gradients make one step.
WORKERS = 8
# Most bytes of the matrices of one batch, held by one task.
BATCH_BYTES = 1 << 30
# Steps whose rows are dealt out by one shuffle.
STEPS_AT_ONCE = 512
# Most bytes of a stored chunk of rows, and about the bytes of the rows that a task sorts or makes a step of.
CHUNK_BYTES, TASK_BYTES = 1 << 20, 64 << 20
# Most bytes of the tasks' gradients that the driver sums in a step.
GRADIENT_BYTES = 64 << 20

_PARAMS = ("text_w", "text_b", "loc_w1", "loc_b1", "loc_w2", "loc_b2", "log_scale")


def _cross_entropy(logits):
    """Mean cross-entropy with the diagonal as target, and row softmax."""
    import numpy as np

    top = logits.max(axis=1, keepdims=True)
    weights = np.exp(logits - top)
    total = weights.sum(axis=1, keepdims=True)
    return float(np.mean(np.log(total[:, 0]) + top[:, 0] - np.diag(logits))), weights / total


def info_nce(zt, zl, log_scale: float) -> float:
    """Symmetric InfoNCE loss of one batch of unit text and location vectors."""
    import numpy as np

    scale = min(max(float(np.exp(log_scale)), MIN_SCALE), MAX_SCALE)
    logits = scale * (zt @ zl.T)
    return 0.5 * (_cross_entropy(logits)[0] + _cross_entropy(logits.T)[0])


def _check_batch(rows: int, batch_bytes: int) -> None:
    """A batch needs five square matrices of its rows; refused if they take more than the bytes allowed."""
    if 40 * rows * rows > batch_bytes:
        raise ValueError(f"a training batch of {rows} rows needs more than {batch_bytes} bytes")


def info_nce_loss(
    pairs: DataFrame, log_scale: float, text: str = "zt", location: str = "zl", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(batch_id, n, loss) per training batch. A batch is one task's work; ``batch_bytes`` bounds its matrices."""
    def per_batch(table):
        import numpy as np
        import pyarrow as pa

        _check_batch(table.num_rows, batch_bytes)
        table = table.combine_chunks()
        zt, zl = (
            np.asarray(table.column(c).chunk(0).flatten(), dtype="float64").reshape(table.num_rows, -1)
            for c in (text, location)
        )
        return pa.table({
            "batch_id": table.column("batch_id").slice(0, 1).cast(pa.int64()),
            "n": pa.array([table.num_rows], pa.int64()), "loss": [info_nce(zt, zl, log_scale)],
        })

    rows = pairs.select(F.col("batch_id").cast("long").alias("batch_id"), text, location)
    return rows.groupBy("batch_id").applyInArrow(per_batch, "batch_id long, n long, loss double")


def batch_step(params: dict, x, f, room=None):
    """Loss and gradients of one batch of text vectors ``x`` and location features ``f``.

    ``room`` has 2 * n * n doubles that batches use one after another, as fresh memory takes longer than the sums in it.
    """
    import numpy as np

    n = len(x)
    soft, weight = (np.empty(2 * n * n) if room is None else room[:2 * n * n]).reshape(2, n, n)
    yt = x @ params["text_w"].T + params["text_b"]
    pre = f @ params["loc_w1"].T + params["loc_b1"]
    hidden = np.maximum(pre, 0.0)
    yl = hidden @ params["loc_w2"].T + params["loc_b2"]
    nt, nl = (np.maximum(np.linalg.norm(y, axis=1, keepdims=True), NORM_EPS) for y in (yt, yl))
    zt, zl = yt / nt, yl / nl
    raw = float(np.exp(params["log_scale"][0]))
    scale = min(max(raw, MIN_SCALE), MAX_SCALE)
    # A cosine is at most 1, so exp(scale * (cos - 1)) serves rows and columns: at least exp(-2 * MAX_SCALE).
    np.matmul(zt, zl.T, out=soft)
    own = float(soft.trace()) / n
    soft -= 1.0
    soft *= scale
    np.exp(soft, out=soft)
    down, across = soft.sum(axis=1), soft.sum(axis=0)
    loss = 0.5 * float(np.mean(np.log(down) + np.log(across))) + scale * (1.0 - own)
    soft *= np.add.outer(1.0 / down, 1.0 / across, out=weight)
    d_zt, d_zl = ((scale / n) * (0.5 * (s @ z) - z) for s, z in ((soft, zl), (soft.T, zt)))
    along_t, along_l = (np.sum(z * d, axis=1, keepdims=True) for z, d in ((zt, d_zt), (zl, d_zl)))
    d_yt, d_yl = (d_zt - zt * along_t) / nt, (d_zl - zl * along_l) / nl
    d_pre = (d_yl @ params["loc_w2"]) * (pre > 0)
    inside = MIN_SCALE < raw < MAX_SCALE
    grads = {
        "text_w": d_yt.T @ x, "text_b": d_yt.sum(axis=0),
        "loc_w1": d_pre.T @ f, "loc_b1": d_pre.sum(axis=0),
        "loc_w2": d_yl.T @ hidden, "loc_b2": d_yl.sum(axis=0),
        "log_scale": np.array([along_t.sum() if inside else 0.0]),
    }
    return loss, grads


def adamw(params, first, second, grads, step, lr, decay):
    """One AdamW update, in place."""
    import numpy as np

    for name, grad in grads.items():
        params[name] *= 1 - lr * decay
        first[name] += (1 - BETA1) * (grad - first[name])
        second[name] += (1 - BETA2) * (grad * grad - second[name])
        mean = first[name] / (1 - BETA1**step)
        spread = np.sqrt(second[name] / (1 - BETA2**step))
        params[name] -= lr * mean / (spread + ADAM_EPS)


def parameters(weights: Projection) -> dict:
    """The weights as named arrays, copies that a step may change."""
    import numpy as np

    return {n: np.array(np.atleast_1d(getattr(weights, n)), dtype="float64") for n in _PARAMS}


def step_gradient(rows: DataFrame, params: dict, batch_bytes: int = BATCH_BYTES) -> tuple[float, dict, int]:
    """Mean loss and mean gradients over the batches of ``rows(batch_id, id, vector, features)``, and their number.

    A task computes a batch, in order of id; gradients are summed by Spark, first within tasks and then over
    groups of them, so the driver receives one gradient.
    """
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(params)

    def per_batch(table):
        import numpy as np
        import pyarrow as pa

        _check_batch(table.num_rows, batch_bytes)
        table = table.sort_by("id").combine_chunks()
        x, f = (np.asarray(table.column(c).chunk(0).flatten(), dtype="float64").reshape(table.num_rows, -1)
                for c in ("vector", "features"))
        loss, grads = batch_step(shared.value, x, f)
        flat = np.concatenate([grads[n].reshape(-1) for n in _PARAMS])
        return pa.table({"loss": pa.array([loss]), "gradient": pa.array([flat])})

    found = rows.groupBy("batch_id").applyInArrow(per_batch, "loss double, gradient array<double>")
    vector = array_to_vector("gradient")
    groups = found.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("_g").agg(
        F.sum("loss").alias("loss"), F.count("*").alias("n"), Summarizer.sum(vector).alias("gradient"))
    # Grouped, so that no batch gives no row.
    total = groups.withColumn("_all", F.lit(True)).groupBy("_all").agg(
        F.sum("loss").alias("loss"), F.sum("n").alias("n"),
        vector_to_array(Summarizer.sum(F.col("gradient"))).alias("gradient")).first()
    if total is None:
        return 0.0, {}, 0
    flat, grads, at = np.asarray(total["gradient"]) / total["n"], {}, 0
    for name in _PARAMS:
        size = params[name].size
        grads[name] = flat[at:at + size].reshape(params[name].shape)
        at += size
    return total["loss"] / total["n"], grads, total["n"]


def _packed(values, kind: str) -> bytes:
    """Compressed bytes of an array."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), "lz4", asbytes=True)


def _unpacked(value, kind: str, *shape: int):
    """The array of ``_packed`` bytes."""
    import numpy as np
    import pyarrow as pa

    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(bytes(value), size, "lz4"), kind).reshape(shape)


def _layout(rows: DataFrame, width: int, workers: int) -> tuple[int, str, str]:
    """Numbers of a vector, and the narrowest number types that hold its values and those of batches."""
    vector = "float32" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "float64"
    return width, vector, "uint8" if workers <= 1 << 8 else "uint16" if workers <= 1 << 16 else "int32"


def _row_bytes(layout: tuple[int, str, str]) -> int:
    return layout[0] * (4 if layout[1] == "float32" else 8) + 24


def _packed_chunks(tables, epochs: int, layout: tuple[int, str, str]):
    """One row per chunk of a bucket's rows, of a stream sorted by bucket: arrays as bytes, the batches by epoch."""
    import numpy as np
    import pyarrow as pa

    width, kind, batch_kind = layout
    at_once = max(1, CHUNK_BYTES // _row_bytes(layout))
    names = ["_bucket", "chunk", "n", "vector", "place", *[f"batch_{e}" for e in range(1, epochs + 1)]]
    last, chunk = None, 0
    for table in tables:
        n, lists = table.num_rows, table.column("vector")
        if not n:
            continue
        if lists.null_count or (np.diff(np.asarray(lists.offsets)) != width).any():
            raise ValueError(f"a training vector is NULL or has not {width} numbers")
        keys, vectors = np.asarray(table.column("_bucket")), np.asarray(lists.flatten()).reshape(n, width)
        place = np.stack([table.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon")])
        batches = np.asarray(table.column("_batches").flatten()).reshape(n, -1)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), n]
        for begin, end in zip(cuts, cuts[1:]):
            for lo in range(begin, end, at_once):
                hi = min(end, lo + at_once)
                last, chunk = keys[lo], chunk + 1 if keys[lo] == last else 0
                numbers = [pa.array([v], pa.int32()) for v in (last, chunk, hi - lo)]
                values = [_packed(vectors[lo:hi], kind), _packed(place[:, lo:hi], "float64"),
                          *[_packed(batches[lo:hi, e], batch_kind) for e in range(epochs)]]
                yield pa.RecordBatch.from_arrays(numbers + [pa.array([v], pa.binary()) for v in values], names=names)


def _store_buckets(
    rows: DataFrame, n: int, buckets: int, workers: int, epochs: int, seed: int, layout: tuple[int, str, str]
) -> DataFrame:
    """The ``n`` rows by bucket and in order of id, stored as chunks with the batch of every row in every epoch."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)).cast("int")
    batches = F.transform(F.sequence(F.lit(1), F.lit(max(1, epochs))), lambda e: F.pmod(
        F.xxhash64(F.lit(seed + 1), e, "id"), F.lit(workers)).cast("int"))
    parts = max(min(buckets, rows.sparkSession.sparkContext.defaultParallelism), n * _row_bytes(layout) // TASK_BYTES)
    ordered = rows.withColumn("_bucket", bucket).repartition(parts, "_bucket").sortWithinPartitions("_bucket", "id")
    schema = "_bucket int, chunk int, n int, vector binary, place binary" + "".join(
        f", batch_{e} binary" for e in range(1, epochs + 1))
    chunks = ordered.select("_bucket", "vector", "lat", "lon", batches.alias("_batches")).mapInArrow(
        lambda tables: _packed_chunks(tables, epochs, layout), schema)
    return materialize(chunks, "training", ("_bucket",))


def _deal(stored: DataFrame, visited: list[int], epoch: int, tasks: int, layout: tuple[int, str, str]):
    """The rows of the visited buckets as an RDD; partition ``step * tasks + batch % tasks`` has a batch of a step.

    A chunk is cut into a piece (chunk, n, vector, place, batch) for every task, so pieces are shuffled, not rows.
    """
    width, kind, batch_kind = layout
    step = {b: i for i, b in enumerate(visited)}

    def pieces(chunks):
        import numpy as np

        for bucket, chunk, n, vector, place, batch in chunks:
            vector, place = _unpacked(vector, kind, n, width), _unpacked(place, "float64", 2, n)
            batch = _unpacked(batch, batch_kind, n)
            task = batch % tasks
            for t in np.unique(task).tolist():
                mine = np.flatnonzero(task == t)
                yield step[bucket] * tasks + t, (
                    chunk, len(mine), _packed(vector[mine], kind), _packed(place[:, mine], "float64"),
                    _packed(batch[mine], batch_kind))

    chunks = stored.where(F.col("_bucket").isin(visited)).select(
        "_bucket", "chunk", "n", "vector", "place", f"batch_{epoch}")
    return chunks.rdd.mapPartitions(pieces).partitionBy(len(visited) * tasks, int)


def features_of(lat, lon, bands):
    """``sinusoidal_features`` of arrays, a row for each place."""
    import numpy as np

    angles = [np.multiply.outer(np.radians(a), np.asarray(bands, dtype="float64")) for a in (lon, lat)]
    return np.concatenate([fn(a) for a in angles for fn in (np.sin, np.cos)], axis=1)


def _partial_gradient(params: dict, bands: tuple, layout: tuple[int, str, str], batch_bytes: int):
    """The function of a task: (loss, batches, gradient), summed over the batches of its pieces."""
    width, kind, batch_kind = layout

    def run(pieces):
        import gc

        import numpy as np

        # A worker collects garbage after every task; looking through all modules takes it longer than a step.
        if not gc.get_freeze_count():
            gc.collect()
            gc.freeze()
        held = sorted((piece for _, piece in pieces), key=lambda piece: piece[0])
        if not held:
            return
        batch = np.concatenate([_unpacked(b, batch_kind, n) for _, n, _, _, b in held])
        x = np.concatenate([_unpacked(v, kind, n, width) for _, n, v, _, _ in held])
        lat, lon = np.concatenate([_unpacked(p, "float64", 2, n) for _, n, _, p, _ in held], axis=1)
        order = np.argsort(batch, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(batch[order])) + 1).tolist(), len(order)]
        widest = int(np.diff(cuts).max())
        _check_batch(widest, batch_bytes)
        total, room = 0.0, np.empty(2 * widest * widest)
        for lo, hi in zip(cuts, cuts[1:]):
            mine = order[lo:hi]
            loss, grads = batch_step(params, x[mine].astype("float64"), features_of(lat[mine], lon[mine], bands), room)
            total = total + np.concatenate([[loss, 1.0], *[grads[n].reshape(-1) for n in _PARAMS]])
        yield total.tobytes()

    return run


def _run_steps(dealt, steps: int, tasks: int, layout: tuple, state: dict, lr: float, decay: float, batch_bytes: int) -> None:
    """Makes ``steps`` AdamW steps over the rows that ``_deal`` dealt out, changing ``state``.

    A step is a job of one stage that reads the partitions of its own rows. A task sums the gradients
    of its batches, and the driver the sums of the tasks.
    """
    import numpy as np

    params = state["params"]
    for at in range(steps):
        run = _partial_gradient(params, state["bands"], layout, batch_bytes)
        sums = dealt.context.runJob(dealt, run, list(range(at * tasks, (at + 1) * tasks)))
        if not sums:
            continue
        total = np.sum([np.frombuffer(x) for x in sums], axis=0)
        grads, place, seen = {}, 2, int(total[1])
        for name in _PARAMS:
            shape = params[name].shape
            grads[name] = total[place:place + params[name].size].reshape(shape) / seen
            place += params[name].size
        state["step"] += 1
        adamw(params, state["first"], state["second"], grads, state["step"], lr, decay)
        state["loss"], state["batches"] = state["loss"] + float(total[0]), state["batches"] + seen


def train(
    pairs: DataFrame,
    weights: Projection,
    epochs: int = 7,
    batch_size: int = 256,
    lr: float = 1e-4,
    decay: float = 0.01,
    workers: int = WORKERS,
    seed: int = 0,
) -> tuple[Projection, list[tuple[int, float, float]]]:
    """Train on (id, vector, lat, lon); returns weights and (epoch, loss, temperature).

    One sequence of AdamW steps over the whole cluster. Each step takes the mean gradient of up to
    ``workers`` batches, every batch contrasted within itself, and all following steps see
    the update; with one worker a step is one batch. Rows are dealt by hash to stored buckets, one
    for each step of an epoch, once. An epoch visits the buckets in an order of its
    own and deals a bucket's rows anew to its batches, those of ``STEPS_AT_ONCE`` steps
    by one shuffle, from which each step reads its own rows. A batch has ``batch_size`` rows on average,
    as they are dealt by hash. ``workers`` belongs to the training, not to the cluster: the weights do not
    depend on the number of cores.
    """
    import numpy as np

    rows = materialize(pairs.select("id", "vector", "lat", "lon"), "training-rows")
    n = rows.count()
    workers = max(1, min(workers, n // batch_size))
    buckets = max(1, n // (batch_size * workers))
    params = parameters(weights)
    layout = _layout(rows, params["text_w"].shape[1], workers)
    stored = _store_buckets(rows, n, buckets, workers, epochs, seed, layout)
    # Tasks of a step: one for a slot, more where their rows take too much, fewer where their gradients do.
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, batch_size * workers * _row_bytes(layout) // TASK_BYTES)
    size = sum(params[name].size for name in _PARAMS)
    tasks = max(1, min(workers, wanted, GRADIENT_BYTES // (8 * (size + 2))))
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    state = {"params": params, "first": first, "second": second, "step": 0, "bands": weights.bands}
    history = []
    for epoch in range(1, epochs + 1):
        state |= {"loss": 0.0, "batches": 0}
        order = np.random.default_rng([seed, epoch]).permutation(buckets).tolist()
        for lo in range(0, buckets, STEPS_AT_ONCE):
            visited = order[lo:lo + STEPS_AT_ONCE]
            _run_steps(_deal(stored, visited, epoch, tasks, layout), len(visited), tasks, layout, state, lr, decay, BATCH_BYTES)
        if not state["batches"]:
            break
        history.append((epoch, state["loss"] / state["batches"], float(np.exp(state["params"]["log_scale"][0]))))
    trained = Projection(
        *[params[n] for n in _PARAMS[:-1]], log_scale=float(params["log_scale"][0]), bands=weights.bands
    )
    return trained, history
