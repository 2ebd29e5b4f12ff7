"""Exact bulk vector top-k: many queries against a table of any size.

Points stream through Arrow batches and are never shuffled. Every task scores its batches against a
block of queries, of checked size, by matrix products and keeps at most k rows per query. Where there
are many splits, a first pass over some of them gives each query a floor: the k-th similarity
found there. What lies below cannot be among the k best, so the other splits send few rows to the
final ranking. Queries beyond one block are stored once and met block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DISTANCE_DECIMALS, SIMILARITY_DECIMALS
from ..functions.geo import geodesic_numpy
from ..session import BROADCAST_ROWS, materialize
from .grid import covering_cells, with_cell

# Bytes of the vectors of one block of queries, which is broadcast.
BLOCK_BYTES = 64 << 20
# Blocks scored in one job.
BLOCKS_AT_ONCE = 16
# One split in so many is scored first, for the floors.
SAMPLE_EVERY = 16
# Similarity values held at once inside a task.
SCORES_AT_ONCE = 4_000_000

# A fusion setting is a symmetric coefficient matrix C over the vector parts:
# the fused dot product of a and b is the sum of C[i][j] * <a_i, b_j>.
PLAIN = {"plain": [[1.0]]}


def concat_setting(lam: float) -> list[list[float]]:
    """Cosine of the concatenation of a spatial part, repeated, and a semantic part."""
    return [[float(lam), 0.0], [0.0, 1.0]]


def weighted_setting(w_text: float, w_spatial: float) -> list[list[float]]:
    """Cosine of the weighted sum of a text part and a location part."""
    return [[w_text * w_text, w_text * w_spatial], [w_text * w_spatial, w_spatial * w_spatial]]


def _matrix(column):
    import numpy as np

    width = -1 if len(column) else 1
    return np.asarray(column.flatten(), dtype="float64").reshape(len(column), width)


def _searchable(batch, dims):
    """Rows whose vectors are present and as long as those of the queries.

    Tested here and not by a filter: a filter on a computed vector column would make
    the JVM compute the vectors twice.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for name, dim in dims.items():
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(name)), dim), False)
        if not pc.all(fits).as_py():
            batch = pa.RecordBatch.filter(batch, fits)
    return batch


def _query_block(table, parts, groups=None):
    """NumPy form of an Arrow table of queries."""
    import numpy as np

    table = table.combine_chunks()
    block = {"qid": np.asarray(table.column("qid"))}
    for name in ("lat", "lon", "radius_deg"):
        if name in table.column_names:
            block[name] = np.asarray(table.column(name), dtype="float64")
    for name in parts:
        chunks = table.column(name).chunks
        block[name] = _matrix(chunks[0]) if chunks else np.zeros((0, 1))
    if groups:
        members = {}
        for i, values in enumerate(table.column(groups).to_pylist()):
            for g in values or ():
                members.setdefault(g, []).append(i)
        block["members"] = {g: np.array(sorted(set(rows))) for g, rows in members.items()}
    return block


def _search(batches, block, parts, settings, k, payload, ranked_by_distance, groups=None, floors=None):
    """Local top-k of a stream of Arrow batches; yields one batch of survivors.

    With ``groups`` only pairs that share a value of that array column are scored. ``floors`` has a lower
    bound of the k-th similarity for each setting and query.
    """
    import numpy as np
    import pyarrow as pa

    n_queries = len(block["qid"])
    if n_queries == 0:
        return
    coefs = [np.asarray(c, dtype="float64") for c in settings]
    floor = np.full((len(coefs), n_queries), -np.inf) if floors is None else floors.copy()
    query_sq = [
        sum(c[i, j] * np.einsum("qd,qd->q", block[a], block[b])
            for i, a in enumerate(parts) for j, b in enumerate(parts) if c[i, j])
        for c in coefs
    ]
    held, held_rows = [], 0
    limit = max(4 * len(coefs) * n_queries * k, 100_000)

    def compact(batches_held):
        rows = pa.Table.from_batches(batches_held).combine_chunks().to_batches()[0]
        cols = {n: np.asarray(rows.column(n)) for n in ("_s", "_q", "similarity", "distance", "id")}
        order = np.lexsort((cols["id"], cols["distance"], -cols["similarity"], cols["_q"], cols["_s"]))
        group = cols["_s"][order].astype("int64") * n_queries + cols["_q"][order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        rank = np.arange(len(group)) - np.repeat(starts, sizes)
        kept = order[rank < k]
        full = starts[sizes >= k] + k - 1
        kth = order[full]
        floor[cols["_s"][kth], cols["_q"][kth]] = np.maximum(
            floor[cols["_s"][kth], cols["_q"][kth]], cols["similarity"][kth]
        )
        return rows.take(pa.array(kept))

    class Points:
        """A batch as arrays; ``finite`` marks rows whose vectors can be compared."""

        def __init__(self, batch):
            self.batch = batch
            self.mats = {p: _matrix(batch.column(p)) for p in parts}
            # A NaN would sort above every similarity and lift the floor of its query.
            self.finite = np.all([np.isfinite(m).all(axis=1) for m in self.mats.values()], axis=0)
            if not self.finite.all():
                self.mats = {p: np.where(self.finite[:, None], m, 0.0) for p, m in self.mats.items()}
            self.square = {
                (i, j): np.einsum("nd,nd->n", self.mats[a], self.mats[b])
                for i, a in enumerate(parts) for j, b in enumerate(parts) if any(c[i, j] for c in coefs)}
            if "lat" in block:
                self.lat, self.lon = (np.asarray(batch.column(n), dtype="float64") for n in ("lat", "lon"))

    def scored(points, rows, cols):
        """(setting, row, column, similarity) of the pairs of ``rows`` and ``cols`` at or above the floors."""
        mats = {p: m[rows] for p, m in points.mats.items()}
        finite = points.finite[rows]
        allowed = None if finite.all() else np.broadcast_to(finite[:, None], (len(finite), len(cols)))
        if "radius_deg" in block:
            dx = points.lon[rows][:, None] - block["lon"][None, cols]
            dy = points.lat[rows][:, None] - block["lat"][None, cols]
            radius = block["radius_deg"][None, cols]
            inside = np.isnan(radius) | (np.sqrt(dx * dx + dy * dy) <= radius)
            allowed = inside if allowed is None else inside & allowed
        grams = {}
        for s, c in enumerate(coefs):
            dots, point_sq = 0.0, 0.0
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    if not c[i, j]:
                        continue
                    if (i, j) not in grams:
                        grams[i, j] = mats[a] @ block[b][cols].T
                    dots = dots + c[i, j] * grams[i, j]
                    point_sq = point_sq + c[i, j] * points.square[i, j][rows]
            scale = np.sqrt(np.maximum(point_sq, 0))[:, None] * np.sqrt(np.maximum(query_sq[s][cols], 0))
            sims = np.divide(dots, scale, out=np.zeros_like(dots), where=scale != 0)
            sims = np.round(sims, SIMILARITY_DECIMALS)
            if allowed is not None:
                sims[~allowed] = -np.inf
            if len(sims) >= k:
                kth = np.partition(sims, len(sims) - k, axis=0)[len(sims) - k]
                floor[s, cols] = np.maximum(floor[s, cols], kth)
            at, to = np.nonzero((sims >= floor[s, cols]) & (sims > -np.inf))
            if len(at):
                yield s, rows[at], cols[to], sims[at, to]

    def rows_of(points, s, rows, cols, sims):
        if ranked_by_distance:
            far = geodesic_numpy(points.lat[rows], points.lon[rows], block["lat"][cols], block["lon"][cols])
            far = np.round(far, DISTANCE_DECIMALS)
        else:
            far = np.zeros(len(rows))
        part = points.batch.select(["id", *payload]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), s, dtype="int32")), pa.array(cols.astype("int64")), *part.columns, pa.array(far), pa.array(sims)],
            names=["_s", "_q", "id", *payload, "distance", "similarity"])

    def candidates(points):
        every = np.arange(points.batch.num_rows)
        if groups is None:
            step = max(1, SCORES_AT_ONCE // len(every))
            for lo in range(0, n_queries, step):
                for found in scored(points, every, np.arange(lo, min(lo + step, n_queries))):
                    yield rows_of(points, *found)
            return
        lists = points.batch.column(groups)
        values = np.asarray(lists.flatten())
        owner = np.repeat(every, np.diff(np.asarray(lists.offsets)))
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else []
        kept = {}
        for lo, hi in zip(starts, [*starts[1:], len(values)]):
            members = block["members"].get(values[lo].item())
            if members is None:
                continue
            rows = np.unique(owner[lo:hi])
            step = max(1, SCORES_AT_ONCE // len(rows))
            for at in range(0, len(members), step):
                for s, *found in scored(points, rows, members[at:at + step]):
                    kept.setdefault(s, []).append(found)
        for s, found in kept.items():
            rows, cols, sims = (np.concatenate(x) for x in zip(*found))
            # A pair may share several groups.
            _, once = np.unique(rows * n_queries + cols, return_index=True)
            yield rows_of(points, s, rows[once], cols[once], sims[once])

    for whole in batches:
        whole = _searchable(whole, {p: block[p].shape[1] for p in parts})
        if not whole.num_rows:
            continue
        for found in candidates(Points(whole)):
            held.append(found)
            held_rows += found.num_rows
            if held_rows > limit:
                held = [compact(held)]
                held_rows = held[0].num_rows
                limit = max(limit, 2 * held_rows)
    if held:
        best = compact(held)
        qid = pa.array(block["qid"][np.asarray(best.column("_q"))])
        yield pa.RecordBatch.from_arrays(
            [best.column("_s"), qid, *[best.column(n) for n in ("id", *payload, "distance", "similarity")]],
            names=["_s", "qid", "id", *payload, "distance", "similarity"],
        )


def vector_topk(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    parts: Sequence[str] = ("embedding",),
    settings: dict[str, list[list[float]]] | None = None,
    payload: Sequence[str] = ("tags",),
    groups: str | None = None,
    ranked_by_distance: bool = True,
    block_queries: int | None = None,
    floors: bool | None = None,
) -> DataFrame:
    """Top ``k`` points per query by cosine similarity, then distance, then id.

    ``points`` has id, lat, lon, the vector ``parts`` and the ``payload``; ``queries``
    has qid, lat, lon, vectors under the same names and optionally ``radius_deg``
    (NULL: no radius). ``settings`` names fusion coefficient matrices; all are scored
    in one pass over the stored parts. ``groups`` names an array column of both sides of
    which a candidate must share one value: only such pairs are scored. Point vectors that
    are NULL, not finite or of another length than the query vectors are not searched;
    such query vectors are refused, whatever the number of queries.

    A block of queries takes ``BLOCK_BYTES``, or ``block_queries`` rows. ``floors`` asks for the
    first pass; by default it is made where the points have enough splits for it to pay.
    """
    names = list(settings or PLAIN)
    found = vector_candidates(
        points, queries, k, parts, settings, payload, groups, ranked_by_distance, block_queries, floors)
    ranked = _ranked(found, k)
    if settings:
        labels = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_s") + 1)
        ranked = ranked.withColumn("setting", labels)
    if not ranked_by_distance:
        ranked = ranked.drop("distance")
    return ranked.drop("_s")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_s", "qid").orderBy(F.desc("similarity"), "distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_candidates(
    points, queries, k, parts=("embedding",), settings=None, payload=("tags",), groups=None,
    ranked_by_distance=True, block_queries=None, floors=None,
) -> DataFrame:
    """What the scoring tasks of ``vector_topk`` send to the final ranking: every task's own best rows."""
    coefs = list((settings or PLAIN).values())
    in_radius = "radius_deg" in queries.columns
    place = ["lat", "lon"] if ranked_by_distance or in_radius else []
    group_cols = [groups] if groups else []
    query_cols = ["qid", *place, *(["radius_deg"] if in_radius else []), *parts, *group_cols]
    queries = queries.select(query_cols)
    width = _check_queries(queries, parts)
    extra = [c for c in payload if c not in ("id",)]
    wanted = list(dict.fromkeys(["id", *place, *parts, *group_cols, *extra]))
    fields = {f.name: f for f in points.schema}

    def schema(columns):
        return T.StructType(
            [T.StructField("_s", T.IntegerType()), T.StructField("qid", T.LongType()),
             T.StructField("id", fields["id"].dataType)]
            + [T.StructField(c, fields[c].dataType) for c in columns]
            + [T.StructField("distance", T.DoubleType()), T.StructField("similarity", T.DoubleType())]
        )

    def score(live, head):
        """One block of queries, an Arrow table, against all points."""
        block = _query_block(head, parts, groups)
        if in_radius and not groups and head.num_rows:
            live = _near_any_query(live, spark.createDataFrame(head.select([c for c in head.column_names if c not in parts])), head)
        live = live.select(wanted)
        shared = spark.sparkContext.broadcast(block)
        args = (list(parts), coefs, k)
        lower = None
        splits = None if floors is not None else _splits(live)
        if floors or (floors is None and splits is not None and splits >= 2 * SAMPLE_EVERY):
            def first(batches):
                from pyspark import TaskContext

                if TaskContext.get().partitionId() % SAMPLE_EVERY == 0:
                    yield from _search(batches, shared.value, *args, [], ranked_by_distance, groups)

            # At most one row per query of the block and setting.
            sample = _ranked(live.mapInArrow(first, schema([])), k).where(F.col("rank") == k)
            lower = _floors(block, sample.select("_s", "qid", "similarity").toArrow(), len(coefs))
        bound = spark.sparkContext.broadcast(lower)
        return live.mapInArrow(
            lambda batches: _search(batches, shared.value, *args, extra, ranked_by_distance, groups, bound.value), schema(extra))

    spark = points.sparkSession
    size = block_queries or max(1, BLOCK_BYTES // (8 * max(1, width)))
    # Bounded: one block of queries and one row more.
    head = queries.limit(size + 1).toArrow()
    if head.num_rows <= size:
        return score(points, head)
    blocks = -(-queries.count() // size)
    asked = materialize(
        queries.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "query-blocks", ("_qb",))
    if not _is_scan(points):
        points = materialize(points.select(wanted), "topk-points")
    found, group = None, None
    for b in range(blocks):
        part = score(points, asked.where(F.col("_qb") == b).select(query_cols).toArrow())
        group = part if group is None else group.unionByName(part)
        if (b + 1) % BLOCKS_AT_ONCE == 0 or b + 1 == blocks:
            if blocks > BLOCKS_AT_ONCE:
                group = materialize(group, "topk-blocks")
            found = group if found is None else found.unionByName(group)
            group = None
    return found


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _is_scan(df: DataFrame) -> bool:
    """Whether reading the frame again costs no more than its scan."""
    return not any(x in _plan(df) for x in ("Exchange", "Arrow", "Python", "Generate", "ExistingRDD"))


def _splits(df: DataFrame) -> int | None:
    """Splits of a frame that no exchange stands before; None where counting them would run a job."""
    return None if "Exchange" in _plan(df) else df.rdd.getNumPartitions()


def _floors(block, table, settings: int):
    import numpy as np

    lower = np.full((settings, len(block["qid"])), -np.inf)
    at = {q: i for i, q in enumerate(block["qid"].tolist())}
    for s, q, sim in zip(*(table.column(c).to_pylist() for c in ("_s", "qid", "similarity"))):
        lower[s, at[q]] = sim
    return lower


def _near_any_query(points, queries, head):
    """Points in a grid cell that some query circle touches; all if one has no radius."""
    import numpy as np

    radius = np.asarray(head.column("radius_deg"), dtype="float64")
    if np.isnan(radius).any():
        return points
    lat, lon = (np.asarray(head.column(n), dtype="float64") for n in ("lat", "lon"))
    size = float(radius.max())
    boxed = points.where(
        F.col("lat").between(float((lat - radius).min()), float((lat + radius).max()))
        & F.col("lon").between(float((lon - radius).min()), float((lon + radius).max()))
    )
    if size <= 0 or 9 * head.num_rows > BROADCAST_ROWS:
        return boxed
    # At most nine cells per query, so the broadcast side is bounded by the block.
    cells = covering_cells(queries, size).select("cy", "cx").distinct()
    return with_cell(boxed, size).join(F.broadcast(cells), ["cy", "cx"], "left_semi").drop("cy", "cx")


def _check_queries(queries, parts):
    """The values of a query's vectors together. One pass over all queries checks that their vectors are
    present, finite and of one length."""
    def bad(name):
        return F.col(name).isNull() | F.exists(name, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))

    facts = queries.agg(*[
        x for i, p in enumerate(parts)
        for x in (F.count_if(bad(p)).alias(f"bad{i}"), F.min(F.size(p)).alias(f"low{i}"), F.max(F.size(p)).alias(f"high{i}"))
    ]).first()
    for i, p in enumerate(parts):
        if facts[f"bad{i}"]:
            raise ValueError(f"query vectors {p!r} must not be NULL and must be finite")
        if facts[f"low{i}"] != facts[f"high{i}"]:
            raise ValueError(f"query vectors {p!r} must have one length")
    return sum(facts[f"high{i}"] or 0 for i in range(len(parts)))
