"""Merkle manifest of a dataset, laid out by bitmap ranks.

The tree needs every row's place among the rows of its group in order of id. Rows are not sorted for
that: the ids of a group are gathered into compressed bitmaps of ``2**BUCKET_BITS`` ids, merged from the
partial ones of all tasks. Popcount directories of the bitmaps, one level for every ``DIRECTORY_BITS``
further bits of the id, give the number of rows before a bitmap, and the bits before an id the rest.
A place is then a block and a slot of it: blocks of ``ARITY**LEVELS`` slots are keyed arrays, each reduced
by one task to its top node, and those tops are the slots of the next blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize
from .common import lower_ascii

ARITY, LEVELS = 8, 4
#: Slots of a block, reduced in one task.
BLOCK = ARITY**LEVELS
#: Bits of an id within a bitmap (Spark's own bitmap functions hold so many), and of a directory level.
BUCKET_BITS, DIRECTORY_BITS = 15, 12
#: A bitmap of fewer ids is a sorted list of positions.
SPARSE = 512
#: Copies of one leaf laid out by one task.
COPIES = 65_536
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256, as lowercase hex, of the fields: ``-`` if NULL, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for column in columns.values():
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tamper_every: int = 3) -> DataFrame:
    """(lang, doc_id, leaf, tampered): digests as bytes; ``tampered`` is the leaf of the lower-cased text where
    ``tamper_every`` divides the id's crc32, else NULL. Rows without an id are not tampered with."""
    plain = {c: F.col(c) for c in FIELDS}
    changed = {**plain, "text": lower_ascii(F.col("text"))}
    hit = F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0
    return docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf(plain)).alias("leaf"), F.when(hit, F.unhex(leaf(changed))).alias("tampered"))


def _before(counts: DataFrame, group: str, key: str) -> DataFrame:
    """``counts(group, key, n)`` with ``base``: the sum of n of smaller keys of the group.

    A window holds at most ``2**DIRECTORY_BITS`` keys: those of one parent. The parents' own bases come
    from the directory above; above the last one there is a single key.
    """
    table = counts.withColumn("parent", F.shiftright(key, DIRECTORY_BITS))
    inside = Window.partitionBy(group, "parent").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    above = materialize(counts.groupBy(group, F.shiftright(key, DIRECTORY_BITS).alias(key)).agg(F.sum("n").alias("n")), "directory")
    if above.groupBy(group).count().where("count > 1").isEmpty():
        return table.drop("parent")
    tops = _before(above, group, key).select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col("base").alias("__above"))
    met = table.join(tops, F.col(group).eqNullSafe(F.col("__g")) & (F.col("parent") == F.col("__k")))
    return met.withColumn("base", F.col("base") + F.col("__above")).drop("__g", "__k", "__above", "parent")


def ranked(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with ``rank``: how many rows of its group have a smaller ``key`` (a long), and ``size``, the
    rows of the group. Rows of one key share a rank. The group may be NULL; the key may not."""
    # The sign bit is turned, so that buckets ascend from 0 and negative keys come first.
    bucket = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), BUCKET_BITS)
    bit = F.col(key).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1).cast("long"))
    ids = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    maps = ids.select(group, bucket.alias("bucket"), bit.alias("bit"), "n").groupBy(group, "bucket").agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct"), F.bitmap_construct_agg("bit").alias("bits"),
        F.sort_array(F.collect_list(F.col("bit").cast("int"))).alias("list"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.struct(F.col("bit").cast("int").alias("bit"), (F.col("n") - 1).alias("more"))))).alias("extra"))
    maps = materialize(maps.select(
        group, "bucket", "n", F.when(F.col("distinct") >= SPARSE, F.col("bits")).alias("bits"),
        F.when(F.col("distinct") < SPARSE, F.col("list")).alias("list"), "extra"), "bitmaps")
    based = _before(maps.select(group, "bucket", "n"), group, "bucket").select(
        F.col(group).alias("__g"), F.col("bucket").alias("__b"), "base")
    sizes = maps.groupBy(F.col(group).alias("__s")).agg(F.sum("n").alias("size"))
    index = maps.join(based, F.col(group).eqNullSafe(F.col("__g")) & (F.col("bucket") == F.col("__b"))).join(
        sizes, F.col(group).eqNullSafe(F.col("__s"))).select(
        F.col(group).alias("__g"), F.col("bucket").alias("__b"), "base", "size", "bits", "list", "extra")
    whole = F.shiftright(F.col("__bit"), 3)
    last = F.conv(F.hex(F.substring(F.col("bits"), whole + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.call_function("shiftleft", F.lit(1), F.col("__bit") % 8) - 1
    dense = F.bitmap_count(F.substring(F.col("bits"), F.lit(1), whole)) + F.bit_count(last.bitwiseAND(mask))
    sparse = F.greatest(F.array_position("list", F.col("__bit")) - 1, F.lit(0))
    more = F.when(F.size("extra") > 0, F.aggregate(
        "extra", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bit"] < F.col("__bit"), x["more"]).otherwise(0))).otherwise(0)
    met = rows.withColumn("__bucket", bucket).withColumn("__bit", bit.cast("int")).join(
        index, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return met.select(*rows.columns, (F.col("base") + F.when(F.col("bits").isNotNull(), dense).otherwise(sparse) + more).alias("rank"), "size")


def placed(found: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered, rank, size): a place of its own for every row of ``leaves``.

    Rows without an id come first, then by id. Rows of one id go by leaf: their leaves' first 60 bits are
    ranked among them as ids are among a language. Equal rows are one row with a count until their
    places, which follow each other, are laid out.
    """
    ids = found.groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    known = materialize(ranked(found.withColumn("id", first), "lang", "id").drop("id"), "merkle-ranks")
    several = materialize(ids.where("n > 1").select(F.col("lang").alias("__l"), F.col("doc_id").alias("__d")), "merkle-several")
    if several.isEmpty():
        return known
    same = F.col("lang").eqNullSafe(F.col("__l")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    alone = known.join(several, same, "left_anti")
    tied = known.join(several, same, "left_semi").withColumn("group", F.struct("lang", "doc_id").cast("string"))
    tied = tied.withColumn("id", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"))
    within = ranked(tied.withColumn("at", F.col("rank")).withColumn("all", F.col("size")).drop("rank", "size"), "group", "id")
    columns = ["lang", "doc_id", "leaf", "tampered"]
    copies = materialize(within.groupBy(*columns, "at", "all", "rank").agg(F.count("*").alias("n")), "merkle-copies")
    runs = copies.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition("leaf", "from")
    laid = runs.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("n")) - 1)))
    laid = laid.select(*columns, (F.col("at") + F.col("rank") + F.col("copy")).alias("rank"), F.col("all").alias("size"))
    return materialize(alone.unionByName(laid), "merkle-leaves")


def fold(nodes: list[str], single: bool) -> list[list[str]]:
    """The levels of a block from its nodes up: all LEVELS of them, or until one node is left if ``single``."""
    from hashlib import sha256

    levels = [nodes]
    while (len(levels[-1]) > 1) if single else (len(levels) <= LEVELS):
        last = levels[-1]
        levels.append([sha256("".join(last[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(last), ARITY)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[tuple[int, list[str]]]:
    """Of each level below the top: the slot's place in its run, and the run's other nodes."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[slot - slot % ARITY:slot - slot % ARITY + ARITY]
        out.append((slot % ARITY, run[:slot % ARITY] + run[slot % ARITY + 1:]))
        slot //= ARITY
    return out


def climb(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and the siblings on its path give."""
    from hashlib import sha256

    for place, others in path:
        node = sha256("".join([*others[:place], node, *others[place:]]).encode()).hexdigest()
    return node


def _write_path(path) -> str:
    return ";".join(f"{place}{''.join(others)}" for place, others in path)


def _read_path(text: str):
    out = []
    for part in text.split(";") if text else ():
        out.append((int(part[0]), [part[i:i + 64] for i in range(1, len(part), 64)]))
    return out


def _keyed(nodes: DataFrame) -> DataFrame:
    return nodes.select("g", F.floor(F.col("rank") / BLOCK).alias("block"), (F.col("rank") % BLOCK).cast("int").alias("slot"), "size", "digest")


_REDUCED = "g string, rank long, size long, digest string"
_PATHS = "g string, rank long, top string, path string"


def _reduce(table):
    import pyarrow as pa

    table = table.sort_by("slot")
    size = table["size"][0].as_py()
    top = fold(table["digest"].to_pylist(), size <= BLOCK)[-1][0]
    return pa.table({
        "g": table["g"].slice(0, 1), "rank": pa.array([table["block"][0].as_py()], pa.int64()),
        "size": pa.array([-(-size // BLOCK)], pa.int64()), "digest": pa.array([top])})


def _descend(key, mine, above):
    """The paths of a block's slots, given that of its top."""
    import pyarrow as pa

    mine = mine.sort_by("slot")
    size, block = mine["size"][0].as_py(), mine["block"][0].as_py()
    levels = fold(mine["digest"].to_pylist(), size <= BLOCK)
    over = above["path"][0].as_py() if above.num_rows else ""
    top = above["top"][0].as_py() if above.num_rows else levels[-1][0]
    paths = [";".join(x for x in (_write_path(siblings(levels, s)), over) if x) for s in range(mine.num_rows)]
    return pa.table({
        "g": mine["g"], "rank": pa.array([block * BLOCK + s for s in range(mine.num_rows)], pa.int64()),
        "top": pa.array([top] * mine.num_rows), "path": pa.array(paths)})


def reduce_all(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(g, rank, size, digest)`` and the tops of their blocks, again and again, until every group has one.

    g is not NULL. Each level is written to the shared folder; the next has one row for BLOCK of it.
    """
    levels = [nodes]
    while True:
        tops = _keyed(levels[-1]).groupBy("g", "block").applyInArrow(_reduce, _REDUCED)
        levels.append(materialize(tops, "merkle-level"))
        if levels[-1].where("size > 1").isEmpty():
            return levels


def _down(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """(g, rank, top, path) of every node of a level, given those of the tops of its blocks."""
    if above is None:
        above = level.sparkSession.createDataFrame([], _PATHS)
    return materialize(_keyed(level).groupBy("g", "block").cogroup(above.groupBy("g", "rank")).applyInArrow(_descend, _PATHS), "merkle-paths")


def _ordered(names: DataFrame) -> DataFrame:
    """``names(lang)`` with ``rank`` in the order NULL, then UTF-8 bytes: ranges are sorted apart and counted."""
    text = F.coalesce(F.concat(F.lit("x"), "lang"), F.lit(""))
    spread = materialize(names.withColumn("text", text).repartitionByRange("text").withColumn("part", F.spark_partition_id()), "merkle-langs")
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))
    offset = counts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("text")) - 1
    return spread.withColumn("inside", inside).join(offset, "part").select("lang", (F.col("offset") + F.col("inside")).alias("rank"))


def manifest(docs: DataFrame, tamper_every: int = 3) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified), a row per row of ``docs``.

    Columns beside ``FIELDS`` are not part of a leaf; a NULL field counts as ``-``, an empty text as ``0:``.
    A language (NULL is one of its own) has a tree over its rows, in order of id (NULL first; rows of one
    id by leaf; equal rows take neighbouring places). The tops are joined by a tree in order of language.
    Digests are lowercase hex. ``proof_sha256`` is that of a row's siblings on the way to the root;
    ``folded_root`` is what the row, tampered with or not, and those siblings give. An empty table gives no rows.
    """
    places = placed(leaves(docs, tamper_every))
    group = F.coalesce(F.concat(F.lit("x"), "lang"), F.lit("")).alias("g")
    nodes = places.select(group, "rank", "size", F.lower(F.hex("leaf")).alias("digest"))
    levels = reduce_all(nodes)
    tops = levels.pop()
    langs = _ordered(places.select("lang").distinct()).select(group, F.col("rank").alias("at"))
    every = tops.join(langs, "g").select(
        F.lit("").alias("g"), F.col("at").alias("rank"), F.lit(tops.count()).cast("long").alias("size"), "digest", F.col("g").alias("of"))
    every = materialize(every, "merkle-subroots")
    upper = reduce_all(every.drop("of"))
    upper.pop()
    paths = None
    for level in reversed(upper):
        paths = _down(level, paths)
    subroots = every.select(F.col("of").alias("g"), F.col("rank").alias("at"), F.col("digest").alias("subroot"))
    above = paths.select(F.col("rank").alias("at"), F.col("top").alias("root"), F.col("path").alias("over")).join(subroots, "at")
    paths = above.select("g", F.lit(0).cast("long").alias("rank"), F.to_json(F.struct("subroot", "root")).alias("top"), F.col("over").alias("path"))
    for level in reversed(levels[1:]):
        paths = _down(level, paths)
    paths = paths.withColumnRenamed("rank", "block")

    keyed = places.select(group, F.floor(F.col("rank") / BLOCK).alias("block"), (F.col("rank") % BLOCK).cast("int").alias("slot"), "size",
                          "lang", "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("tampered")).alias("tampered"))

    def finish(key, mine, above):
        import json
        from hashlib import sha256

        import pyarrow as pa

        mine = mine.sort_by("slot")
        levels = fold(mine["leaf"].to_pylist(), mine["size"][0].as_py() <= BLOCK)
        top, over = json.loads(above["top"][0].as_py()), _read_path(above["path"][0].as_py())
        proofs, folded = [], []
        for slot, (own, other) in enumerate(zip(mine["leaf"].to_pylist(), mine["tampered"].to_pylist())):
            path = siblings(levels, slot) + over
            proofs.append(sha256("".join(x for _, others in path for x in others).encode()).hexdigest())
            folded.append(climb(other or own, path))
        n = mine.num_rows
        return pa.table({
            "doc_id": mine["doc_id"], "lang": mine["lang"], "leaf": mine["leaf"], "subroot": pa.array([top["subroot"]] * n),
            "root": pa.array([top["root"]] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded),
            "verified": pa.array([x == top["root"] for x in folded])})

    return keyed.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(
        finish, "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
