"""Conversation repair over a suffix-shared automaton.

A conversation is a string of signatures, one per row: the initial of its role and its first fault. The
cheapest repair from a row on depends only on the signatures from there to the end, so all conversations
are one automaton that shares suffixes: a node is a signature and the node after it. The distinct strings
are sorted from their last signature backwards, which brings equal suffixes together; a stream over them
keeps the nodes of the current suffix and makes a node for what the previous string did not have. Counts,
cost-to-go and the first edit of the best audit are computed once for a node and each state of the grammar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SPACE = " \t\n\x0b\x0c\r"
ROLES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Costs of the edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
#: States of the role grammar (s?(ua)+)?: nothing yet, after s, after u, after a; and which role each state takes.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
FINAL = (True, False, False, True)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ORDER = ["conv_id", "turn", "role", "k1", "k2"]


def _spaced(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, n times each. The damage of a row follows from the crc32
    of ``conv_id:turn`` modulo 20; NULLs are one space there, and so are NULL roles and texts."""
    chance = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20
    text = _spaced("text")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(chance == 4, "user").otherwise(_spaced("role")).alias("role"),
        F.when(chance == 1, "").when(chance == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(chance == 3, 2).otherwise(1).alias("n"), (chance == 0).alias("gone"),
    ).where("NOT gone").drop("gone")


def _keyed(rows: DataFrame) -> DataFrame:
    """Two hashes of the text stand for it wherever only equality counts."""
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, k1, k2, first, rest): the signature of a row as a letter, of its first and of further copies.

    Equal rows are counted before anything is exchanged. A row is a duplicate unless its turn is the
    first with that role and text; only texts that occur again are joined.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    distinct = _keyed(rows.withColumn("fault", fault)).groupBy(*ORDER, "fault").agg(F.sum("n").alias("n"))
    distinct = materialize(distinct, "conversation-rows")
    same = ["conv_id", "role", "k1", "k2"]
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = distinct.groupBy(*same).agg(F.min(turn).alias("earliest"), F.count("*").alias("turns")).where("turns > 1")
    again = materialize(again, "conversation-again").select(*[F.col(c).alias("__" + c) for c in same], "earliest")
    met = distinct.join(again, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & F.expr("role = __role AND k1 = __k1 AND k2 = __k2"), "left")
    later = F.coalesce(turn > F.col("earliest"), F.lit(False))
    role = F.instr(F.lit(" " + ROLES), F.substring("role", 1, 1)) - 1
    role = F.when((F.col("role") == "") | (role < 1), 0).otherwise(role)

    def letter(fault):
        return F.substring(F.lit("abcdefghijklmnop"), (role * 4 + fault + 1).cast("int"), F.lit(1))

    copy = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    return met.select(*ORDER, letter(F.when(later & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))).alias("first"),
                      letter(copy).alias("rest"), F.col("n").cast("long"))


def strings(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of every conversation of ``damaged`` rows.

    Rows are range-partitioned by conversation, turn, role and text, so a long conversation spreads over many
    tasks; each gives a piece of its string, and what the pieces' ends need to be joined.
    """
    def pieces(batches):
        import numpy as np
        import pyarrow as pa

        part, names = 0, ["conv_id", "part", "piece", "low", "high", "turns"]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, turn = batch.column(0), batch.column(1)
            known = np.asarray(conv.is_valid())
            values = conv.fill_null(0).to_numpy(zero_copy_only=False)
            new = np.ones(len(values), dtype=bool)
            new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(values))
            first, rest, n = (batch.column(i).to_pylist() for i in (2, 3, 4))
            letters = [a + b * (k - 1) for a, b, k in zip(first, rest, n)]
            has = np.asarray(turn.is_valid())
            t = turn.fill_null(0).to_numpy(zero_copy_only=False)
            piece, low, high, turns = [], [], [], []
            for a, b in zip(starts, ends):
                piece.append("".join(letters[a:b]))
                own = t[a:b][has[a:b]]
                low.append(int(own[0]) if len(own) else None)
                high.append(int(own[-1]) if len(own) else None)
                turns.append(int((own[1:] != own[:-1]).sum()) + 1 if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(starts)), pa.array(range(part, part + len(starts)), pa.int64()), pa.array(piece),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(turns, pa.int64())], names=names)
            part += len(starts)

    order = [F.asc_nulls_first(c) for c in ORDER]
    ranged = _signatures(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = ranged.select("conv_id", "turn", "first", "rest", "n").mapInArrow(
        pieces, "conv_id long, part long, piece string, low long, high long, turns long")
    # Ranges ascend with the partition, so pieces of a conversation do too.
    found = found.withColumn("part", F.struct(F.spark_partition_id().alias("p"), "part"))
    one = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "low", "high", "turns"))).alias("x"))
    whole = F.filter("x", lambda p: p["low"].isNotNull())
    shared = F.aggregate(
        F.sequence(F.lit(1), F.size("w") - 1), F.lit(0).cast("long"),
        lambda a, i: a + (F.element_at("w", i + 1)["low"] == F.element_at("w", i)["high"]).cast("long"))
    turns = F.aggregate("w", F.lit(0).cast("long"), lambda a, p: a + p["turns"]) - F.when(F.size("w") > 1, shared).otherwise(0)
    span = F.element_at("w", -1)["high"] - F.element_at("w", 1)["low"] + 1
    return one.withColumn("w", whole).select(
        "conv_id", F.array_join(F.transform("x", lambda p: p["piece"]), "").alias("signature"),
        F.when(F.size("w") > 0, span - turns).otherwise(0).cast("long").alias("gaps"))


class Node:
    """A suffix: its counts, and by grammar state the cost to its end and the first edit of the least best audit."""

    __slots__ = ("role", "after", "blank", "duplicate", "truncated", "illegal", "cost", "edit")

    def __init__(self, letter: str | None, after: "Node | None"):
        self.after = after
        if letter is None:
            self.role, self.blank, self.duplicate, self.truncated, self.illegal = None, 0, 0, 0, 0
            cost, edit = [0 if f else 1 << 60 for f in FINAL], [""] * 4
        else:
            role, fault = divmod(ord(letter) - ord("a"), 4)
            self.role = (" " + ROLES)[role]
            self.blank = after.blank + (fault == BLANK)
            self.duplicate = after.duplicate + (fault == DUPLICATE)
            self.truncated = after.truncated + (fault == TRUNCATED)
            self.illegal = after.illegal + (after.role is not None and (self.role, after.role) not in LEGAL)
            cost, edit = [], []
            left = LEFT_TRUNCATED if fault == TRUNCATED else 0
            for state in range(4):
                best, choice = DELETE + after.cost[state], "D"
                if fault not in (BLANK, DUPLICATE):
                    to = keeps(self.role, state)
                    if to is not None and left + after.cost[to] < best:
                        best, choice = left + after.cost[to], "K"
                    if REROLE + left + after.cost[NEXT[state]] < best:
                        best, choice = REROLE + left + after.cost[NEXT[state]], "R"
                cost.append(best)
                edit.append(choice)
        # An inserted row, or two: a third would return to the state after the first.
        for _ in range(2):
            for state in range(4):
                more = INSERT + cost[NEXT[state]]
                if more < cost[state] or (more == cost[state] and "I" < edit[state]):
                    cost[state], edit[state] = more, "I"
        self.cost, self.edit = cost, edit

    def audit(self) -> str:
        out, node, state = [], self, START
        while True:
            edit = node.edit[state]
            if edit == "":
                return "".join(out)
            out.append(edit)
            if edit == "I":
                state = NEXT[state]
                continue
            if edit == "R":
                state = NEXT[state]
            elif edit == "K":
                state = keeps(node.role, state)
            node = node.after


def keeps(role: str, state: int) -> int | None:
    """The state after a kept row, None where the grammar has no such row."""
    if role == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if role == " ua"[NEXT[state] - 1] else None


def repairs(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each of the distinct ``signatures``."""
    columns = ("blank", "duplicate", "truncated", "illegal")

    def stream(batches):
        import pyarrow as pa

        stack, last = [Node(None, None)], ""
        for batch in batches:
            out = []
            for mirrored in batch.column(0).to_pylist():
                shared, most = 0, min(len(last), len(mirrored))
                if last[:most] == mirrored[:most]:
                    shared = most
                else:
                    while last[shared] == mirrored[shared]:
                        shared += 1
                del stack[shared + 1:]
                for letter in mirrored[shared:]:
                    stack.append(Node(letter, stack[-1]))
                last, node = mirrored, stack[-1]
                out.append((mirrored[::-1], *(getattr(node, c) for c in columns), node.cost[START], node.audit()))
            types = [pa.string()] + [pa.int64()] * 5 + [pa.string()]
            rows = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)],
                                             names=["signature", *columns, "cost", "audit"])

    mirrored = signatures.select(F.reverse("signature").alias("mirrored")).distinct()
    mirrored = mirrored.repartitionByRange("mirrored").sortWithinPartitions("mirrored")
    return mirrored.mapInArrow(stream, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repair(conversations: DataFrame) -> DataFrame:
    """A row per conv_id (NULL is one of its own): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of one turn go by role and then by two hashes of the text, so equal rows stand together; columns beside
    conv_id, turn, role and text are left aside. Roles count by their first letter; one that is not s, u
    or a is never kept. Faults and illegal neighbours are those after damage. A conversation that lost
    all its rows has zeros, an empty audit and the hash of nothing. An empty table gives no rows.

    The last pass sends each conversation's rows, behind a row with its audit, sorted to one task, which
    edits and hashes them as they stream by: SHA-256 has to see a conversation in order, but no more than a
    batch of it is held.
    """
    rows = damaged(conversations)
    found = materialize(strings(rows), "conversation-strings")
    best = materialize(repairs(found), "conversation-repairs")
    heads = found.join(best, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = own.join(heads.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), "left").select(
        "conv_id", F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                            F.coalesce("audit", F.lit("")).alias("audit")).alias("head"))
    body = _keyed(rows).withColumn("head", F.lit(None).cast(heads.schema["head"].dataType))
    both = heads.unionByName(body, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), F.col("head").isNull(), *[F.asc_nulls_first(c) for c in ORDER[1:]]]
    sorted_rows = both.repartition("conv_id").sortWithinPartitions(*order)

    def stream(batches):
        from hashlib import sha256

        import pyarrow as pa

        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        types = [pa.int64()] * 7 + [pa.string(), pa.string()]

        class Running:
            def __init__(self, conv, head):
                self.conv, self.head, self.sha, self.any = conv, head, sha256(), False
                self.at, self.state, self.seen = 0, START, None

            def put(self, role, text):
                self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                self.any = True

            def insert(self):
                audit = self.head["audit"]
                while self.at < len(audit) and audit[self.at] == "I":
                    self.state = NEXT[self.state]
                    self.put("user" if self.state == USER else "assistant", "")
                    self.at += 1

            def row(self, role, text, n):
                for _ in range(n):
                    self.insert()
                    edit = self.head["audit"][self.at]
                    self.at += 1
                    if edit == "K":
                        self.state = keeps(role[0], self.state)
                        self.put(role, text)
                    elif edit == "R":
                        self.state = NEXT[self.state]
                        self.put("user" if self.state == USER else "assistant", text)

            def done(self):
                self.insert()
                return (self.conv, *(self.head[c] for c in names), self.sha.hexdigest())

        running = None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for conv, head, role, text, n in zip(*(c.to_pylist() for c in some.columns)):
                    if head is not None:
                        if running:
                            out.append(running.done())
                        running = Running(conv, head)
                    else:
                        running.row(role, text, n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                                 names=["conv_id", *names, "repaired_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(running.done(), types)],
                                             names=["conv_id", *names, "repaired_sha256"])

    return sorted_rows.select("conv_id", "head", "role", "text", "n").mapInArrow(
        stream, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
