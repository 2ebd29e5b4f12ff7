"""Token-id files: byte-level BPE ids in shards compressed by Re-Pair grammars.

Documents are range-partitioned by id and encoded; the ids of a shard are rewritten by rules
``nonterminal -> pair`` for frequent pairs, again and again, never across documents. A shard is
one binary record, so Spark's own writers put it in any store:

    magic "RPR1", then little-endian: uint32 documents, rules, symbols, first nonterminal
    rules:      left uint32[], right uint32[], expansion length uint32[]
    documents:  start of the ids uint64[], number of ids uint32[], first symbol uint32[]
    symbols:    zlib of uint32[], byte planes apart

A document is decoded alone from its symbols and the rules. Starts count from the beginning
of the shard's partition; the number of ids of each partition is stored with its shards.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_key

END_ID = 2
#: Ids in a shard; a document is never split, so one long document may make a larger shard.
SHARD_IDS = 1_000_000
#: Rounds of replacement, and how often a pair must occur in a shard to be replaced.
ROUNDS, MIN_COUNT, RULES_PER_ROUND = 4, 16, 4_096
#: Slots that pairs are counted in.
SLOTS = 1 << 18
MAGIC = b"RPR1"
#: Encoded pieces that a Python worker remembers, over its tasks.
CACHE = 600_000
#: Bytes of texts that are cut and numbered at once.
BLOCK_BYTES = 4_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary as text, to travel with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


class Encoder:
    """text -> ids as little-endian uint32 bytes, with the end id.

    Texts are cut where a pre-token of a byte-level BPE ends whatever stands around: before a space
    with a character of a token behind it, between kinds of characters, and at single line ends. Arrow numbers
    the distinct pieces, each is encoded once, and the ids of texts are gathered from those of the pieces.
    """

    # Kinds of characters: any other (never cut beside), space, line end, letter, number, the rest, apostrophe.
    OTHER, SPACE, LINE, LETTER, NUMBER, MARK, APOSTROPHE, UNSEEN = range(8)

    def __init__(self, vocabulary: str, end: int | None = END_ID):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.end = b"" if end is None else struct.pack("<I", end)
        # Characters of a byte-level token stand for one byte each.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())])
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # The same merges for pieces that are one pre-token, a line each, in the characters of a byte-level token.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [i for i in range(256) if i not in shown]
        self.characters = np.arange(256, dtype="<u4")
        self.characters[hidden] = np.arange(256, 256 + len(hidden))
        self.characters[10] = 10
        self.kinds = np.full(0x110000, self.UNSEEN, dtype=np.uint8)
        self.kinds[:128] = [self.kind(chr(i)) for i in range(128)]
        # What a pair of neighbours allows: 1 a cut before it, 2 between, 4 if a token follows, 8 if one came before.
        self.rules = np.zeros(64, dtype=np.uint8)
        token = (self.LETTER, self.NUMBER, self.MARK, self.APOSTROPHE)
        for x in token:
            self.rules[self.SPACE * 8 + x], self.rules[x * 8 + self.LINE], self.rules[self.LINE * 8 + x] = 1, 2 + 4, 8
            for y in token:
                if x != y and {x, y} != {self.MARK, self.APOSTROPHE} and (x, y) != (self.APOSTROPHE, self.LETTER):
                    self.rules[x * 8 + y] = 2
        self.known: dict[str, bytes] = {}

    def kind(self, character: str) -> int:
        """As the tokenizer itself sees it, whatever Unicode it knows."""
        if character.isspace():
            return {" ": self.SPACE, "\n": self.LINE}.get(character, self.OTHER)
        for kind, same in ((self.LETTER, "a"), (self.NUMBER, "1"), (self.MARK, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(same + character + same)) == 1:
                return self.APOSTROPHE if character == "'" else kind
        return self.OTHER

    def cuts(self, data, starts):
        """Places in the UTF-8 bytes ``data`` where pieces begin; ``starts``: where texts begin."""
        import numpy as np

        kinds = np.append(self.kinds[:128], np.zeros(128, dtype=np.uint8))[data]
        leads = np.flatnonzero(data >= 0xC0)
        sizes = 2 + (data[leads] >= 0xE0) + (data[leads] >= 0xF0)
        for size in (2, 3, 4):
            at = leads[sizes == size]
            code = data[at].astype(np.int32) & (0x7F >> size)
            for i in range(1, size):
                code = code << 6 | data[at + i] & 0x3F
            for c in np.unique(code[self.kinds[code] == self.UNSEEN]).tolist():
                self.kinds[c] = self.kind(chr(c))
            for i in range(size):
                kinds[at + i] = self.kinds[code]
        rules = self.rules[kinds[:-1] << 3 | kinds[1:]]
        rules[starts[1:] - 1] = 0
        cut = np.zeros(len(data), dtype=bool)
        cut[:-1] = rules & 1
        cut[1:] |= (rules & 2) > 0
        cut[2:] |= (rules[1:] & rules[:-1] << 1 & 8) > 0
        cut[starts] = True
        return np.flatnonzero(cut)

    def one_token(self, piece: str) -> bool:
        """Whether a piece is one pre-token: characters of one kind, a space before them or none."""
        body = piece[1:] if piece[0] == " " else piece
        if body.isascii() and body.isalpha():
            return True
        kinds = {int(self.kinds[ord(c)]) for c in body}
        return kinds in ({self.LETTER}, {self.NUMBER}) or bool(kinds) and kinds <= {self.MARK, self.APOSTROPHE}

    def alone(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, pieces: list[str]) -> None:
        """Pieces of one pre-token go to the tokenizer joined; ids are told apart by the bytes they stand for."""
        import numpy as np

        joined = []
        for piece in pieces:
            if self.one_token(piece):
                joined.append(piece)
            else:
                self.known[piece] = self.alone(piece)
        for i in range(0, len(joined), 2_000):
            some = joined[i:i + 2_000]
            text = np.frombuffer(("\n".join(some) + "\n").encode(), dtype=np.uint8)
            shown = self.characters[text].tobytes().decode("utf-32-le")
            ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(text == 10) - np.arange(len(some))
            cuts = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
            data, at = ids.tobytes(), 0
            for piece, cut in zip(some, (cuts * 4).tolist()):
                self.known[piece] = data[at:cut]
                at = cut

    def __call__(self, texts) -> list[bytes]:
        """``texts``: a list, or an Arrow array of strings."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string())
        texts = pc.fill_null(texts, "")
        # A text that holds an added token goes to the tokenizer whole.
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            alone = iter([self.alone(x) + self.end for x in texts.filter(pa.array(whole)).to_pylist()])
            rest = iter(self(texts.filter(pa.array(~whole))))
            return [next(alone) if x else next(rest) for x in whole.tolist()]
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else [0]
        if offsets[0] == offsets[-1]:
            return [self.end] * len(texts)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]

        cuts = self.cuts(data, np.unique(offsets[:-1][offsets[:-1] < len(data)]))
        ends = np.searchsorted(cuts, offsets[1:])
        places = np.append(cuts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) > CACHE:
            self.known.clear()
        pieces = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        self.learn([pieces[i] for i in new])
        for i in new:
            ids[i] = self.known[pieces[i]]

        # The end id is a piece of its own after every text.
        ids.append(self.end)
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(pieces))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        size, at = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        stop = np.cumsum(size)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[np.repeat(at - stop + size, size) + np.arange(stop[-1])].tobytes()
        stop = (stop[ends + np.arange(len(ends))] * 4).tolist()
        return [out[a:b] for a, b in zip([0, *stop], stop)]


def blocks(batch):
    """Slices of (doc_id, text) rows: texts of BLOCK_BYTES at most, or a single longer one."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at, before = stop, int(sizes[stop - 1])


def worker_encoder(vocabulary: str, end: int | None) -> Encoder:
    """An encoder that the next tasks of the same Python worker use again, with what it has learnt."""
    # A module of this library's own in the worker: code that comes with a task leaves none.
    kept = sys.modules.setdefault("_geolantern_worker", types.ModuleType("_geolantern_worker")).__dict__.setdefault("encoders", {})
    key = (zlib.crc32(vocabulary.encode()), len(vocabulary), end)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(vocabulary, end)
    return kept[key]


def compress(ids, starts):
    """Re-Pair over one shard: (symbols, first symbol of each document, first nonterminal, left, right, lengths).

    ``starts``: first id of each document. Each round counts all pairs within documents by a hash
    of the pair, gives the pairs of the fullest slots nonterminals (one pair a slot) and
    replaces them from left to right; a pair that overlaps a replaced one waits for the next round.
    """
    import numpy as np

    symbols = ids.astype(np.uint32)
    starts = starts.astype(np.int64)
    first = int(symbols.max(initial=0)) + 1
    left, right = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    known = np.ones(first, dtype=np.int64)
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        a, b = symbols[:-1], symbols[1:]
        slot = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) >> (33 - SLOTS.bit_length())).astype(np.intp)
        inner = starts[(starts > 0) & (starts < len(symbols))] - 1
        slot[inner] = SLOTS
        counts = np.bincount(slot, minlength=SLOTS + 1)
        counts[SLOTS] = 0
        top = np.argpartition(counts, -RULES_PER_ROUND)[-RULES_PER_ROUND:]
        rule_of = np.full(SLOTS + 1, -1, dtype=np.int32)
        pair_of = np.full(SLOTS + 1, -1, dtype=np.int64)
        top = top[counts[top] >= MIN_COUNT]
        if not len(top):
            break
        rule_of[top] = np.arange(len(top))
        hot = np.flatnonzero(rule_of[slot] >= 0)
        slot = slot[hot]
        codes = a[hot].astype(np.int64) << 32 | b[hot]
        pair_of[slot] = codes
        same = codes == pair_of[slot]
        where, rule = hot[same], rule_of[slot[same]]
        # Of matches that overlap, the first, third, ... of the run are replaced.
        opens = np.ones(len(where), dtype=bool)
        opens[1:] = np.diff(where) != 1
        run = np.maximum.accumulate(np.where(opens, np.arange(len(where)), 0))
        taken = (np.arange(len(where)) - run) % 2 == 0
        where, rule = where[taken], rule[taken]
        a, b = pair_of[top] >> 32, pair_of[top] & 0xFFFFFFFF
        symbols[where] = len(known) + rule
        left, right, known = np.append(left, a), np.append(right, b), np.append(known, known[a] + known[b])
        starts = starts - np.searchsorted(where + 1, starts)
        left_over = np.ones(len(symbols), dtype=bool)
        left_over[where + 1] = False
        symbols = symbols[left_over]
    as_u4 = lambda x: np.array(x, dtype="<u4")
    return as_u4(symbols), as_u4(starts), first, as_u4(left), as_u4(right), as_u4(known[first:])


def pack(ids: list[bytes], offset: int) -> bytes:
    """One shard of the ids of some documents; ``offset``: ids before it in its partition."""
    import numpy as np

    counts = np.array([len(x) // 4 for x in ids], dtype="<u4")
    ends = np.cumsum(counts, dtype=np.int64)
    starts = ends - counts
    symbols, at, first, left, right, lengths = compress(np.frombuffer(b"".join(ids), dtype="<u4"), starts)
    planes = np.ascontiguousarray(symbols.view(np.uint8).reshape(-1, 4).T)
    head = MAGIC + struct.pack("<4I", len(ids), len(left), len(symbols), first)
    return b"".join([
        head, left.tobytes(), right.tobytes(), lengths.tobytes(),
        (starts + offset).astype("<u8").tobytes(), counts.tobytes(), at.tobytes(), zlib.compress(planes.tobytes(), 1),
    ])


class Shard:
    """Random access to the documents of a packed shard."""

    def __init__(self, data: bytes):
        import numpy as np

        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, n, self.first = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.starts, self.counts, self.at = take("<u8", docs), take("<u4", docs), take("<u4", docs)
        planes = np.frombuffer(zlib.decompress(data[at:]), dtype=np.uint8).reshape(4, n)
        self.symbols = np.ascontiguousarray(planes.T).view("<u4").ravel()
        self.ends = np.append(self.at[1:], n)
        # What every symbol stands for, one after another, and how many ids that is.
        rules = np.arange(self.first, self.first + rules, dtype="<u4")
        self.spelled = np.concatenate([np.arange(self.first, dtype="<u4"), self.unfold(rules)])
        self.sizes = np.concatenate([np.ones(self.first, dtype=np.int64), self.lengths])
        self.places = np.cumsum(self.sizes) - self.sizes

    def __len__(self):
        return len(self.counts)

    def unfold(self, symbols):
        """Ids of a few symbols: all nonterminals are replaced by their pairs until none is left."""
        import numpy as np

        while len(symbols) and symbols.max() >= self.first:
            rule = symbols >= self.first
            out = np.empty(len(symbols) + int(rule.sum()), dtype="<u4")
            to = np.arange(len(symbols)) + np.concatenate([[0], np.cumsum(rule)[:-1]])
            which = symbols[rule] - self.first
            out[to[~rule]] = symbols[~rule]
            out[to[rule]] = self.left[which]
            out[to[rule] + 1] = self.right[which]
            symbols = out
        return symbols

    def expand(self, symbols):
        """Ids of a run of symbols."""
        import numpy as np

        sizes = self.sizes[symbols]
        stop = np.cumsum(sizes)
        return self.spelled[np.repeat(self.places[symbols] - stop + sizes, sizes) + np.arange(stop[-1] if len(stop) else 0)]

    def document(self, i: int):
        """Ids of the i-th document of the shard."""
        return self.expand(self.symbols[self.at[i]:self.ends[i]])

    def documents(self):
        """Ids of all documents, expanded at once."""
        import numpy as np

        ids = self.expand(self.symbols)
        return np.split(ids, np.cumsum(self.counts, dtype=np.int64)[:-1])


def write(docs: DataFrame, path: str, vocab: str | None = None, end: int = END_ID) -> None:
    """Shards of all rows of ``docs(doc_id, text)`` in ascending doc_id order (NULL first, then by a hash of the text).

    Ranges go by id and that hash, so that rows of one id, or none, are not one task.
    Rows (part, shard, offset, n_ids, doc_ids, data) as Parquet. NULL texts are empty documents. A
    task streams its range of ids and holds one shard at a time; it may be run again at will.
    """
    vocab = vocabulary() if vocab is None else vocab
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = worker_encoder(sent.value, end)
        part, shard, offset = TaskContext.get().partitionId(), 0, 0
        held, ids, n = [], [], 0

        def close():
            nonlocal shard, offset, held, ids, n
            out = pa.RecordBatch.from_pydict(
                {"part": [part], "shard": [shard], "offset": [offset], "n_ids": [n], "doc_ids": [ids], "data": [pack(held, offset)]},
                schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_ids", pa.int64()),
                                  ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())]))
            shard, offset, held, ids, n = shard + 1, offset + n, [], [], 0
            return out

        for batch in batches:
            for some in blocks(batch):
                for doc_id, tokens in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    held.append(tokens)
                    ids.append(doc_id)
                    n += len(tokens) // 4
                    if n >= SHARD_IDS:
                        yield close()
        if held:
            yield close()

    # The sample that ranges are drawn from holds their keys, so no text is one.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    ranged = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text").drop("key")
    ranged.mapInArrow(run, "part int, shard int, offset long, n_ids long, doc_ids array<bigint>, data binary").write.parquet(path)


def bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each partition of the written files; one number per partition of the write."""
    rows = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    out, at = {}, 0
    for r in rows:
        out[r["part"]] = at
        at += r["n"]
    return out


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files."""
    first = spark.sparkContext.broadcast(bases(spark, path))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(data)
                starts = shard.starts.astype(np.int64) + first.value[part]
                crcs = [zlib.crc32(np.ascontiguousarray(x).tobytes()) for x in shard.documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.counts.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).select("part", "doc_ids", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
