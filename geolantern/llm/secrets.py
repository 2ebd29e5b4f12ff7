"""Secret scans over a trigram index, in DataFrame operations only.

A Boolean query over trigrams is derived from the pattern of every rule: a list of alternatives, one of
which stands with all of its trigrams in any match. The postings of those trigrams are intersected per
document, and only the candidates of a rule are searched with its pattern. A rule without
mandatory trigrams is searched in all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_key


#: Strings of a finite part of a pattern, and alternatives of a query, that are followed up; beyond, the part says nothing.
STRINGS, ALTERNATIVES = 64, 64
#: Matches whose places are summed up at a time.
PLACES = 256


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


class _Seen:
    """What a part of a pattern matches: ``exact`` lower-cased strings if they are few, else None, and a query
    of alternatives, each a set of trigrams; one empty alternative says nothing."""

    def __init__(self, exact=None, query=(frozenset(),)):
        self.exact, self.query = exact, list(query)

    def spelt(self) -> list[frozenset[str]]:
        """The query of this part alone, its exact strings included."""
        return self.query if self.exact is None else [trigrams(x) for x in self.exact]


def _plain(query) -> list[frozenset[str]]:
    """Without alternatives that another one implies."""
    query = sorted(set(query), key=lambda x: (len(x), sorted(x)))
    kept = []
    for one in query:
        if not any(other <= one for other in kept):
            kept.append(one)
    return kept if len(kept) <= ALTERNATIVES else [frozenset()]


def _both(first, second) -> list[frozenset[str]]:
    if len(first) * len(second) > ALTERNATIVES * ALTERNATIVES:
        return first
    joined = _plain([a | b for a in first for b in second])
    return first if joined == [frozenset()] else joined


def _either(parts: list[_Seen]) -> _Seen:
    if all(p.exact is not None for p in parts):
        exact = set().union(*(p.exact for p in parts))
        if len(exact) <= STRINGS:
            return _Seen(exact)
    return _Seen(None, _plain([a for p in parts for a in p.spelt()]))


def _follow(items) -> _Seen:
    """A sequence of parsed pattern items."""
    exact, query, whole = {""}, [frozenset()], True
    for item in items:
        part = _item(item)
        longer = None if part.exact is None else {a + b for a in exact for b in part.exact}
        if longer is not None and len(longer) <= STRINGS:
            exact = longer
            continue
        query = _both(_both(query, [trigrams(x) for x in exact]), part.spelt())
        exact, whole = {""}, False
    return _Seen(exact) if whole else _Seen(None, _both(query, [trigrams(x) for x in exact]))


def _item(item) -> _Seen:
    name, value = str(item[0]), item[1]
    if name == "LITERAL":
        # Texts are searched with A-Z lower-cased; other letters stand for themselves alone.
        return _Seen({chr(value).lower() if value < 128 else chr(value)})
    if name == "IN":
        chars = set()
        for kind, what in value:
            if str(kind) == "LITERAL":
                chars.add(what)
            elif str(kind) == "RANGE" and what[1] - what[0] < STRINGS:
                chars.update(range(what[0], what[1] + 1))
            else:
                return _Seen()
        chars = {chr(c).lower() if c < 128 else chr(c) for c in chars}
        return _Seen(chars) if len(chars) <= 4 else _Seen()
    if name == "BRANCH":
        return _either([_follow(x) for x in value[1]])
    if name == "SUBPATTERN":
        return _follow(value[3])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inside = value
        inner = _follow(inside)
        if least == most == 1:
            return inner
        if least == 0:
            return _either([_Seen({""}), inner]) if most == 1 and inner.exact is not None else _Seen()
        return _Seen(None, inner.spelt())
    if name == "ATOMIC_GROUP":
        return _follow(value)
    if name == "AT":
        return _Seen({""})
    if name in ("ASSERT", "ASSERT_NOT"):
        return _Seen({""})
    return _Seen()


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams of the lower-cased text, one of which every match of a pattern holds in full; none if
    some match may hold no trigram that is known. Patterns are of the kind that Java and Python read alike."""
    parsed = re._parser.parse(pattern)
    query = _plain(_follow(parsed).spelt())
    return [] if any(not x for x in query) else [sorted(x) for x in query]


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1

    def query(self) -> list[list[str]]:
        return trigram_query(self.pattern)


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
    Rule("private_key", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id, key, trigram): the inverted index for the wanted trigrams of lower-cased texts."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in wanted]))
    return docs.select("doc_id", text_key().alias("key"), text.alias("folded")).select(
        "doc_id", "key", F.explode_outer(held).alias("trigram")).where("trigram IS NOT NULL")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, key, kinds): the rules whose Boolean query a document satisfies.

    Postings meet by document, so a trigram that stands in a third of all documents loads no task.
    """
    held = index.groupBy("doc_id", "key").agg(F.collect_set("trigram").alias("held"))

    def satisfied(rule: Rule) -> Column:
        one = F.lit(False)
        for alternative in rule.query():
            one = one | (F.size(F.array_intersect("held", F.array(*map(F.lit, alternative)))) == len(alternative))
        return F.when(one, F.lit(rule.kind))

    return held.select("doc_id", "key", F.array_compact(F.array(*[satisfied(r) for r in rules])).alias("kinds")).where(
        "size(kinds) > 0")


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's matches, in code points, end exclusive.

    Matches are leftmost and do not overlap; those shorter than ``at_least`` (of the rule's group)
    are left out afterwards. The places follow from the lengths of the matches and of what
    stands between them. A plain run of characters is searched by its least length at once, which gives the same.
    """
    pattern, by_length = rule.pattern, rule.at_least > 1
    if pattern.endswith("]+") and pattern.count("[") == 1:
        fixed = pattern.index("[")
        pattern, by_length = f"{pattern[:-1]}{{{rule.at_least - fixed},}}", False
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if by_length else found
    each = F.arrays_zip(
        F.transform(found, F.length).alias("n"), F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"),
        F.transform(sizes, F.length).alias("g"),
    )
    nothing = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"))
        added = F.when(x["g"] >= rule.at_least, F.concat(state["out"], F.array(one))).otherwise(state["out"]) if by_length else (
            F.concat(state["out"], F.array(one)))
        return F.struct((start + x["n"]).alias("at"), added.alias("out"))

    first = F.array(F.struct(F.lit(0).alias("at"), nothing.alias("out")))

    def run(done, some):
        begin = F.struct(F.element_at(done, -1)["at"].alias("at"), nothing.alias("out"))
        return F.concat(done, F.array(F.aggregate(some, begin, step)))

    def placed(matches):
        # An array grows by copying, so it is put together from short ones.
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(matches) - 1, F.lit(0)), F.lit(PLACES)),
                           lambda i: F.slice(matches, i + 1, F.lit(PLACES)))
        return F.aggregate(runs, first, run, lambda done: F.flatten(F.transform(done, lambda x: x["out"])))

    # Bound to a variable, so that the text is searched once and not for every run.
    return F.element_at(F.transform(F.array(each), placed), 1)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) for every row: the spans of all rules by start, then by the order of the rules.

    NULL texts have no spans. Rows of one doc_id are told apart by their text.
    """
    indexed = tuple(r for r in rules if r.query())
    wanted = sorted({t for r in indexed for alternative in r.query() for t in alternative})
    may = candidates(postings(docs, wanted), indexed).withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k")
    keyed = docs.select("doc_id", text_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = keyed.join(may, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    parts = []
    for order, rule in enumerate(rules):
        all_spans = spans(F.col("text"), rule, order)
        if rule in indexed:
            nothing = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
            all_spans = F.when(F.array_contains("kinds", rule.kind), all_spans).otherwise(nothing)
        parts.append(all_spans)
    return met.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """(doc_id, n_<kind> of the base rules, base_sha256, spans)."""
    own = F.filter("found", lambda x: x["kind"].isin(*base))

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
