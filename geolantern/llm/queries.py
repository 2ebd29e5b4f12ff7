"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    conversations, edits, html, linededup, merkle, mixing, quality, secrets, simhash, substrings, tokens, toxicity, winnow,
)
from .common import fold, labelled_sample, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query()
def op1_simhash(spark, sf):
    found = simhash.near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def toxicity_model(docs, labels):
    sample, prior = labelled_sample(
        docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0,
        {1: toxicity.TOXIC_ROWS, 0: toxicity.ORDINARY_ROWS},
    )
    return toxicity.fit(sample, prior)


@query()
def op2_toxicity(spark, sf):
    docs = read(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, read(spark, sf, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("""
WITH d AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS ord
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, CAST(1 + rank % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS bound FROM r),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(bound) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(bound, weight * (SELECT max(level) FROM l)) AS target, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][1 + rank % 3] AS a FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * ((middle <= target)::INT + (middle + source_size <= target)::INT + (middle + 2 * source_size <= target)::INT) AS BIGINT) AS taken,
  array_to_string(list_transform(list_transform(list_filter([middle, middle + source_size, middle + 2 * source_size], lambda d: d <= target AND size > 0),
    lambda d: least(greatest(d / target, 0.0::DOUBLE), 1.0::DOUBLE)),
    lambda x: CAST(round(1e9::DOUBLE * (2 * x / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * x)))) AS BIGINT)), ',') AS positions
FROM c""")
def op7_mixing(spark, sf):
    """Training positions are in billionths; rows are range-sorted by the first of them, those not taken last."""
    mixed = mixing.mix(read(spark, sf, "documents"))
    order = [F.asc_nulls_last("first"), F.asc("doc_id")]
    ordered = mixed.withColumn("first", F.array_min("positions")).repartitionByRange(*order).sortWithinPartitions(*order)
    billionths = F.transform("positions", lambda x: F.round(x * 1e9).cast("long").cast("string"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.array_join(billionths, ",").alias("positions"))


@query()
def op8_tokens(spark, sf):
    path = scratch_path(spark, "token-files")
    tokens.write(read(spark, sf, "documents"), path)
    return tokens.digest(spark, path)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS span FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
x AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM u),
h AS (SELECT y.doc_id, y.p, y.n, g.item FROM (SELECT *, array_to_string(ws[1:n], ' ') AS span FROM x, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n) y
  JOIN g ON g.n = y.n AND g.span = y.span),
a AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM h GROUP BY doc_id),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(a.n_items, 0) AS BIGINT) AS n_items, coalesce(a.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""")
def op9_decontaminate(spark, sf):
    found = winnow.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, k.p, k.line, coalesce(k.doc_id <> m.first, false) AS gone FROM k LEFT JOIN m ON m.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op4_line_dedup(spark, sf):
    docs = read(spark, sf, "documents")
    return linededup.digest(docs, linededup.bitmaps(docs))


@query()
def op6_secrets(spark, sf):
    return secrets.digest(secrets.scan(read(spark, sf, "documents")))


@query()
def op5_quality(spark, sf):
    docs = read(spark, sf, "documents")
    sample, prior = labelled_sample(
        docs, read(spark, sf, "labels"), "quality", fold(F.col("doc_id"), 4) != 2, quality.ROWS)
    scored = quality.score(docs, quality.fit(sample, prior))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op10_html(spark, sf):
    return html.extract(read(spark, sf, "pages"))


@query()
def op3_edit_embedding(spark, sf):
    return edits.with_next(read(spark, sf, "documents"))


@query()
def op11_conversations(spark, sf):
    return conversations.repair(read(spark, sf, "conversations"))


def _merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """The manifest in SQL, a step per tree level: as many as 8**levels rows a language and 8**upper languages."""
    fields = " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in merkle.FIELDS)
    plain = fields.format(**{c: c for c in merkle.FIELDS})
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = fields.format(**{c: c for c in merkle.FIELDS} | {"text": lower})
    # crc32 of a short text: eight shifts for each of its bits are no SQL to read, so the table of a byte is built first.
    steps = [f"""
b AS (SELECT range AS i, range AS c0 FROM range(256)),
{", ".join(f"b{i + 1} AS (SELECT i, CASE WHEN c{i} & 1 = 1 THEN xor(c{i} >> 1, 3988292384) ELSE c{i} >> 1 END AS c{i + 1} FROM b{i or ''})" for i in range(8))},
tab AS (SELECT list(c8 ORDER BY i) AS t FROM b8),
d AS (SELECT *, coalesce('x' || lang, '') AS g, CAST(doc_id AS VARCHAR) AS id,
  sha256({plain}) AS leaf, sha256({changed}) AS changed FROM documents),
e AS (SELECT d.*, CASE WHEN id IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(id, '')]),
  lambda a, x: xor(a >> 8, t[1 + CAST(xor(a & 255, x) AS BIGINT)])), 4294967295) END AS crc FROM d, tab),
l0 AS (SELECT g, doc_id, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS f0,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM e),
n0 AS (SELECT g, r, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l0)"""]

    def climb(table: str, i: int) -> str:
        run = f"PARTITION BY g, r // 8 ORDER BY r ROWS BETWEEN"
        return f"""
s{table}{i} AS (SELECT g, r, h, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {table}{i}),
{table}{i + 1} AS (SELECT g, r // 8 AS r, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h,
  CAST(ceil(any_value(n) / 8) AS BIGINT) AS n FROM {table}{i} GROUP BY g, r // 8)"""

    steps += [climb("n", i) for i in range(levels)]
    steps.append(f"""
u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS r, h, count(*) OVER () AS n, g AS lang FROM n{levels})""")
    steps += [climb("u", i) for i in range(upper)]
    path, joins, proof, fold = [], [], [], "f0"
    for i in range(levels):
        joins.append(f"JOIN sn{i} p{i} ON p{i}.g = l0.g AND p{i}.r = l0.r // {8 ** i}")
        path.append(f"p{i}")
    joins.append("JOIN u0 ON u0.lang = l0.g")
    for i in range(upper):
        joins.append(f"JOIN su{i} q{i} ON q{i}.r = u0.r // {8 ** i}")
        path.append(f"q{i}")
    select = ["l0.doc_id", "l0.leaf", "u0.h AS subroot", f"(SELECT h FROM u{upper}) AS root", "l0.f0"]
    select += [f"{p}.{c} AS {p}{c}" for p in path for c in "azn"]
    steps.append(f"""
w0 AS (SELECT {', '.join(select)}, {' || '.join(f'{p}.a || {p}.z' for p in path)} AS proof FROM l0 {' '.join(joins)})""")
    for i, p in enumerate(path):
        steps.append(f"""
w{i + 1} AS (SELECT * REPLACE (CASE WHEN {p}n = 1 THEN f0 ELSE sha256({p}a || f0 || {p}z) END AS f0) FROM w{i})""")
    return "WITH " + ",".join(steps) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f0 AS folded_root, f0 = root AS verified FROM w{len(path)}"""


@query(_merkle_sql())
def op12_merkle(spark, sf):
    return merkle.manifest(read(spark, sf, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM u),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM h SEMI JOIN r USING (h))),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM x ANTI JOIN g USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""")
def op13_substrings(spark, sf):
    found = substrings.deduplicate(read(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
