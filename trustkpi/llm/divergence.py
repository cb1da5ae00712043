"""Source divergence audit: how far each source's term shares lie from its language and from the other sources.

One ``bytes.translate`` lowers A-Z and blanks every separator, ``bytes.split`` gives the terms and
a Counter per document their counts. Tasks add the counters up sparsely per (lang, source) and
send (lang, source, term, occurrences, documents); zeros are never stored. The sum of absolute
differences over all kept terms is put together from the terms that occur:

    sum |p_a - p_b| = sum over a's terms |p_a - zero_b| + sum over b's terms |p_b - zero_a|
                      + (kept - terms of a - terms of b) * |zero_a - zero_b|
                      + sum over shared terms (|p_a - p_b| - |p_a - zero_b| - |zero_a - p_b| + |zero_a - zero_b|)

where ``zero`` is the share of a term that does not occur in the group.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.llm.shared import arrow_map, binary_values
from trustkpi.session import stage

MIN_DOCS = 30
PRIOR = 5
TOP_TERMS = 50
SCALE_STEPS = 3  # shares are in units of 1 / 1000**SCALE_STEPS
# Pairs (group, term) a task holds before it sends them: bounds its memory, not the result.
HELD_PAIRS = 400_000
# Pieces a language's sources are dealt to in joins on the language, whose few values are uneven.
PIECES = 32

# A-Z become a-z; a-z and all bytes of characters beyond ASCII stay; everything else is blank.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text), added up per task and then by term."""

    def rows(groups):
        for (lang, source), (often, docs_with) in groups.items():
            names = list(docs_with)
            for at in range(0, len(names), 100_000):
                part = names[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([often[t] for t in part], pa.int64()), pa.array([docs_with[t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches):
        groups, held = {}, 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, text in zip(keys, binary_values(batch.column(2))):
                found = Counter(terms(text))
                often, docs_with = groups.setdefault(key, (Counter(), Counter()))
                before = len(docs_with)
                docs_with.update(found.keys())
                for term, n in found.items():
                    often[term] += n
                held += len(docs_with) - before
                if held >= HELD_PAIRS:
                    yield from rows(groups)
                    groups, held = {}, 0
        yield from rows(groups)

    sent = arrow_map(docs, run, "lang string, source string, term string, n bigint, docs bigint")
    # Dealt by (lang, term): that serves the sums per source and the sums over sources in one shuffle.
    return sent.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) in whole numbers: three digits at a time, so nothing overflows.

    ``count`` is at most ``total``; exact up to totals of 9 * 10**15.
    """
    out, rest = F.lit(0).cast("bigint"), count.cast("bigint")
    for _ in range(SCALE_STEPS):
        scaled = rest * 1000
        out = out * 1000 + F.call_function("div", scaled, total)
        rest = scaled % total
    return out + 1


def rated_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Kept terms with their share ``p`` in the group and ``q`` in the language."""
    return (
        kept.join(groups, ["lang", "source"])
        .select(
            "lang", "source", "term", "zero",
            share(F.col("n") + PRIOR, F.col("total") + PRIOR * F.col("kept")).alias("p"),
            share(F.col("lang_n") + PRIOR, F.col("lang_total") + PRIOR * F.col("kept")).alias("q"),
        )
    )


def _groups(slim: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, own, kept, lang_total, zero) of every occurring group; one row per source."""
    sums = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count("*").alias("own"), F.sum(F.col("first").cast("bigint")).alias("first")
    )
    langs = sums.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("total").alias("lang_total"))
    none = F.lit(0).cast("bigint")
    return (
        slim.select("lang", "source").distinct()
        .join(sums.drop("first"), ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "own", "kept", "lang_total")])
        .withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(PRIOR), F.col("total") + PRIOR * F.col("kept")))
                    .otherwise(none))
    )


def divergences(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of absolute differences of every two sources of a language."""
    others = groups.select(
        "lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"), F.col("own").alias("own_b"),
        F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"),
    )

    def against(rows: DataFrame, *by: str) -> DataFrame:
        dealt = rows.withColumn("piece", F.pmod(F.xxhash64(*by), F.lit(PIECES)).cast("int"))
        return dealt.join(others, ["lang", "piece"]).where("source <> item")

    untouched = against(groups, "source").select(
        "lang", "source", "item",
        ((F.col("kept") - F.col("own") - F.col("own_b")) * F.abs(F.col("zero") - F.col("zero_b"))).alias("value"),
    )
    # Many terms have one share: a table of shares is far smaller than the terms.
    shares = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    own = (
        against(shares, "source", "p").groupBy("lang", "source", "item")
        .agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("zero_b"))).alias("value"))
    )
    left = rated.select("lang", "term", "source", "p", "zero")
    right = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("zero").alias("zero_r"))
    p, r, zero, zero_r = (F.col(c) for c in ("p", "r", "zero", "zero_r"))
    shared = (
        left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item")
        .agg(F.sum(F.abs(p - r) - F.abs(p - zero_r) - F.abs(zero - r) + F.abs(zero - zero_r)).alias("value"))
    )
    both = own.unionByName(shared)
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return (
        untouched.unionByName(both).unionByName(turned)
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): where the sources of each language differ.

    Part ``pair`` ranks the other sources of the language by the sum of absolute differences of
    their term shares, part ``term`` the ``top_terms`` terms that the source uses more than its
    language does, by the difference. Kept are the terms in ``min_docs`` documents of the language.
    Null lang, source and text are ''; a text without terms still makes its group occur. Every row
    is a document, repeated rows too. Ties go to the first item in UTF-8 order. A language without
    kept terms has pairs of value 0 and no terms; an empty table gives no rows. Only the three
    columns are read, so further columns can't clash.
    """
    slim = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
          for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    )
    term = Window.partitionBy("lang", "term")
    kept = stage(
        count_terms(slim)
        .withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term),
                      "first": F.col("source") == F.min("source").over(term)})
        .where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"), "kept-terms",
    )
    groups = stage(_groups(slim, kept), "groups")
    rated = stage(rated_terms(kept, groups), "rated-terms")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (
        rated.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    )
    pairs = divergences(rated, groups).withColumn("rank", F.row_number().over(best))
    return (
        pairs.withColumn("part", F.lit("pair")).unionByName(over.withColumn("part", F.lit("term")))
        .select("lang", "source", "part", "item", "value", "rank")
    )


# The same rows for DuckDB, from the definition: every kept term of every group, zeros included.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         row_number() OVER () AS doc
  FROM documents
),
words AS (
  SELECT lang, source, doc, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
occur AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
filled AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(o.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN occur o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
),
totals AS (SELECT lang, source, sum(n) AS total FROM filled GROUP BY lang, source),
shares AS (
  SELECT f.lang, f.source, f.term, f.n,
         1 + (1000000000::HUGEINT * (f.n + 5)) // (t.total + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (f.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM filled f JOIN totals t USING (lang, source) JOIN langs l USING (lang)
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
