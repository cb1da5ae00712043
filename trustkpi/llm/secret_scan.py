"""Secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every match
must contain, for each conjunct, all trigrams of one of its alternatives. Postings
(trigram, document) are kept for the trigrams the rules ask for; intersecting them gives
each rule's candidates, which the regular expression itself then verifies. A rule whose
expression demands no trigram reads every text. Spark functions only.
"""

from __future__ import annotations

import re._parser as regex_tree
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustkpi.llm.shared import packed, row_key, unpacked, without
from trustkpi.session import stage


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The base rules, in their order.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, ignore_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # Of the runs of hex digits only those of 24 and more count, and no run overlaps another.
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
# Further formats that public services use for their keys.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
_MOST = 64  # strings a part may stand for before it is taken as "anything"

Conjunct = frozenset[frozenset[str]]


def _parts(tree) -> list[set[str] | None | tuple]:
    """A sequence as parts: a set of strings, None for anything, or ("or", queries) for a mixed choice."""
    out: list = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(value)})
        elif name == "SUBPATTERN":
            out += _parts(value[3])
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 16:
            out.append({chr(v) for _, v in value})
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, item = value
            inner = _merged(_parts(item))
            whole = inner[0] if len(inner) == 1 and isinstance(inner[0], set) else None
            if whole is not None and high == 1:
                out.append(whole | {""} if low == 0 else whole)
            elif whole is not None and low == high and len(whole) ** int(low) <= _MOST:
                out += [whole] * int(low)
            elif low > 0:
                out += [*inner, None]
            else:
                out.append(None)
        elif name == "BRANCH":
            choices = [_merged(_parts(c)) for c in value[1]]
            if all(len(c) == 1 and isinstance(c[0], set) for c in choices):
                out.append(set().union(*(c[0] for c in choices)))
            else:
                out += [None, ("or", [_conjuncts(c) for c in choices]), None]
        elif name != "AT":
            out.append(None)
    return out


def _merged(parts: list) -> list:
    """Neighbouring sets of strings joined into sets of longer strings."""
    out: list = []
    for part in parts:
        if isinstance(part, set) and out and isinstance(out[-1], set) and len(out[-1]) * len(part) <= _MOST:
            out[-1] = {a + b for a, b in product(out[-1], part)}
        else:
            out.append(part)
    return out


def _conjuncts(parts: list) -> list[Conjunct]:
    found = []
    for part in parts:
        if isinstance(part, set):
            words = [w.lower() for w in part]
            alternatives = frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)
            if all(alternatives):  # a string of under three characters demands nothing
                found.append(alternatives)
        elif part is not None:
            if all(part[1]):  # each choice demands something: one of their first demands holds
                found.append(frozenset().union(*(choice[0] for choice in part[1])))
    return found


def trigram_query(rule: Rule) -> list[Conjunct]:
    """What each match of ``rule`` must contain, in lower case; empty if nothing."""
    flags = regex_tree.parse(rule.pattern)
    return _conjuncts(_merged(_parts(flags)))


def _clauses(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, conjuncts, conjunct, alternative, needed, trigram): the queries as a small table."""
    rows = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule)
        for c, conjunct in enumerate(query):
            for a, grams in enumerate(sorted(conjunct, key=sorted)):
                rows += [(r, len(query), c, a, len(grams), g) for g in sorted(grams)]
    names = ("rule", "conjuncts", "conjunct", "alternative", "needed", "trigram")
    rows = rows or [(-1, 1, 0, 0, 1, "")]
    return spark.range(1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]))
    )


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "_text") -> DataFrame:
    """(trigram, _key): which texts contain which of the asked trigrams, without regard to ASCII case."""
    low = F.lower(F.col(text_col))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("_key", low.alias("_low")).select("_key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, clauses: DataFrame) -> DataFrame:
    """(_key, rules): documents whose postings satisfy a rule's query, with the numbers of those rules."""
    # The table of clauses is as small as the rules.
    held = (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("_key", "rule", "conjuncts", "conjunct", "alternative", "needed")
        .agg(F.countDistinct("trigram").alias("held")).where("held = needed")
    )
    met = held.groupBy("_key", "rule", "conjuncts").agg(F.countDistinct("conjunct").alias("met")).where("met = conjuncts")
    return met.groupBy("_key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of the matches that count: the pieces between matches give their places."""
    pattern = F.lit(rule.java)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pieces = F.transform(F.slice(F.split(text, rule.java, -1), 1, F.size(found)), F.length)
    parts = F.arrays_zip(pieces.alias("before"), F.transform(found, F.length).alias("size"),
                         F.transform(checked, F.length).alias("checked"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, x):
        start = acc["at"] + x["before"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["size"]).alias("end")))
        return F.struct(
            (start + x["size"]).alias("at"),
            F.when(x["checked"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    listed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    return F.when(F.regexp_like(text, pattern), listed).otherwise(empty)


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", id_col: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start,kind,end>> by start, then rule number.

    Places are code points, the end is exclusive. A null text is empty. Rows with equal id
    and text are looked up together and each gets its result; a null id is as good as any.
    """
    rows = without(docs, "secrets")
    carried = rows.columns if keep is None else keep
    spark = docs.sparkSession
    rows = rows.select(packed(carried), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), row_key(id_col, text_col).alias("_key"))
    queries = [trigram_query(r) for r in rules]
    trigrams = sorted({g for q in queries for c in q for a in c for g in a})
    if trigrams:
        index = stage(postings(rows, trigrams), "postings")
        found = stage(candidates(index, _clauses(spark, rules)), "candidates")
        rows = rows.join(found.hint("merge"), "_key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    per_rule = []
    for number, (rule, query) in enumerate(zip(rules, queries)):
        spans = _spans(F.col("_text"), rule, number)
        asked = F.array_contains("rules", number)
        per_rule.append(F.when(asked, spans).otherwise(empty) if query else spans)
    return rows.select(*unpacked(carried), F.array_sort(F.concat(*per_rule)).alias("secrets"))


def span_text(spans: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
    )


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{rules[k].kind}") for k in range(base)]
    own = F.filter("secrets", lambda s: s["kind"] < base)
    rest = [c for c in found.columns if c != "secrets"]
    return found.select(
        *rest, *counts, F.sha2(span_text(own, rules), 256).alias("base_sha256"), span_text(F.col("secrets"), rules).alias("spans")
    )
