"""Source divergence audit against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from trustkpi.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, min_docs=30, top=50):
    """rows: (lang, source, text). Every kept term of every group, zeros included."""
    counts, with_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        with_docs[lang].update(set(found))
    kept = {lang: sorted(t for t, n in with_docs[lang].items() if n >= min_docs) for lang, _ in groups}

    def shares(lang, count):
        n = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p = shares(lang, counts[lang, source])
        q = shares(lang, sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            r = shares(lang, counts[lang, other])
            pairs.append((-sum(abs(p[t] - r[t]) for t in p), other.encode()))
        over = [(-(p[t] - q[t]), t.encode()) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def sample():
    rows = [("en", f"s{i % 4}", f"Alpha beta{'x' * (i % 3)} GAMMA-delta é{i % 2} Été {'rare ' * (i % 5)}") for i in range(40)]
    rows += [("en", "hot", "alpha " * 3000 + "beta\x00beta_Ünïcode😀 [x]`y{z}~\x7fend")] * 30
    rows += [("de", None, None), ("de", "b", ""), (None, "b", "solo"), ("", None, "solo"), ("fr", "", "!!!"), ("fr", "z", "x" * 50000)]
    return rows


@pytest.mark.parametrize("min_docs,top", [(1, 3), (8, 50), (30, 50), (99, 5)])
def test_audit_matches_brute_force(frame, min_docs, top):
    docs = frame([(*r, 1, "t") for r in sample()], "lang string, source string, text string, value int, term string")
    got = divergence.audit(docs, min_docs=min_docs, top_terms=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(sample(), min_docs, top)


def test_counters_sent_early_change_nothing(frame, monkeypatch):
    docs = frame(sample(), "lang string, source string, text string")
    whole = sorted(map(tuple, divergence.audit(docs, min_docs=2).collect()))
    monkeypatch.setattr(divergence, "HELD_PAIRS", 3)
    assert sorted(map(tuple, divergence.audit(docs, min_docs=2).collect())) == whole


def test_audit_of_an_empty_table(frame):
    assert divergence.audit(frame([], "lang string, source string, text string")).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    pairs = [(0, 5), (4, 5), (7, 9 * 10**15 - 1), (9 * 10**15 - 2, 9 * 10**15 - 1), (123456789012345, 8 * 10**15 + 1)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(pairs, "c bigint, t bigint").select(divergence.share(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * c // t for c, t in pairs]


def test_sql_says_the_same(frame):
    import pandas as pd

    documents = pd.DataFrame([(i, *r) for i, r in enumerate(sample())], columns=["doc_id", "lang", "source", "text"])  # noqa: F841
    got = duckdb.sql(divergence.SQL).fetchall()
    assert sorted(got) == brute_audit(sample())
