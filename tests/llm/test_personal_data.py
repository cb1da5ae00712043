"""Personal data: base findings against the plain patterns, disguises against the places they were planted at."""

import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trustkpi.llm import personal_data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
CARD = "4111 1111-1111 1111"
TEXTS = [
    None, "", "a@b.c a@b.c@d.e x@@y.z @q.r a.b%+-_@c-d.e-f..g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", f"é😀 {CARD} x{CARD}9",
    "4111111111111111 4111111111111112 41111111 1111 1111 4111  1111", "+1 (017) 555-7713. +1 2 +12345678 +123456789 ++49 1234 5678)",
    "+1" + " -" * 5000 + "2 " + "9" * 30000 + "." * 30000 + "a" * 30000 + "@b", "mail me at a@b.de, or +49.30.1234567\n1.1.1.1\n",
]


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(part) > 255 for part in m[0].split(".")):
                continue
            if kind == 2:
                values = [int(d) for d in digits[::-1]]
                luhn = sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values))
                if not 12 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", [t for t in TEXTS if t is None or len(t) < 50_000])
def test_base_findings(text):
    assert personal_data.detect(text or "") == brute_base(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ0149.@+-% ()é\n", max_size=60))
def test_base_findings_of_any_text(text):
    assert personal_data.find(text)[0] == brute_base(text)


# (text, kind, the disguise as it stands there, what it says)
DISGUISES = [
    ("mail [john.doe [at] example [dot] com] now", "email", "john.doe [at] example [dot] com", "john.doe@example.com"),
    ("é😀 write john dot doe at mail dot example dot org today", "email", "john dot doe at mail dot example dot org", "john.doe@mail.example.org"),
    ("to ann.7 AT mail2.example.com.", "email", "ann.7 AT mail2.example.com", "ann.7@mail2.example.com"),
    ("bob(at)example.com", "email", "bob(at)example.com", "bob@example.com"), ("bob @ example . com", "email", "bob @ example . com", "bob@example.com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com", "john@example.com"), ("x john＠example．com", "email", "john＠example．com", "john@example.com"),
    ("jo​hn@example.com", "email", "jo​hn@example.com", "john@example.com"),
    ("john&#64;example&#46;com", "email", "john&#64;example&#46;com", "john@example.com"),
    ("bob [at] example [dot] com . Then", "email", "bob [at] example [dot] com", "bob@example.com"),
    ("call plus one two three four five five five one two three four", "phone",
     "plus one two three four five five five one two three four", "+12345551234"),
    ("+49 zero one seven double two three four five six seven", "phone", "+49 zero one seven double two three four five six seven", "+490172234567"),
    ("call +1 (O17) 555-77l3.", "phone", "+1 (O17) 555-77l3", "+1 (017) 555-7713"), ("+４９ 30 123 4567", "phone", "+４９ 30 123 4567", "+49 30 123 4567"),
    ("at 192[.]168[.]1[.]10!", "ip", "192[.]168[.]1[.]10", "192.168.1.10"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
    ("card four " + "one " * 14 + "one ok", "card", "four " + "one " * 14 + "one", "4" + "1" * 15),
    ("vier eins eins eins-1111-1111 1111.", "card", "vier eins eins eins-1111-1111 1111", "4111-1111-1111 1111"),
    ("4111–1111–1111–1111", "card", "4111–1111–1111–1111", "4111-1111-1111-1111"),
]


@pytest.mark.parametrize("text,kind,shown,plain", DISGUISES)
def test_disguises_are_mapped_back(text, kind, shown, plain):
    start = text.index(shown)
    assert (start, personal_data.KINDS.index(kind), start + len(shown), plain) in personal_data.find(text)[1]


@pytest.mark.parametrize("text", [
    "meet me at example.com today", "look at the dot com boom", "foo @ bar. Next day", "un deux trois quatre soleil", "at one point six men",
    "the point at issue. One two three.", "see section 1 . 2 and 3", "Привет мир", "été à l'école: 3 × 4", "f(at) x", "zero at dot",
])
def test_prose_stays_prose(text):
    assert personal_data.find(text) == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab4ОоＡ​é1 .@", max_size=40))
def test_traced_characters_keep_their_places(text):
    traced = personal_data.plain_characters(personal_data.Traced(text))
    for i, char in enumerate(traced.text):
        start, end = traced.source(i, i + 1)
        assert end == start + 1 and (char == text[start] or personal_data.folded(text[start]) == char or char in "01")


def test_clean_documents_have_no_disguised_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = personal_data.scan(docs, keep=["doc_id"])
    assert found.selectExpr("inline(personal)").where("disguised").count() == 0
    want = {r.doc_id: brute_base(r.text) for r in docs.collect()}
    for r in personal_data.digest(found).collect():
        listed = personal_data.listed(want[r.doc_id])
        kinds = [k for _, k, _ in want[r.doc_id]]
        assert (r.spans, r.base_sha256) == (listed, sha256(listed.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in range(4)]


def test_rows_columns_and_empty_tables(frame):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, DISGUISES[0][0], "x", 1)] * 2
    docs = frame(rows, "doc_id bigint, text string, personal string, start int")
    got = personal_data.scan(docs).collect()
    assert len(got) == len(rows) and [r.start for r in got] == [1] * len(rows)
    assert [len(r.personal) for r in got if r.doc_id is None] == [1, 1]
    assert [r.spans for r in personal_data.digest(personal_data.scan(docs, keep=["doc_id"])).where("doc_id < 2").collect()] == ["", ""]
    assert personal_data.scan(docs.limit(0)).count() == 0


def test_masked_text():
    assert personal_data.masked("a@b.de or john (at) example.com") == "[email] or [email]"
    assert personal_data.masked(None) is None
