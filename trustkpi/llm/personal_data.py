"""Personal data, also in disguise.

Base detectors read the text as it is. For disguises a text passes through transducers, each of
which rewrites pieces of it and keeps, for every character it puts out, the source characters it
stands for: look-alike and invisible characters, character references, spelled digits, and "at" and
"dot" in words, brackets or spaces. The same detectors read the outcome; a finding that rests on a
rewritten piece is mapped back to source characters and added to the base ones.

Plain words such as "at" are rewritten only where an address can follow, and a finding that rests
on them must end in a known top-level domain, so prose stays prose.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustkpi.llm.shared import text_map

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end in code points

# Possessive and anchored at the run's start: the same matches as the plain patterns, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_TO_DIGITS = {c: None for c in range(128) if not chr(c).isdigit()}

# Last labels of addresses that plain words may hide.
TOP_DOMAINS = frozenset(
    """com org net edu gov mil int info biz name pro io co me app dev ai tv cc ly xyz online site shop blog tech cloud store
    email example test invalid local localhost
    ar at au be br ca ch cl cn cz de dk ee es eu fi fr gr hk hu ie il in is it jp kr lt lu lv mx my nl no nz
    pe ph pl pt ro ru se sg si sk th tr tw ua uk us uy ve vn za""".split()
)
# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip("авеёкмнорстухѕіїјһԁԛԝгАВЕЁКМНОРСТУХЅІЇЈԌԚԜ", "abeekmhopctyxsiijhdqwrABEEKMHOPCTYXSIIJGQW")
) | dict(zip("αβγεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abyeiknoptuxwABEZHIKMNOPTYX")) | dict(zip("ıɑɡɩʟɴʀ", "iagilnr")) | {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹘": "-", "۔": ".", "。": ".", "․": ".", "·": ".",
    "•": ".", "∙": ".", "⋅": ".", "＋": "+", "➕": "+",
}
# Words for digits in the corpus' languages.
DIGIT_WORDS = {
    word: str(value)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for value, word in enumerate(words.split())
}
# Words that stand before "dot com" in prose.
_ARTICLES = frozenset("the a an this that my our your his her its their".split())
_TIMES = {"double": 2, "triple": 3}
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣﻿"
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@.+-()_%[]{}<>&#; ")


@lru_cache(maxsize=65536)
def folded(char: str) -> str:
    """The plain character that ``char`` looks like, '' for an invisible one, else itself."""
    if char in _INVISIBLE:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain in _PLAIN else LOOK_ALIKES.get(plain, char)


class Traced:
    """A text whose every character knows the source characters [start, end) it stands for.

    Kept as pieces: (where the piece starts in the text, its source start and end, what rewrote
    it). An untouched piece maps one to one, a rewritten one stands for its source as a whole.
    """

    def __init__(self, text: str):
        self.text = text
        self.at = [0]
        self.pieces = [(0, len(text), "")]

    def _cut(self, start: int, end: int) -> list[tuple[str, int, int, str]]:
        """Pieces of [start, end) as (text, source start, source end, mark)."""
        out, i = [], bisect_right(self.at, start) - 1
        while start < end:
            until = self.at[i + 1] if i + 1 < len(self.at) else len(self.text)
            stop = min(end, until)
            source, source_end, mark = self.pieces[i]
            if not mark:
                source, source_end = source + start - self.at[i], source + stop - self.at[i]
            if stop > start:
                out.append((self.text[start:stop], source, source_end, mark))
            start, i = max(start, stop), i + 1
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        parts = self._cut(start, end)
        return parts[0][1], parts[-1][2]

    def marks(self, start: int, end: int) -> set[str]:
        """What rewrote the characters of [start, end); a character left out between two of them is a "sign"."""
        parts = self._cut(start, end)
        gap = any(a[2] < b[1] for a, b in zip(parts, parts[1:]))
        return {mark for _, _, _, mark in parts if mark} | ({"sign"} if gap else set())

    def rewritten(self, edits: list[tuple[int, int, str, str]]) -> Traced:
        """With each (start, end, replacement, mark), in order and apart, put in."""
        if not edits:
            return self
        parts: list[tuple[str, int, int, str]] = []
        done = 0
        for start, end, new, mark in edits:
            parts += self._cut(done, start)
            if new:
                parts.append((new, *self.source(start, end), mark))
            done = end
        parts += self._cut(done, len(self.text))
        out = Traced("")
        out.text = "".join(p[0] for p in parts)
        out.at, out.pieces, length = [], [], 0
        for text, source, source_end, mark in parts:
            out.at.append(length)
            out.pieces.append((source, source_end, mark))
            length += len(text)
        if not parts:
            out.at, out.pieces = [0], [(0, 0, "")]
        return out


# --- transducers: each takes a Traced text and gives the next one ---

_BEYOND = re.compile(r"[^\x00-\x7F]")


def plain_characters(t: Traced) -> Traced:
    """Look-alike, wide and styled characters become plain ones, invisible ones go; O and l in numbers become 0 and 1."""
    if not t.text.isascii():
        found = ((m, folded(m[0])) for m in _BEYOND.finditer(t.text))
        t = t.rewritten([(m.start(), m.end(), plain, "sign") for m, plain in found if plain != m[0]])
    edits = []
    for m in _NUMBER.finditer(t.text):
        letters = [i for i in range(m.start(), m.end()) if t.text[i] in "oOlI|"]
        if 2 * len(letters) < m.end() - m.start():
            edits += [(i, i + 1, "0" if t.text[i] in "oO" else "1", "sign") for i in letters]
    return t.rewritten(edits)


_NUMBER = re.compile(r"(?<![A-Za-z0-9|])(?:[oOlI|]{1,3}[0-9]|[0-9]++[oOlI|])[0-9oOlI|]*+(?![A-Za-z0-9])")
_REFERENCE = re.compile(r"(?i)&#0*(64|46|43);|&#x0*(40|2e|2b);|&(commat|period|plus);|%(40|2e|2b)")
_SIGNS = {"64": "@", "46": ".", "43": "+", "40": "@", "2e": ".", "2b": "+", "commat": "@", "period": ".", "plus": "+"}


def references(t: Traced) -> Traced:
    """Character references and percent signs for @, dot and plus."""
    if "&" not in t.text and "%" not in t.text:
        return t
    found = _REFERENCE.finditer(t.text)
    return t.rewritten([(m.start(), m.end(), _SIGNS[m[m.lastindex].lower()], "sign") for m in found])


_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ITEM = rf"(?:(?:double|triple)[ \t-]+)?(?:{_WORDS})(?![^\W_])"
_ONE = re.compile(rf"[ \t.,()+-](?:{_WORDS})[ \t.,()+-]")
_TWO = re.compile(rf"(?i)(?<![^\W_]){_ITEM}[ \t.,-]+(?:(?:dot|point|punkt|punto|hyphen|dash|{_WORDS}|double|triple|[0-9]))")
_RUN = re.compile(
    rf"(?i)(?<![^\W_])(?:plus[ \t-]+)?\+?\(?(?:{_ITEM}|[0-9]+)"
    rf"(?:[ \t.,()+-]*[ \t.,()-](?:{_ITEM}|[0-9]+|(?:oh|o)(?![^\W_])|(?:dot|point|punkt|punto|dash|hyphen)(?![^\W_])))*"
)
_TOKEN = re.compile(rf"(?i)plus|(?:(double|triple)[ \t-]+)?({_WORDS}|oh|o)(?![^\W_])|dot|point|punkt|punto|dash|hyphen|[0-9]+")


def spelled_digits(t: Traced) -> Traced:
    """Runs with three or more digits in words become digits; "plus", "dot" and "dash" count within them."""
    # The middle one of three stands between separators.
    if not (_ONE.search(t.text.lower()) and _TWO.search(t.text)):
        return t
    edits = []
    for run in _RUN.finditer(t.text):
        items = list(_TOKEN.finditer(t.text, run.start(), run.end()))
        spelled = [m for m in items if m[2]]
        if len(spelled) < 3:
            continue
        last = None
        for m in items:
            word = m[0].lower()
            new = None
            if m[2]:
                digit = DIGIT_WORDS.get(m[2].lower(), "0")
                new = digit * _TIMES.get((m[1] or "").lower(), 1)
            elif word == "plus":
                new = "+"
            elif word in ("dash", "hyphen"):
                new = "-"
            elif word[0] not in "0123456789":
                new = "."
            if last is not None and (new is not None or last[1]) and t.text[last[0] : m.start()].strip(" \t,") == "":
                if last[0] < m.start():  # what stands between words of one number
                    edits.append((last[0], m.start(), "", "digits"))
            if new is not None:
                edits.append((m.start(), m.end(), new, "digits"))
            last = (m.end(), new is not None)
    return t.rewritten(edits)


_DOT_WORD = r"dot|d0t|punkt|punto|point"
_AT_WORD = r"at|a|@|ät|arroba|bei|chez"
_DOT = re.compile(
    rf"(?i)(?<=[A-Za-z0-9_%+-])(?:[ \t]*[\[({{<][ \t]*(?P<strong>\.|{_DOT_WORD})[ \t]*[\])}}>][ \t]*"
    rf"|[ \t]+(?:{_DOT_WORD})[ \t]+|[-_](?:dot)[-_]|[ \t]+\.[ \t]+)(?=[A-Za-z0-9])"
)
_AT = re.compile(
    rf"(?i)(?<=[A-Za-z0-9_%+-])(?:[ \t]*[\[({{<][ \t]*(?P<strong>{_AT_WORD})[ \t]*[\])}}>][ \t]*"
    rf"|[ \t]+(?P<word>at|arroba|ät)[ \t]+|[-_](?P<joined>at)[-_]|[ \t]+@[ \t]*|[ \t]*@[ \t]+)(?=[A-Za-z0-9])"
)
_JOIN = re.compile(r"(?i)(?<=[A-Za-z0-9])[ \t]+(underscore|dash|hyphen)[ \t]+(?=[A-Za-z0-9])")
# One of these must occur in the lowered text for the two transducers below to find anything.
_HINTS = [
    re.compile(p)
    for p in (
        rf"[\[({{<][ \t]*(?:\.|{_DOT_WORD}|{_AT_WORD})[ \t]*[\])}}>]", rf"[ \t_-](?:{_DOT_WORD}|arroba|ät)[ \t_-]",
        r"[ \t]@|@[ \t]", r"[0-9][ \t]+\.[ \t]+[0-9]", r"[ \t]at[ \t]+[a-z0-9-]++\.[a-z0-9]", r"[_-]at[_-]",
    )
]


def dots(t: Traced) -> Traced:
    return t.rewritten([(m.start(), m.end(), ".", "sign" if m["strong"] else "dot") for m in _DOT.finditer(t.text)])


def ats(t: Traced) -> Traced:
    """At signs in words, brackets or spaces, before what can be a domain; "underscore" and "dash" in front of one."""
    edits = []
    for m in _AT.finditer(t.text):
        if _DOMAIN.match(t.text, m.end()):
            edits.append((m.start(), m.end(), "@", "sign" if m["strong"] else "at" if m["word"] else "space"))
    if not edits:
        return t
    t = t.rewritten(edits)
    return t.rewritten([(m.start(), m.end(), "_" if m[1].lower() == "underscore" else "-", "dot") for m in _JOIN.finditer(t.text)])


def normalised(text: str) -> Traced:
    t = spelled_digits(references(plain_characters(Traced(text))))
    low = t.text.lower()
    return ats(dots(t)) if any(hint.search(low) for hint in _HINTS) else t


# --- detectors ---


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Around each @: the run of local characters before it, back to the last address, and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                done = found.end()
                out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> list[Span]:
    """Base findings: leftmost and apart within a kind, failing matches dropped; by start, then kind."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].translate(_TO_DIGITS)
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_TO_DIGITS)) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _email_in_disguise(t: Traced, start: int, end: int) -> tuple[int, int] | None:
    """The part of a finding that holds as an address, given what it rests on."""
    at = t.text.index("@", start, end)
    marks, at_marks, tail = t.marks(start, end), t.marks(at, at + 1), t.marks(at, end)
    if not marks:
        return None
    if "dot" in tail or at_marks & {"at", "space"}:
        while True:
            label = t.text[t.text.rindex(".", at, end) + 1 : end].lower()
            if label in TOP_DOMAINS:
                break
            end = t.text.rindex(".", at, end)
            if "." not in t.text[at:end]:
                return None
    if "at" in at_marks:
        told = t.marks(at + 1, end) & {"dot", "sign"} or re.search(r"[0-9._%+-]", t.text[start:at])
        if not told or t.text[at + 1 : end].split(".")[0].lower() in _ARTICLES:
            return None
    return (start, end) if t.marks(start, end) else None


def find(text: str | None) -> tuple[list[Span], list[tuple[int, int, int, str]]]:
    """(base findings, added findings with their plain form), places in code points of ``text``."""
    text = text or ""
    base = detect(text)
    t = normalised(text)
    if len(t.pieces) == 1:
        return base, []
    known, added = set(base), []
    for start, kind, end in detect(t.text):
        if kind == 0:
            part = _email_in_disguise(t, start, end)
            if part is None:
                continue
            start, end = part
        elif not t.marks(start, end):
            continue
        source, source_end = t.source(start, end)
        if (source, kind, source_end) not in known:
            known.add((source, kind, source_end))
            added.append((source, kind, source_end, t.text[start:end]))
    return base, added


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean,plain:string>>"


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``personal``: the findings of each whole text by start, then kind.

    Each has kind, start, end (code points, end exclusive), disguised (not found by the base
    detectors) and plain (its form without disguise). A null text is empty; repeated rows get equal
    results; columns that have the name of a new one are replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("disguised", pa.bool_()), ("plain", pa.string())]))

    def run(texts):
        out = []
        for raw in texts:
            text = (raw or b"").decode()
            base, added = find(text)
            rows = [(s, k, e, False, text[s:e]) for s, k, e in base] + [(s, k, e, True, p) for s, k, e, p in added]
            out.append([{"kind": KINDS[k], "start": s, "end": e, "disguised": d, "plain": p} for s, k, e, d, p in sorted(rows)])
        return [pa.array(out, kind)]

    return text_map(docs, run, f"personal {_SPANS}", text_col, keep)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base findings by kind, their digest, and all findings as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("personal", lambda s: ~s["disguised"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(
        *[c for c in found.columns if c != "personal"], *counts,
        F.sha2(F.concat_ws(",", F.transform(base, shown)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("personal", shown)).alias("spans"),
    )


def masked(text: str | None) -> str | None:
    """``text`` with every finding replaced by its kind in brackets; findings that overlap by the first one's."""
    if text is None:
        return None
    base, added = find(text)
    out, done = [], 0
    for start, kind, end in sorted([*base, *(a[:3] for a in added)], key=lambda s: (s[0], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind]}]"]
        done = max(done, end)
    return "".join(out) + text[done:]
