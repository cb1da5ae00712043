"""SimHash near-duplicates, components and substring dedup against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trustkpi.llm import components, recompression, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_print(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    names = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(doc, f"{prints[i]:016x}", names[root(i)]) for i, (doc, _) in enumerate(rows)]


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=4)) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(40):  # near copies
        near = list(base[i % 5])
        near[rng.randrange(len(near))] = "other"
        rows.append((100 + i, "\n".join(near)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "one two"), (7, rows[7][1]), (7, rows[7][1]), (None, None)]
    rows.append((300, "LONG word " * 30000))
    return rows


def test_fingerprints_and_components_match_brute_force(frame):
    rows = corpus()
    docs = frame([(*r, "x") for r in rows], "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print(F.col("fp")), "component_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)


def test_empty_table(frame):
    assert simhash.near_duplicates(frame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("cell_rows", [4_000_000, 40])
def test_links_connect_all_near_fingerprints(frame, cell_rows):
    """A dense cluster, random prints, and the block-by-block way for large cells."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    for _ in range(250):
        flipped = centre
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            flipped ^= 1 << int(bit)
        prints.add(flipped)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    links = simhash.near_links(frame([(p,) for p in signed], "fp bigint"), cell_rows=cell_rows)
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    named = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    for x in signed:
        for y in signed:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4 and x != y:
                assert named[x] == named[y]


def test_components_of_a_path_a_star_and_a_loop(frame):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200), (201, 202), (202, 201)]
    got = {r.node: r.root for r in components.components(frame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert got[201] == got[202] == 201 and 200 not in got


def test_lower_bound_never_exceeds_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 64, (2, 5000), np.uint64)
    low = np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))
    assert (low <= np.bitwise_count(a ^ b)).all()


def brute_repeats(rows, size=20):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        w = (rows[i][1] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            window = tuple(w[p : p + size])
            if window in seen:
                gone[p : p + size] = [True] * size
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((rows[i][0], len(w), sum(gone), sha256(kept).hexdigest()))
    return out


def repeats_corpus():
    rng = random.Random(9)
    text = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnopq") for _ in range(n)]
    passage, long = text(60), text(25)
    rows = []
    for i in range(80):
        w = text(rng.randint(0, 90))
        if i % 3 == 0:
            w = w[:10] + passage[rng.randint(0, 20) : rng.randint(35, 60)] + w[10:]
        if i % 7 == 0:
            w = w + long + long
        rows.append((i, " ".join(w)))
    rows += [(200, "so " * 70), (201, "so " * 45), (202, "x y " * 40), (203, "x y " * 40 + "z"), (204, None), (205, "")]
    rows += [(206, "a\tb\nc\x0bd\re\x0cf " * 12), (None, rows[3][1]), (None, rows[6][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("chunk_bytes", [8_000_000, 2000])
def test_repeats_match_brute_force(frame, chunk_bytes):
    rows = repeats_corpus()
    docs = frame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int").coalesce(1)
    got = recompression.remove_repeats(docs, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes)
    cells = got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    assert all(sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in cells)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted((tuple(r)[:4] for r in cells), key=key) == sorted(brute_repeats(rows), key=key)


def test_repeats_of_an_empty_table(frame):
    assert recompression.remove_repeats(frame([], "doc_id bigint, text string")).count() == 0
