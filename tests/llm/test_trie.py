"""Prefix trie against brute force."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from trustkpi.llm import prefix_trie


def brute_trie(rows):
    """rows: (conv_id, turn, role, text). Every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    built = {c: turns.get(c - c % 5, [])[: heads[c]] + ts[heads[c] :] for c, ts in turns.items()}
    members = defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def subtree(path):
        below, todo = [], [path]
        while todo:
            at = todo.pop()
            below.append(at)
            todo += children[at]
        return below

    out = []
    for path, who in members.items():
        under = subtree(path)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in who if len(built[c]) == len(path))
        out.append((who[0], len(path), members[path[:-1]][0] if path else None, len(who), len(children[path]),
                    sum(not children[p] for p in under), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


SCHEMA = "conv_id bigint, turn bigint, role string, text string, lead string, k int"


def check(frame, rows, block):
    got = prefix_trie.rebuilt_trie(frame([(*r, "x", 1) for r in rows], SCHEMA), block=block).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute_trie(rows)


@pytest.mark.parametrize("block,seed", [(4, 1), (1, 2), (3, 3)])
def test_trie_matches_brute_force(frame, block, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(60):
        rows += [(c, t, draw.choice(["user", None]), f"é{draw.choice('ab')}" * (t % 3)) for t in range(draw.randint(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(9)]  # copies
    rows += [(77, t, "user", f"turn {t}") for t in range(75)] + [(75, t, "user", f"turn {t}") for t in range(70)]  # long ones
    rows += [(200, None, "a", "x"), (200, None, "a", "x"), (200, 1, None, None), (None, 1, "a", "lost"), (203, 5, "b", "only")]
    draw.shuffle(rows)
    check(frame, rows, block)


def test_tiny_and_empty_tables(frame):
    assert prefix_trie.rebuilt_trie(frame([], SCHEMA)).collect() == []
    check(frame, [(4, 0, "user", "alone")], 4)  # its first turns are replaced by those of conversation 0: none
    check(frame, [(0, 0, "user", None), (5, 0, None, "é" * 10000)], 2)
