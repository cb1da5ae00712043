"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task builds the suffix array of a shard of documents (one Arrow batch) over word
numbers and binary-searches every suffix of every benchmark item in it. The benchmark
is broadcast in blocks of bounded size; a larger one takes several passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustkpi.llm.shared import text_map, without
from trustkpi.session import stage

WINDOW = 13
BLOCK_BYTES = 16_000_000
# Words are runs of 0-9, a-z and all beyond ASCII, after A-Z is lower-cased.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


@dataclass
class Block:
    """Benchmark items as word numbers from 1; 0 is any other word or the end of a text."""

    numbers: dict[bytes, int]
    names: list[str]
    items: list[np.ndarray]

    @property
    def bits(self) -> int:
        return max(1, len(self.numbers).bit_length())


def make_block(rows: list[tuple[str, str | None]]) -> Block:
    numbers: dict[bytes, int] = {}
    names, items = [], []
    for name, text in rows:
        words = words_of(text.encode() if text else None)
        if words:
            names.append(name)
            items.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64))
    return Block(numbers, names, items)


def _packed(ids: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """The next ``per_key`` word numbers of every position in one integer; past the end they are 0."""
    key = np.zeros(len(ids), np.int64)
    for k in range(per_key):
        key <<= bits
        if k < len(ids):
            key[: len(ids) - k] |= ids[k:]
    return key


def suffix_array(ids: np.ndarray, key: np.ndarray, per_key: int, depth: int) -> np.ndarray:
    """Positions with a benchmark word, ordered by their next ``depth`` words.

    Suffixes that begin with another word match nothing and are left out. Sorted by the
    packed first words, then by doubling: only suffixes still equal are sorted again.
    """
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    order = np.argsort(key[at], kind="stable")
    sa = at[order]
    sorted_key = key[sa]
    first = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.zeros(len(ids) + 2 * depth + 1, np.int64)
    start = np.maximum.accumulate(np.where(first, np.arange(len(sa)), 0))
    rank[sa] = start + 1
    done = per_key
    while done < depth:
        alone = first & np.append(first[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        s = sa[tied]
        mine, after = rank[s], rank[s + done]
        again = np.lexsort((after, mine))
        sa[tied] = s = s[again]
        mine, after = mine[again], after[again]
        new = np.append(True, (mine[1:] != mine[:-1]) | (after[1:] != after[:-1]))
        first[tied] = new
        rank[s] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + 1
        done *= 2
    return sa


def _narrow(key, sa, low, high, item, at, depth, bits, per_key):
    """Of the suffixes sa[low:high], which share item[at:] with the last to come at ``at + depth``."""
    while depth and low < high:
        take = min(per_key, depth)
        want = 0
        for k in range(per_key):
            want = want << bits | (int(item[at + k]) if k < take else 0)
        span = key[sa[low:high] + at] if high - low < len(sa) else key[sa + at]
        top = want + (1 << bits * (per_key - take))
        low, high = low + np.searchsorted(span, want), low + np.searchsorted(span, top)
        at += take
        depth -= take
    return low, high


def search(texts: list[list[bytes]], block: Block, window: int = WINDOW):
    """Per document: hit mask over its words, item numbers found, longest match (length, item, start)."""
    lengths = np.array([len(w) for w in texts])
    per_key = max(1, 62 // block.bits)
    depth = max((len(i) for i in block.items), default=0)
    total = int(lengths.sum())
    ids = np.zeros(total + len(texts) + 1, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    for s, words in zip(starts, texts):
        ids[s : s + len(words)] = np.fromiter(map(block.numbers.get, words, repeat(0)), np.int64, len(words))
    hit = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[int]] = {}
    longest: dict[int, tuple[int, int, int]] = {}
    ends: list[tuple[np.ndarray, int, int]] = []  # (places, length of the match that starts there, item)
    if total and block.items:
        key = _packed(ids, block.bits, per_key)
        sa = suffix_array(ids, key, per_key, depth)
        key = np.concatenate([key, np.zeros(depth + per_key, np.int64)])
        head = key[sa]
        for number, item in enumerate(block.items):
            size = min(window, len(item))
            take = min(per_key, size)
            n_start = len(item) - size + 1
            want = np.zeros(n_start, np.int64)
            for k in range(per_key):
                want <<= block.bits
                if k < take:
                    want |= item[k : k + n_start]
            lows = np.searchsorted(head, want)
            highs = np.searchsorted(head, want + (1 << block.bits * (per_key - take)))
            for at in np.flatnonzero(lows < highs):
                sub = item[at:]
                low, high = _narrow(key, sa, lows[at], highs[at], sub, take, size - take, block.bits, per_key)
                if low >= high:
                    continue
                found = sa[low:high]
                np.add.at(hit, found, 1)
                np.add.at(hit, found + size, -1)
                doc_of = np.searchsorted(starts, found, side="right") - 1
                for d in np.unique(doc_of):
                    items.setdefault(int(d), set()).add(number)
                # Longest matches start where the word before differs; places that stop agreeing fall out word by word.
                if at and (ids[found - 1] == item[at - 1]).all():
                    continue
                reach = size
                while low < high:
                    a, b = _narrow(key, sa, low, high, sub, reach, 1, block.bits, per_key) if reach < len(sub) else (high, high)
                    ends += [(part, reach, number) for part in (sa[low:a], sa[b:high]) if len(part)]
                    low, high, reach = a, b, reach + 1
    if ends:
        place = np.concatenate([part for part, _, _ in ends])
        reach, number = (np.repeat([e[k] for e in ends], [len(e[0]) for e in ends]) for k in (1, 2))
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((place, number, -reach, doc))
        for i in order[np.append(True, np.diff(doc[order]) > 0)]:
            longest[int(doc[i])] = (int(reach[i]), int(number[i]), int(place[i] - starts[doc[i]]))
    covered = np.cumsum(hit)[:-1] > 0
    return [covered[s : s + n] for s, n in zip(starts, lengths)], items, longest


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_FIELDS = (
    "_words bigint, _spans array<struct<start:bigint,end:bigint>>, _items array<string>, "
    "_longest struct<length:bigint,item:string,start:bigint>"
)


def _pass(docs: DataFrame, block: Block, window: int, text_col: str, keep, merge: bool) -> DataFrame:
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(block)
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()),
             pa.struct([("length", pa.int64()), ("item", pa.string()), ("start", pa.int64())])]
    names = T.StructType.fromDDL(_FIELDS).names
    if merge:
        names = [n + "2" for n in names]

    def run(texts):
        block = shared.value
        words = [words_of(t) for t in texts]
        masks, items, longest = search(words, block, window)
        best = []
        for d in range(len(texts)):
            length, number, start = longest.get(d, (0, 0, 0))
            best.append({"length": length, "item": block.names[number], "start": start} if length else None)
        columns = [
            [len(w) for w in words], [_spans(m) for m in masks],
            [sorted({block.names[i] for i in items.get(d, ())}) for d in range(len(texts))], best,
        ]
        return [pa.array(c, k) for c, k in zip(columns, kinds)]

    fields = _FIELDS
    for old in ("_words", "_spans", "_items", "_longest"):
        fields = fields.replace(old + " ", old + ("2 " if merge else " "))
    return text_map(docs, run, fields, text_col, keep)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """(number of blocks, function that fetches block k): each about ``block_bytes`` of items."""
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    size = rows.agg(F.sum(F.octet_length("t") + 64).alias("s")).first()["s"] or 0
    count = -(-int(size) // block_bytes) or 1

    def fetch(k: int) -> Block:
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).distinct()
        return make_block(sorted((r["i"], r["t"]) for r in part.collect()))

    return count, fetch


def _better(one: str, other: str):
    """Whether match ``one`` is the longer, or as long with the smaller item id; a null match is the shortest."""
    size, least = (F.coalesce(F.col(f"{m}.length"), F.lit(0)) for m in (one, other))
    return (size > least) | ((size == least) & (F.col(f"{one}.item") < F.col(f"{other}.item")))


def _finish(found: DataFrame, names: list[str]) -> DataFrame:
    union = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
    )["n"]
    out = found.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("_words").alias("n_words"), union.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
        F.col("_items").alias("items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        F.col("_longest").alias("longest"),
    )
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


NEW = ("n_words", "n_hit", "n_items", "items", "items_sha256", "longest", "contaminated")


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and the longest match.

    ``items`` lists the ids of items that share a window with the document, as text in
    order; ``longest`` is the document's longest verbatim match (length in words, item, start
    word), of equal ones that of the smallest item id, then the first.
    Null texts have no words. Items with equal ids count once, an item without id has the
    id ''. An empty benchmark leaves every document clean, and repeated rows get equal
    results. A column that has the name of a new one is replaced.
    """
    rows = without(docs, *NEW)
    carried = [c for c in (rows.columns if keep is None else keep) if c in rows.columns]
    count, fetch = blocks_of(benchmark, item_col, item_text, block_bytes)
    found = [n.split()[0] for n in ("_words", "_spans", "_items", "_longest")]
    out = None
    for k in range(count):
        again = list(dict.fromkeys([*carried, text_col])) if k + 1 < count else carried  # later blocks need the texts
        if out is None:
            out = _pass(rows, fetch(k), window, text_col, again, False)
            continue
        # Another block: the texts are read again beside what was found before.
        out = _pass(stage(out, "overlaps"), fetch(k), window, text_col, [*again, *found], True)
        out = out.withColumns({
            "_spans": F.concat("_spans", "_spans2"),
            "_items": F.array_sort(F.array_union("_items", "_items2")),
            "_longest": F.when(_better("_longest2", "_longest"), F.col("_longest2")).otherwise(F.col("_longest")),
        }).drop("_words2", "_spans2", "_items2", "_longest2")
    return _finish(out, carried)
