"""Substring dedup by recompression: every repeat of a window of words is found and cut.

Each round of recompression names runs of one symbol and pairs of symbols. A name is a
hash of what it stands for and the choice of pairs depends on the symbols alone, so all
tasks give equal word sequences the same symbols, but for the edges. With each symbol
goes its context: the words that must be there for it to come out as it does. A symbol
whose context lies inside a window is therefore found in every copy of that window.

A window goes by all such symbols of the highest level it contains. Spark gathers the
names of these symbols; windows whose symbols all stand in two places or more are
candidates. Candidates are compared over all their words, and all but the first of equal
ones go.

Documents are dealt to chunks once. The three passes over the chunks are parts of one
Spark query and read the same shuffle files; what they exchange are packed arrays.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustkpi.llm.shared import binary_values
from trustkpi.session import stage

WINDOW = 20
# Contexts grow with the rounds; after three they are up to a window of 20 words.
ROUNDS = 3
CHUNK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
_BIG = 1 << 60
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _find(x: np.ndarray, listed: np.ndarray):
    """(positions of ``x`` that may be in ``listed``, first place there); ``listed`` is sorted.

    A bit table over some bits of the hashes turns most others away before the search.
    """
    bits = max(10, min(24, int(len(listed) * 8).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[(listed >> _U(7)) & _U((1 << bits) - 1)] = True
    at = np.flatnonzero(seen[(x >> _U(7)) & _U((1 << bits) - 1)])
    place = np.searchsorted(listed, x[at])
    inside = place < len(listed)
    at, place = at[inside], place[inside]
    same = listed[place] == x[at]
    return at[same], place[same]


def powers(base: int, count: int) -> np.ndarray:
    """``base`` to the power 0, 1, … modulo 2**64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        have = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(count, base, _U)]))
        _POWERS[base] = have
    return have[:count]


_POWERS: dict[int, np.ndarray] = {}
_BASE = 0xC2B2AE3D27D4EB4F
_UNDO = pow(_BASE, -1, 1 << 64)


def range_hash(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of values[low:high] for many ranges, from running sums; the base is odd, so powers can be undone."""
    n = len(values)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values * powers(_BASE, n), dtype=_U)])
    return (total[high] - total[low]) * powers(_UNDO, n + 1)[low]


# Two random numbers for each byte; white space is ASCII only.
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), _U)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SLAB = 1 << 20


def _slabs(texts: list[bytes]):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= _SLAB or k + 1 == len(texts):
            yield texts[at : k + 1]
            at, size = k + 1, 0


def _slab_words(texts: list[bytes], which: int):
    """(hash of each word, number of words of each text), for a few texts at once."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return _mix(range_hash(_BYTE[which][raw], start, end)), counts


class Chunk:
    """The words of a chunk of documents, in document order, as 64-bit hashes."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        parts = [_slab_words(slab, 0) for slab in _slabs(self.texts)]
        self.one = np.concatenate([np.zeros(0, _U), *[p[0] for p in parts]])
        counts = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def hashes(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of every window at ``at``: 64, and 32 from other numbers for the bytes."""
        second = np.concatenate([np.zeros(0, _U), *[_slab_words(slab, 1)[0] for slab in _slabs(self.texts)]])
        two = (window_hash(second, size, _BASE)[at] >> _U(32)).astype(np.uint32)
        return window_hash(self.one, size, 0x9E3779B97F4A7C15)[at], two

    def windows(self, size: int) -> np.ndarray:
        """Start positions of all windows; none crosses a document's end."""
        n = len(self.doc) - size + 1
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def window_hash(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on, built by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    base = base % (1 << 64)
    out, done = np.zeros(n, _U), 0
    power, width = words, 1  # hashes of ``width`` words
    rest = size
    while rest:
        if rest & 1:
            out = out * _U(pow(base, width, 1 << 64)) + power[done : done + n]
            done += width
        rest >>= 1
        if rest:
            power = power[:-width] * _U(pow(base, width, 1 << 64)) + power[width:]
            width *= 2
    return out


def parse(names: np.ndarray, doc: np.ndarray, rounds: int):
    """Symbols after each round: (name, context start, context end); ends are exclusive.

    A context that reaches beyond its document starts at -1 or ends at a huge number.
    """
    low = np.arange(len(names))
    high = low + 1
    for turn in range(rounds):
        if not len(names):
            return
        same_doc = doc[1:] == doc[:-1]
        # Runs: whether a symbol stands alone depends on both neighbours.
        low_n = np.concatenate([[-1], np.where(same_doc, low[:-1], -1)])
        high_n = np.concatenate([np.where(same_doc, high[1:], _BIG), [_BIG]])
        low, high = np.minimum(low, low_n), np.maximum(high, high_n)
        head = np.flatnonzero(np.concatenate([[True], ~((names[1:] == names[:-1]) & same_doc)]))
        if len(head) < len(names):
            count = np.diff(np.append(head, len(names)))
            tail = head + count - 1
            run = np.where(count > 1, _mix(names[head] + count.astype(_U) * _U(0x9E3779B97F4A7C15)), names[head])
            names, doc, low, high = run, doc[head], low[head], high[tail]
            same_doc = doc[1:] == doc[:-1]
        # Pairs: a bit of the name says whether a symbol looks right (0) or left (1).
        side = (_mix(names + _U(turn + 1)) & _U(1)).astype(bool)
        pair = np.concatenate([~side[:-1] & side[1:] & same_doc, [False]])
        second = np.concatenate([[False], pair[:-1]])
        low_n = np.concatenate([[-1], np.where(same_doc, low[:-1], -1)])
        high_n = np.concatenate([np.where(same_doc, high[1:], _BIG), [_BIG]])
        # One that stays single does so because of the neighbour it looks at; a pair spans both.
        new_low = np.where(side & ~second, np.minimum(low, low_n), low)
        new_high = np.where(~side | pair, np.maximum(high, high_n), high)
        at = np.flatnonzero(pair)
        joined = names.copy()
        joined[at] = _mix(names[at] * _U(0xD6E8FEB86659FD93) + names[at + 1] + _U(0x1234567))
        keep = ~second
        names, doc, low, high = joined[keep], doc[keep], new_low[keep], new_high[keep]
        yield names, low, high


def symbols(chunk: Chunk, size: int, rounds: int):
    """(window starts, names, first, last): the symbols of window i are names[first[i]:last[i]].

    A window's symbols are those of the highest level of which its words determine any. A
    symbol goes by its name and the words of its context.
    """
    at = chunk.windows(size)
    first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    found, count = [], 0
    levels = list(parse(chunk.one, chunk.doc, rounds))
    for level in range(len(levels) - 1, -1, -1):
        names, low, high = levels[level]
        fits = (low >= 0) & (high - low <= size)
        low, high = low[fits], high[fits]
        names = _mix(names[fits] + range_hash(chunk.one, low, high) * _U(2 * level + 1))
        a = np.searchsorted(low, at[open_])
        b = np.searchsorted(high, at[open_] + size, side="right")
        has = a < b
        a, b = a[has], b[has]
        used = np.zeros(len(names) + 1, np.int64)
        np.add.at(used, a, 1)
        np.add.at(used, b, -1)
        used = np.cumsum(used)[:-1] > 0
        place = np.concatenate([[0], np.cumsum(used)]) + count
        first[open_[has]], last[open_[has]] = place[a], place[b]
        found.append(names[used])
        count += len(found[-1])
        open_ = open_[~has]
    # For example inside a run longer than the window: the window is its own symbol.
    found.append(_mix(window_hash(chunk.one, size, 0x9E3779B97F4A7C15)[at[open_]] + _U(5)))
    first[open_] = np.arange(len(open_)) + count
    last[open_] = first[open_] + 1
    return at, np.concatenate(found), first, last


def _ordered(table: pa.Table):
    """Documents of a chunk by id (nulls last), then row: (table rows in that order, ids, nulls, rows)."""
    ids = table.column("id").to_pylist()
    rows = table.column("row").to_numpy()
    null = np.array([i is None for i in ids])
    value = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((rows, value, null))
    return order, value[order], null[order], rows[order]


def _chunk(table: pa.Table):
    order, ids, null, rows = _ordered(table)
    texts = binary_values(table.column("text"))
    return Chunk([texts[i] for i in order]), order, ids, null, rows


def _pack(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(b, kind) for b in column.to_pylist()]])


def _emit_names(buckets: int, size: int, rounds: int):
    def run(key, table):
        names = np.unique(symbols(_chunk(table)[0], size, rounds)[1])
        bucket = (names % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, bucket = names[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        parts = np.split(names, cut) if len(names) else []
        return pa.table({
            "bucket": pa.array(bucket[np.concatenate([[0], cut])] if len(names) else [], pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "names": pa.array([_pack(p, "<u8") for p in parts], pa.binary()),
        })

    return run


def _reduce_names(table):
    """Names that two chunks or more have, listed for each of them."""
    per_chunk = [np.frombuffer(b, "<u8") for b in table.column("names").to_pylist()]
    everything = np.sort(np.concatenate(per_chunk))
    shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
    return pa.table({
        "chunk": table.column("chunk"),
        "names": pa.array([_pack(n[_find(n, shared)[0]], "<u8") for n in per_chunk], pa.binary()),
    })


def _emit_windows(buckets: int, size: int, rounds: int):
    def run(key, table, flags):
        out = {k: [] for k in ("bucket", "one", "two", "many", "doc", "id", "null", "row")}
        if table.num_rows:
            chunk, _, ids, null, rows = _chunk(table)
            at, names, low, high = symbols(chunk, size, rounds)
            ordered = np.sort(names)
            here = ordered[1:][ordered[1:] == ordered[:-1]]
            listed = np.unique(np.concatenate([here, _joined(flags.column("names"), "<u8")]))
            shared = np.zeros(len(names) + 1, np.int64)
            shared[_find(names, listed)[0] + 1] = 1
            shared = np.cumsum(shared)
            candidate = np.flatnonzero(shared[high] - shared[low] == high - low)
            at = at[candidate]
            one, two = chunk.hashes(size, at)
            order = np.lexsort((two, one))  # stable: first place first
            one, two, at = one[order], two[order], at[order]
            first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)])
            many = np.diff(np.append(first, len(one))) > 1
            one, two, doc = one[first], two[first], chunk.doc[at[first]] if len(first) else np.zeros(0, np.int64)
            bucket = (one % _U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                docs, place = np.unique(doc[part], return_inverse=True)
                out["bucket"].append(int(bucket[part[0]]))
                for field, x, kind in (
                    ("one", one[part], "<u8"), ("two", two[part], "<u4"), ("many", many[part], "u1"),
                    ("doc", place, "<u4"), ("id", ids[docs], "<i8"), ("null", null[docs], "u1"), ("row", rows[docs], "<i8"),
                ):
                    out[field].append(_pack(x, kind))
        n = len(out["bucket"])
        return pa.table({
            "bucket": pa.array(out["bucket"], pa.int64()), "chunk": pa.array([key[0].as_py()] * n, pa.int64()),
            **{k: pa.array(out[k], pa.binary()) for k in out if k != "bucket"},
        })

    return run


def _reduce_windows(table):
    """For each chunk its windows that are not all first: hash and whether the chunk has the first."""
    rows = table.to_pylist()
    arrays = {k: [np.frombuffer(r[k], t) for r in rows] for k, t in (
        ("one", "<u8"), ("two", "<u4"), ("many", "u1"), ("doc", "<u4"), ("id", "<i8"), ("null", "u1"), ("row", "<i8"))}
    sizes = [len(x) for x in arrays["one"]]
    source = np.repeat(np.arange(len(rows)), sizes)
    one, two, many = (np.concatenate(arrays[k]) for k in ("one", "two", "many"))
    ids, null, row = (
        np.concatenate([table_[place] for table_, place in zip(arrays[k], arrays["doc"])]) for k in ("id", "null", "row")
    )
    order = np.lexsort((row, ids, null, two, one))
    one_s, two_s = one[order], two[order]
    first = np.append(True, (one_s[1:] != one_s[:-1]) | (two_s[1:] != two_s[:-1]))
    wins = np.zeros(len(one), bool)
    wins[order[first]] = True
    back = ~wins | (many > 0)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    pick = [np.flatnonzero(back[a:b]) + a for a, b in zip(edges, edges[1:])]
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
        "one": pa.array([_pack(one[p], "<u8") for p in pick], pa.binary()),
        "two": pa.array([_pack(two[p], "<u4") for p in pick], pa.binary()),
        "wins": pa.array([_pack(wins[p], "u1") for p in pick], pa.binary()),
    })


def removed_words(chunk: Chunk, size: int, one: np.ndarray, two: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """Mask of the words that windows with an earlier copy cover."""
    n = len(chunk.doc)
    cover = np.zeros(n + 1, np.int64)
    at = chunk.windows(size)
    if len(one) and len(at):
        order = np.lexsort((two, one))
        one, two, wins = one[order], two[order], wins[order].astype(bool)
        found, low = _find(window_hash(chunk.one, size, 0x9E3779B97F4A7C15)[at], one)
        at = at[found]
        mine, other = chunk.hashes(size, at)
        high = np.searchsorted(one, mine, side="right")
        entry = np.full(len(at), -1)
        for k in range(int((high - low).max(initial=0))):
            more = np.flatnonzero(low + k < high)
            same = more[two[low[more] + k] == other[more]]
            entry[same] = low[same] + k
        listed = np.flatnonzero(entry >= 0)
        order = listed[np.argsort(entry[listed], kind="stable")]  # places of one window in document order
        first = np.append(True, entry[order][1:] != entry[order][:-1])[: len(order)]
        gone = at[order[~(first & wins[entry[order]])]]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + size, -1)
    return np.cumsum(cover)[:n] > 0


def _finish(size: int, with_text: bool):
    def run(key, table, flags):
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "removed", "kept_text")}
        if not table.num_rows:
            order = np.zeros(0, np.int64)
        else:
            chunk, order, *_ = _chunk(table)
            gone = removed_words(
                chunk, size, _joined(flags.column("one"), "<u8"), _joined(flags.column("two"), "<u4"),
                _joined(flags.column("wins"), "u1"),
            )
            for text, a, b in zip(chunk.texts, chunk.starts, chunk.starts[1:]):
                words, mask = text.split(), gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                kept, last = [], 0
                for start, end in zip(edge[::2], edge[1::2]):
                    kept += words[last:start]
                    last = end
                kept = b" ".join(kept + words[last:])
                out["n_words"].append(len(words))
                out["n_removed"].append(int(mask.sum()))
                out["kept_sha256"].append(sha256(kept).hexdigest())
                out["removed"].append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                out["kept_text"].append(kept.decode() if with_text else None)
        return pa.table({
            "id": table.column("id").take(pa.array(order)).cast(pa.int64()),
            "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
            "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            "removed": pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(out["kept_text"], pa.string()),
        })

    return run


def remove_repeats(
    docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
    rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, from_files: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, ``removed`` word ranges, ``kept_text``.

    A word goes if a window of ``size`` words over it starts earlier too: in a document
    with a smaller id (null ids come last, rows with equal ids in table order) or further
    up in the same document. Kept words are joined by one space. Null texts have no words;
    texts shorter than the window stay whole. Ids are whole numbers. An empty table gives
    no rows. ``kept_text`` is null unless ``with_text``.

    ``from_files`` says that ``docs`` is a plain scan of files, whose rows come in the same order when a
    task runs again. Other input is staged first: a row's number must not change after a lost executor.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    if not from_files:
        slim = stage(slim, "texts")
    volume = slim.agg(F.sum(F.octet_length("text") + 40).alias("s")).first()["s"] or 0
    chunks, buckets = -(-int(volume) // chunk_bytes) or 1, -(-int(volume) // bucket_bytes) or 1
    # The row number spreads repeated rows over the chunks and orders equal ids.
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("chunk", F.pmod(F.xxhash64("row", "id"), F.lit(chunks)))
    by_chunk = dealt.groupBy("chunk")
    names = by_chunk.applyInArrow(_emit_names(buckets, size, rounds), "bucket bigint, chunk bigint, names binary")
    shared = names.groupBy("bucket").applyInArrow(_reduce_names, "chunk bigint, names binary")
    windows = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(
        _emit_windows(buckets, size, rounds),
        "bucket bigint, chunk bigint, one binary, two binary, many binary, doc binary, id binary, null binary, row binary",
    )
    repeats = windows.groupBy("bucket").applyInArrow(_reduce_windows, "chunk bigint, one binary, two binary, wins binary")
    out = dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(
        _finish(size, with_text),
        "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
        "removed array<struct<start:bigint,end:bigint>>, kept_text string",
    )
    return out.withColumnRenamed("id", id_col)
