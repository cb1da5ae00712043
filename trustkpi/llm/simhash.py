"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 2-bit segments. Flipping one bit
moves one count by one, so the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints. The segments are dealt to ``GROUPS`` axes; two
embeddings within distance d differ on at most d axes, so they share the grid cell of
at least one choice of ``GROUPS - d`` axes. Members of one cell are compared by
Manhattan distance first, then bit by bit.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trustkpi.llm.components import components
from trustkpi.llm.shared import arrow_map, text_map
from trustkpi.session import stage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
GROUPS = 7
# A grid cell with more members is compared block by block, in several tasks.
CELL_ROWS = 4_000_000
_EVEN = 0x5555555555555555


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit majority of the shingle hashes; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes = [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(ends, ends[width:])]
    total = np.zeros(64, np.int64)
    packed = np.array(hashes, "<u8")
    for at in range(0, len(packed), 65536):
        part = packed[at : at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", width: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (the columns ``keep``, default all) with ``fp``, the fingerprint as a signed long."""

    def run(texts):
        found = np.array([fingerprint(t, width, seed) for t in texts], np.uint64)
        return [pa.array(found.view(np.int64))]

    return text_map(docs, run, "fp bigint", text_col, keep)


def axis_masks(groups: int = GROUPS) -> list[int]:
    """Bit mask of each axis: its share of the 32 segments."""
    sizes = [32 // groups + (g < 32 % groups) for g in range(groups)]
    edges = list(accumulate(sizes, initial=0))
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _embedding(fp):
    """Counts of all segments, each written in unary in its two bits (0, 1, 3).

    Equal counts are equal bits, and the Manhattan distance is the number of differing bits.
    """
    shifted = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(shifted).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def unary(fp: np.ndarray) -> np.ndarray:
    even, one = np.uint64(_EVEN), np.uint64(1)
    return ((fp | (fp >> one)) & even) | (((fp & (fp >> one)) & even) << one)


def _near(fp, code, a, b, bits):
    """Which pairs are near: the lower bound first, the exact distance for those it leaves."""
    low = np.bitwise_count(code[a] ^ code[b]) <= bits
    a, b = a[low], b[low]
    exact = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[exact], b[exact]


def _forest(fp: np.ndarray, code: np.ndarray, bits: int):
    """Links that connect the members of one cell: one per member at most, none lost.

    Each member is compared with those no link has reached yet. In a dense cell that
    set shrinks at once, so the work stays far below all pairs.
    """
    left = np.arange(len(fp))
    out_a, out_b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            low = np.bitwise_count(code[left] ^ code[x]) <= bits
            near = low.copy()
            near[low] = np.bitwise_count(fp[left[low]] ^ fp[x]) <= bits
            if near.any():
                hit = left[near]
                left = left[~near]
                front.extend(hit.tolist())
                out_a.append(np.full(len(hit), x))
                out_b.append(hit)
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def cell_links(fp: np.ndarray, starts: np.ndarray, bits: int, small: int = 24):
    """Links within the cells of rows sorted by cell; ``starts`` marks each cell's first row."""
    code = unary(fp)
    n = len(fp)
    sizes = np.diff(np.append(starts, n))
    cell = np.repeat(np.arange(len(starts)), sizes)
    is_small = np.repeat(sizes <= small, sizes)
    pairs = []
    for lag in range(1, min(small, n)):
        a = np.flatnonzero((cell[:-lag] == cell[lag:]) & is_small[:-lag])
        if not len(a):
            break
        pairs.append(_near(fp, code, a, a + lag, bits))
    for k in np.flatnonzero(sizes > small):
        at, end = starts[k], starts[k] + sizes[k]
        a, b = _forest(fp[at:end], code[at:end], bits)
        pairs.append((a + at, b + at))
    if not pairs:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return fp[a], fp[b]


def _link_cells(bits: int):
    """Task function: rows sorted by cell arrive in batches; a cell may span several."""

    def run(batches):
        held, held_cell = [], []

        def links(fp, cells):
            first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
            a, b = cell_links(fp, first, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            other = np.flatnonzero((cells != cells[-1]).any(axis=1))
            last = other[-1] + 1 if len(other) else 0  # where the batch's last cell starts
            if held and (last or (held_cell[0][0] != cells[0]).any()) or last:
                yield links(np.concatenate([*held, fp[:last]]), np.concatenate([*held_cell, cells[:last]]))
                held, held_cell = [], []
            held.append(fp[last:])
            held_cell.append(cells[last:])
        if held:
            yield links(np.concatenate(held), np.concatenate(held_cell))

    return run


def near_links(prints: DataFrame, bits: int = MAX_BITS, groups: int = GROUPS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``bits`` of each other.

    Not every near pair is listed, but any two near fingerprints are joined by a path
    of listed near pairs.
    """
    if not 0 <= bits < groups:
        raise ValueError("groups must exceed bits")
    masks = [_signed(sum(m)) for m in combinations(axis_masks(groups), groups - bits)]
    cells = F.array(*[F.struct(F.lit(i).alias("axes"), (F.col("e").bitwiseAND(F.lit(m))).alias("cell"))
                      for i, m in enumerate(masks)])
    keyed = prints.select("fp", _embedding(F.col("fp")).alias("e")).select("fp", F.inline(cells))
    if prints.count() <= cell_rows:  # no cell can have more members than there are fingerprints
        keyed = keyed.withColumn("block", F.lit(0))
    else:
        heavy = stage(
            keyed.groupBy("axes", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
            .where("parts > 1"), "heavy-cells",
        )
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pair = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda j: F.greatest(own, j) * F.col("parts") + F.least(own, j),
        )
        keyed = (
            keyed.join(heavy.hint("merge"), ["axes", "cell"], "left").fillna(1, ["parts"])
            .select("axes", "cell", "fp", F.explode(pair).alias("block"))
        )
    dealt = keyed.select("axes", "cell", "block", "fp").repartition("axes", "cell", "block")
    ordered = dealt.sortWithinPartitions("axes", "cell", "block")
    return arrow_map(ordered, _link_cells(bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    width: int = SHINGLE, bits: int = MAX_BITS, seed: int = SEED, groups: int = GROUPS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``carry``, ``fp``, ``root``, ``component_id``.

    ``root`` names the component by its least fingerprint, ``component_id`` is the least id
    reachable by links. Rows with equal fingerprints are linked, so repeated rows and all
    texts without words (fingerprint 0) fall together. A null text has no words; a null
    id names a component only if no other id is in it. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carry)
    prints = stage(with_fingerprint(slim, "text", width, seed, ["id", *carry]), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    links = stage(near_links(nodes.select("fp"), bits, groups), "near")
    joined = components(links, "a", "b")
    named = stage(
        nodes.join(joined.hint("merge"), nodes["fp"] == joined["node"], "left")
        .select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "named",
    )
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per_print = named.select("fp", "root").join(least.hint("merge"), "root")
    return prints.join(per_print.hint("merge"), "fp").select(
        F.col("id").alias(id_col), *carry, "fp", "root", "component_id"
    )


def hex_print(fp):
    """16 lowercase hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
