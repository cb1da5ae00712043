"""Balanced label propagation: linked documents gather in shards of even size.

Links are given as (node, hub): nodes of one hub are linked to each other. Each round every
node looks up its hubs' members per shard and asks for the shard that holds most of its
neighbours; moves between two shards are admitted up to the room left plus what moves the
other way. Rounds go on until no node asks for another shard. At the end sizes are made exact.

Where each node has one hub, as with equal texts, the nodes of a hub in one shard are alike:
``settle`` moves such cells (hub, shard, count), at most one per hub and shard however many
documents they stand for, and the documents are dealt to the cells once at the end.
``propagate`` is for nodes with several hubs and moves the nodes themselves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.operators.running import running_total
from trustkpi.llm.shared import attach_dealt
from trustkpi.session import drop_staged, stage, staged_count

SHARDS = 16
# While cells move, a shard may be this much above its even share: with no place to spare hardly any could move.
SLACK = 0.03
_GRAIN = 1 << 20


def _quotas(wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Share of the moves from a to b that may go ahead."""
    swaps = {k: min(n, wants.get(k[::-1], 0)) for k, n in wants.items()}
    extra = [sum(n - swaps[k] for k, n in wants.items() if k[1] == b) for b in range(len(room))]
    return {
        (a, b): min(1.0, (swaps[a, b] + (max(room[b], 0) * (n - swaps[a, b]) / extra[b] if extra[b] else 0)) / n)
        for (a, b), n in wants.items()
    }


def propagate(links: DataFrame, capacity: int, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(node, label) of all linked nodes when none asks to move; links has ``node`` and ``hub``.

    With one hub per node this ends: all moves of a hub go to one shard, which holds no
    fewer of its nodes than the shard they leave, so the pairs that share a shard grow in
    number with every move. Where nodes have several hubs, give the most ``rounds`` to go.

    The figures of a round come as small tables: all rounds have the same plan and compiled code.
    """
    spark, since = links.sparkSession, staged_count()
    first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(shards)).cast("int")
    state = stage(links.select("node", "hub", first.alias("label")), "labels")
    shard = range(shards)
    turn = 0
    while rounds is None or turn < rounds:
        tally = state.groupBy("hub").agg(
            F.array(*[F.count(F.when(F.col("label") == k, 1)) for k in shard]).alias("members")
        )
        votes = (
            state.join(tally.hint("merge"), "hub").groupBy("node", "label")
            .agg(F.min("hub").alias("lead"), *[F.sum(F.col("members")[k]).alias(f"v{k}") for k in shard])
        )
        sizes = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.countDistinct("node").alias("n")).collect()}
        room = [capacity - sizes.get(k, 0) for k in shard]
        free = spark.createDataFrame(pa.table({"free": pa.array([[n > 0 for n in room]], pa.list_(pa.bool_()))}))
        # Votes, then a draw that is the same for all nodes of a hub, so that ties end in one shard.
        rated = [
            F.struct(F.col(f"v{k}").alias("v"), F.xxhash64("lead", F.lit(k)).alias("draw"), F.lit(k).alias("k"))
            for k in shard
        ]
        open_to = [F.when((F.col("label") == k) | F.col("free")[k], rated[k]) for k in shard]
        asked = stage(
            votes.crossJoin(free).select("node", "label", F.array_max(F.array(*open_to))["k"].alias("to")), "asked"
        )
        moves = asked.where("`to` <> label")
        wants = {(r["label"], r["to"]): r["n"] for r in moves.groupBy("label", "to").agg(F.count("*").alias("n")).collect()}
        if not wants:
            break
        share = sorted(_quotas(wants, room).items())
        # A limit of 0 would let a single place among very many moves stay free for ever.
        limits = spark.createDataFrame(pa.table({
            "label": pa.array([a for (a, _), _ in share], pa.int32()), "to": pa.array([b for (_, b), _ in share], pa.int32()),
            "limit": pa.array([max(1, int(part * _GRAIN)) for _, part in share], pa.int64()),
            "turn": pa.array([turn] * len(share), pa.int32()),
        }))
        goes = F.pmod(F.xxhash64("node", "turn"), F.lit(_GRAIN)) < F.coalesce("limit", F.lit(0))
        labels = asked.join(limits, ["label", "to"], "left").select(
            "node", F.when(goes, F.col("to")).otherwise(F.col("label")).alias("label")
        )
        state = stage(state.drop("label").join(labels.hint("merge"), "node"), "labels")
        drop_staged(spark, since, keep=1)  # only the last labels are read again
        turn += 1
    return state.select("node", "label").distinct()


def settle(cells: DataFrame, capacity: int, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``cells`` (hub, label, n) when no cell asks to move; the members of every hub keep their number.

    All moves of a hub go to the one shard with room that holds most of it, so the pairs
    that share a shard grow with every move and the rounds end. A cell that fits into what
    may move goes whole or not at all, a larger one in part; what goes is drawn from the
    hub and the round, and adds up to the places there are on average.
    """
    spark, since = cells.sparkSession, staged_count()
    state = stage(cells.select("hub", "label", "n"), "cells")
    shard = range(shards)
    turn = 0
    while rounds is None or turn < rounds:
        tally = state.groupBy("hub").agg(
            F.array(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in shard]).alias("members")
        )
        sizes = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        room = [capacity - sizes.get(k, 0) for k in shard]
        free = spark.createDataFrame(pa.table({"free": pa.array([[n > 0 for n in room]], pa.list_(pa.bool_()))}))
        # Members, then a draw that is the same for all cells of a hub, so that ties end in one shard.
        rated = [
            F.struct(F.col("members")[k].alias("v"), F.xxhash64("hub", F.lit(k)).alias("draw"), F.lit(k).alias("k"))
            for k in shard
        ]
        open_to = [F.when((F.col("label") == k) | F.col("free")[k], rated[k]) for k in shard]
        asked = stage(
            state.join(tally.hint("merge"), "hub").crossJoin(free)
            .select("hub", "label", "n", F.array_max(F.array(*open_to))["k"].alias("to")), "asked",
        )
        moves = asked.where("`to` <> label").groupBy("label", "to").agg(F.sum("n").alias("n"))
        wants = {(r["label"], r["to"]): r["n"] for r in moves.collect()}
        if not wants:
            break
        share = sorted(_quotas(wants, room).items())
        limits = spark.createDataFrame(pa.table({
            "label": pa.array([a for (a, _), _ in share], pa.int32()), "to": pa.array([b for (_, b), _ in share], pa.int32()),
            "part": pa.array([part for _, part in share], pa.float64()),
            "most": pa.array([wants[pair] * part for pair, part in share], pa.float64()),
            "turn": pa.array([turn] * len(share), pa.int32()),
        }))
        draw = F.xxhash64("hub", "label", "turn") / F.lit(2.0**64) + 0.5
        piece = F.when(F.col("n") <= F.col("most"), F.when(draw < F.col("part"), F.col("n")).otherwise(0)).otherwise(
            F.least("n", F.floor(F.col("n") * F.col("part") + draw))
        )
        split = asked.join(limits, ["label", "to"], "left").withColumn("goes", F.coalesce(piece, F.lit(0)).cast("bigint"))
        parts = F.array(
            F.struct("label", (F.col("n") - F.col("goes")).alias("n")), F.struct(F.col("to").alias("label"), F.col("goes").alias("n"))
        )
        state = stage(
            split.select("hub", F.inline(parts)).where("n > 0").groupBy("hub", "label").agg(F.sum("n").alias("n")), "cells"
        )
        drop_staged(spark, since, keep=1)  # only the last cells are read again
        turn += 1
    return state


def even_out(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``nodes`` (node, label or null, order) with ``shard`` and ``slot``; shard sizes differ by one at most.

    Each shard keeps its labelled nodes up to its size, in ``order``; all others fill the
    gaps in ``order``, so nodes with neighbouring ``order`` stay together.
    """
    total = nodes.count()
    size = [total // shards + (k < total % shards) for k in range(shards)]
    wanted = F.element_at(F.array(*[F.lit(s) for s in size]), F.col("label") + 1)
    labelled = running_total(
        nodes.where("label IS NOT NULL").withColumn("one", F.lit(1)), ["label"], ["order", "node"], "one", "rank"
    )
    labelled = stage(labelled.withColumn("stays", F.col("rank") < wanted), "placed")
    kept = {r["label"]: r["n"] for r in labelled.where("stays").groupBy("label").agg(F.count("*").alias("n")).collect()}
    pool = labelled.where("NOT stays").drop("rank", "stays", "one").unionByName(nodes.where("label IS NULL"))
    pool = running_total(
        pool.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), ["all"], ["order", "node"], "one", "rank"
    )
    start, shard, slot = 0, F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k in range(shards):
        gap = size[k] - kept.get(k, 0)
        here = (F.col("rank") >= start) & (F.col("rank") < start + gap)
        shard = F.when(here, k).otherwise(shard)
        slot = F.when(here, F.col("rank") - start + kept.get(k, 0)).otherwise(slot)
        start += gap
    columns = [c for c in nodes.columns if c not in ("label", "order")]
    return labelled.where("stays").select(*columns, F.col("label").alias("shard"), F.col("rank").alias("slot")).unionByName(
        pool.select(*columns, shard.alias("shard"), slot.alias("slot"))
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of ``docs`` as (id, size, text_crc32, law, shard, slot, grown_shard), under the law ``rows``.

    Rows with equal texts are linked. ``size`` is the UTF-8 length plus 1. A null text is
    empty; repeated rows and rows with null ids each get a slot of their own. With fewer
    rows than shards some shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.length(text)).alias("hub"),
        ).withColumn("node", F.xxhash64("row", "id", "hub")), "rows",
    )
    # The hashed node numbers spread neighbouring rows; the row number keeps them apart.
    rows = rows.withColumn("node", F.struct("node", "row"))
    total = rows.count()
    first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(shards)).cast("int")
    cells = stage(rows.groupBy("hub", first.alias("label")).agg(F.count("*").alias("n")), "cells")
    linked = cells.groupBy("hub").agg(F.sum("n").alias("members")).where("members > 1").select("hub")
    capacity = int(-(-total // shards) * (1 + SLACK)) if total else 1
    cells = settle(cells.join(linked.hint("merge"), "hub", "left_semi"), capacity, shards, rounds)
    # A hub has at most one cell per shard: its members, in order, fill one cell after the other.
    filled = Window.partitionBy("hub").orderBy("label")
    ends = cells.withColumn("end", F.sum("n").over(filled)).groupBy("hub").agg(
        F.array_sort(F.collect_list(F.struct("end", "label"))).alias("ends")
    )
    ranked = stage(running_total(rows.withColumn("one", F.lit(1)), ["hub"], ["node"], "one", "place"), "ranked")
    nodes = attach_dealt(ranked, ends, ["hub"], ["node"], "left").select(
        "node", "id", "size", "text_crc32", F.expr("filter(ends, e -> e.end > place)[0].label").alias("label"),
        F.col("hub").alias("order"),
    )
    return even_out(nodes, shards).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
