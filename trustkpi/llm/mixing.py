"""Mixing sources to target weights over a domain-language-source tree.

The token budget flows down the tree by weight. No node gets more than its subtree can
give (its tokens times the allowed epochs); what it cannot use goes to its siblings, and
only what all siblings cannot use ever stays with the parent's siblings. Each leaf then
takes whole seeded epochs of its documents and a prefix of one more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.llm.shared import packed, unpacked, without
from trustkpi.operators.keyed import attach
from trustkpi.operators.running import running_total
from trustkpi.session import stage

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
# A leaf table of at most this many rows is broadcast; a larger one is joined by its keys.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Targets:
    """Whole-number weights among siblings by name; unnamed ones get ``other``.

    ``tokens`` is the budget (None: as many as the corpus has), ``epochs`` the most often
    a document may be used, ``seed`` decides the order of every epoch.
    """

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    tokens: int | None = None
    epochs: int = 2
    seed: int = 17

    def weight(self, level: str) -> Column:
        value = F.lit(self.other)
        for name, w in getattr(self, level).items():
            value = F.when(F.col(level) == name, w).otherwise(value)
        return value.cast("decimal(20,0)")


def share_out(nodes: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """``nodes`` with ``got``: the parent's ``budget`` by ``weight``, at most ``cap`` each.

    A node is full if the budget still reaches it at the rate it fills up. All sums are
    whole numbers, so the result is exact; fractions of a token are not handed out.
    """
    # Nodes in the order in which they fill up; a node without weight never does.
    order = [F.col("fill").asc_nulls_last(), *[F.col(c) for c in nodes.columns if c in LEVELS]]
    by = Window.partitionBy(*parent).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    return (
        nodes.withColumn("fill", F.expr("CASE WHEN weight > 0 THEN CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) END"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_on", F.sum("weight").over(onward))
        .withColumn("full", F.expr(f"weight > 0 AND cap_before * weight + cap * weight_on <= {budget} * weight"))
        .withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
        .withColumn(
            "got",
            F.expr(
                f"CASE WHEN full THEN cap WHEN open_weight = 0 THEN 0 "
                f"ELSE CAST(({budget} - full_cap) * weight DIV open_weight AS DECIMAL(20,0)) END"
            ).cast("decimal(20,0)"),
        )
        .drop("fill", "cap_before", "weight_on", "full", "full_cap", "open_weight")
    )


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaf token counts."""
    caps = leaves.withColumn("leaf_cap", (F.col("tokens") * targets.epochs).cast("decimal(20,0)"))
    given = F.lit(targets.tokens) if targets.tokens is not None else F.sum("tokens")
    root = stage(attach(caps, leaves.agg(given.cast("decimal(20,0)").alias("root")), []), "leaves")
    granted = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        # A leaf below a node without weight gets nothing, so it adds nothing to what the nodes above can take.
        reached = F.lit(True)
        for lower in LEVELS[depth + 1 :]:
            reached = reached & (targets.weight(lower) > 0)
        cap = F.sum(F.when(reached, F.col("leaf_cap")).otherwise(0)).cast("decimal(20,0)")
        nodes = root.groupBy(*path).agg(cap.alias("cap"), F.max("root").alias("root"))
        nodes = nodes.withColumn("weight", targets.weight(level))
        if granted is None:
            granted = share_out(nodes, [], "root")
        else:
            above = granted.select(*path[:-1], F.col("got").alias("parent_got"))
            granted = share_out(nodes.join(above.hint("merge"), path[:-1]), path[:-1], "parent_got")
    return granted.join(root.select(*LEVELS, "tokens"), list(LEVELS)).select(
        *LEVELS, "tokens", F.col("got").cast("bigint").alias("budget")
    )


def epoch_order(seed: int, epoch: Column, id_col: str) -> Column:
    """Place of a document in an epoch: a digest of seed, epoch and id; '' for a null id."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(docs: DataFrame, targets: Targets, domain: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chosen rows of ``docs``, once per epoch, with ``domain``, ``n_tokens``, ``epoch`` and ``leaf_budget``.

    Tokens are words between ASCII white space; a null text has none. Null names are the
    name ''. In an epoch documents stand in the order of a seeded digest; documents with
    equal ids in one leaf share a place and are taken together. The last, partial epoch
    of a leaf ends before the first place that would exceed the budget. Leaves without
    tokens give no rows. A column that has the name of a new one is replaced.
    """
    old = without(docs, "domain", "n_tokens", "epoch", "leaf_budget").columns
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    # The caller's columns travel in one struct, so that none can have the name of another one here.
    rows = docs.select(
        packed(old), F.coalesce(domain, F.lit("")).alias("domain"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS[1:]],
        F.col(id_col).alias("unit"), tokens.alias("n_tokens"),
    )
    units = stage(
        rows.groupBy(*LEVELS, "unit").agg(F.sum("n_tokens").alias("tokens")), "units",
    )
    leaves = units.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = stage(
        budgets(leaves, targets).where("tokens > 0")
        .withColumn("whole", F.expr("CAST(budget DIV tokens AS INT)"))
        .withColumn("rest", F.expr("budget % tokens")), "budgets",
    )
    few = plan.count() <= BROADCAST_LEAVES
    known = F.broadcast(plan) if few else plan.hint("merge")
    placed = units.join(known, list(LEVELS)).select(
        *LEVELS, epoch_order(targets.seed, F.col("whole"), "unit").alias("place"), units["tokens"], "rest"
    )
    ranked = running_total(placed, list(LEVELS), ["place"], "tokens", "before")
    cuts = ranked.where("before + tokens <= rest").groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    plan = stage(plan.join(cuts.hint("merge"), list(LEVELS), "left"), "cuts")
    known = F.broadcast(plan) if few else plan.hint("merge")
    joined = rows.join(known.select(*LEVELS, "whole", "cut", F.col("budget").alias("leaf_budget")), list(LEVELS))
    last = F.when(epoch_order(targets.seed, F.col("whole"), "unit") <= F.col("cut"), 1).otherwise(0)
    epochs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(targets.epochs + 1)), lambda e: e <= F.col("whole") + last), lambda e: e - 1
    )
    chosen = joined.withColumn("epoch", F.explode(epochs))
    return chosen.select(*unpacked(old), F.col("domain").alias("domain"), "n_tokens", "epoch", "leaf_budget")
