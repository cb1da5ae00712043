"""Prefix trie of conversations, by digests of blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns. The digest of all blocks before a block
(its prefix) comes from digests of 2, 4, 8, … blocks: an up-sweep joins neighbours, a down-sweep
hands each block the digest of what stands before it, so a long conversation is never walked in one
task. Conversations with one prefix and one block form a class. Where all conversations of a
prefix go on with the same block, its turns are nodes as they are; only where siblings diverge
are the classes, not the conversations, opened turn by turn and grouped again.

A node is known by its smallest member and its depth. That member owns a path from the node where
it leaves smaller ones down to its end. Sums over a subtree are sums over the members' paths:

    sum of n * bytes over the subtree = sum over members of the bytes from this depth on
    sum of bytes over the subtree     = bytes of the owner's path from this depth on
                                        + all bytes that the other members own
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustkpi.llm.shared import arrow_map, attach_dealt
from trustkpi.operators.running import running_total
from trustkpi.session import stage

BLOCK = 4
# Rebuilding: conversation c starts with the first h turns of c - c % FAMILY, h = crc32(c) % HEADS.
FAMILY, HEADS = 5, 9
NODE = ["k", "prefix", "path"]
_NO_ENDS = sha256(b"").hexdigest()


def slim_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, at, digest, bytes): the turns in order, numbered from 0, without their texts.

    Nulls first; equal turns stand by the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("one"),
    )
    return running_total(slim, ["conv"], ["turn", "digest"], "one", "at").select("conv", "at", "digest", "bytes")


def _heads(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % HEADS


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the first turns of the family's first conversation, then one's own.

    Turns are (conv, at, digest, bytes), conversations (conv, length), those without turns too.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), _heads(F.col("conv")).alias("h"))
    convs = stage(
        known.join(base.hint("merge"), "base", "left")
        .withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv", "base", "h", "lead", "n"), "convs",
    )
    kept = turns.where(F.col("at") >= _heads(F.col("conv")))
    own = attach_dealt(kept, convs.select("conv", "h", "lead"), ["conv"], ["at"]).select(
        "conv", (F.col("lead") + F.col("at") - F.col("h")).alias("at"), "digest", "bytes"
    )
    starts = turns.where(F.col("at") < HEADS).withColumnRenamed("conv", "base")
    taken = starts.join(convs.select("conv", "base", "h").hint("merge"), "base").where("at < h")
    length = F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(taken.select("conv", "at", "digest", "bytes")), convs.select("conv", length.alias("length"))


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def cut(turns: DataFrame, block: int) -> DataFrame:
    """(conv, k, turns, digest, size, bytes): blocks of ``block`` turns, the last one may be shorter."""
    listed = F.sort_array(F.collect_list(F.struct("at", "digest", "bytes")))
    return (
        turns.groupBy("conv", F.floor(F.col("at") / block).alias("k")).agg(listed.alias("turns"))
        .select("conv", "k", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))
        .withColumns({"digest": _digest(F.col("turns.digest")), "size": F.size("turns"),
                      "bytes": F.aggregate("turns.bytes", F.lit(0).cast("bigint"), lambda a, b: a + b)})
    )


def prefixes(full: DataFrame, counts: DataFrame) -> DataFrame:
    """(conv, k, prefix): the digest of the first k blocks, for k from 0 to the number of full blocks.

    ``full`` has (conv, k, digest) of the full blocks, ``counts`` (conv, blocks) of all conversations.
    """
    levels = [full]
    while True:
        side = F.col("k") % 2
        above = stage(
            levels[-1].groupBy("conv", F.floor(F.col("k") / 2).alias("k"))
            .agg(F.max(F.when(side == 0, F.col("digest"))).alias("left"), F.max(F.when(side == 1, F.col("digest"))).alias("right"))
            .where("left IS NOT NULL AND right IS NOT NULL")
            .select("conv", "k", _digest(F.array("left", "right")).alias("digest")), "digests",
        )
        if above.isEmpty():
            break
        levels.append(above)
    found = counts.select("conv", "blocks", F.lit(0).cast("bigint").alias("k"), F.lit("").alias("prefix"))
    for step in reversed(range(len(levels))):
        before = levels[step].select("conv", (F.col("k") + 1).alias("k"), "digest").where("k % 2 = 1")
        both = F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1))
        found = (
            found.select("conv", "blocks", both.alias("k"), "prefix").where(F.col("k") * (1 << step) <= F.col("blocks"))
            .join(before.hint("merge"), ["conv", "k"], "left")
            .select("conv", "blocks", "k",
                    F.when(F.col("digest").isNotNull(), _digest(F.array("prefix", "digest"))).otherwise(F.col("prefix")).alias("prefix"))
        )
    return found.select("conv", "k", "prefix")


def _opened(classes: DataFrame) -> DataFrame:
    """One row per turn of each class: i from 1, path (digest of the block's first i turns), up (of i - 1), bytes, tail."""
    first = lambda n: F.slice(F.col("turns"), F.lit(1), n)
    spread = classes.select("*", F.posexplode("turns").alias("p", "turn"))
    rest = F.slice(F.col("turns"), F.col("p") + 1, F.size("turns"))
    return spread.select(
        *[c for c in classes.columns if c != "turns"], (F.col("p") + 1).alias("i"),
        _digest(F.transform(first(F.col("p") + 1), lambda t: t["digest"])).alias("path"),
        _digest(F.transform(first(F.col("p")), lambda t: t["digest"])).alias("up"),
        F.col("turn.bytes").alias("bytes"),
        F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, t: a + t["bytes"]).alias("tail"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """(lead, depth, ends_sha256) of (lead, depth, conv): each node's rows pass in order, none are held."""

    def run(batches):
        at, state, out = None, None, []

        def send():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                ["lead", "depth", "ends_sha256"],
            )

        for batch in batches:
            for lead, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (lead, depth) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (lead, depth), sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if len(out) >= 10_000:
                yield send()
                out = []
        if at is not None:
            out.append((*at, state.hexdigest()))
        if out:
            yield send()

    node = ["lead", "depth"]
    rows = ends.select(*node, "conv").repartition(*node).sortWithinPartitions(*node, "conv")
    return arrow_map(rows, run, "lead bigint, depth bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct sequence of first turns of the conversations ``convs`` (conv, length).

    ``turns`` has (conv, at, digest, bytes), at from 0 without gaps. Returns conv_id (smallest
    member), depth, parent_conv_id (of the root: null), n_convs, n_children, n_leaves, saved_tokens
    (over the subtree: (members - 1) * bytes of the node's turn), ends_sha256 (of the ids that end
    here). A conversation without turns is a member of the root alone; no conversations, no rows.
    """
    blocks = stage(cut(turns, block), "blocks")
    counts = convs.select("conv", F.floor(F.col("length") / block).alias("blocks"))
    before = stage(prefixes(blocks.where(F.col("size") == block).select("conv", "k", "digest"), counts), "prefixes")
    after = before.where("k > 0").select("conv", (F.col("k") - 1).alias("k"), F.col("prefix").alias("after"))
    # Bytes of a conversation after each of its blocks: a running total from its end.
    later = running_total(blocks.select("conv", (-F.col("k")).alias("back"), "bytes"), ["conv"], ["back"], "bytes", "rest")
    placed = stage(
        blocks.drop("bytes").join(before.hint("merge"), ["conv", "k"])
        .join(after.hint("merge"), ["conv", "k"], "left")
        .join(later.select("conv", (-F.col("back")).alias("k"), "rest").hint("merge"), ["conv", "k"]), "placed",
    )
    sort = ["k", "prefix", "digest"]
    classes = stage(
        placed.groupBy(*sort).agg(
            F.count("*").alias("n"), F.min("conv").alias("lead"), F.first("after").alias("after"), F.first("turns").alias("turns")
        ), "classes",
    )
    # A prefix that all leave by one block: the least digest is also the greatest.
    lone = stage(
        classes.groupBy("k", "prefix").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
        .where("digest = other").drop("other"), "lone",
    )

    def nodes_of(rows: DataFrame, grouped) -> DataFrame:
        """Rows per class to rows per node: blocks without siblings as they are, the others grouped by turn."""
        alone = _opened(rows.join(lone.hint("merge"), sort, "left_semi"))
        apart = _opened(rows.join(lone.hint("merge"), sort, "left_anti"))
        return grouped(alone, False).unionByName(grouped(apart, True))

    def counted(rows: DataFrame, several: bool) -> DataFrame:
        if not several:
            return rows.select(*NODE, "i", "up", "bytes", "n", "lead")
        return rows.groupBy(*NODE, "i", "up", "bytes").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"))

    depth = (F.col("k") * block + F.col("i")).cast("bigint")
    bare = stage(nodes_of(classes.drop("after"), counted).withColumn("depth", depth), "nodes")
    top = stage(convs.agg(F.min("conv").alias("lead"), F.count("*").alias("n")).where("n > 0"), "root")

    # The node above: the turn before in the block, or the last turn of the block before, or the root.
    inside = attach_dealt(
        bare.where("i > 1"), bare.select("k", "prefix", F.col("path").alias("up"), F.col("lead").alias("parent")),
        ["k", "prefix", "up"], ["path"],
    )
    ended = classes.where("after IS NOT NULL").select((F.col("k") + 1).alias("k"), F.col("after").alias("prefix"), F.col("lead").alias("parent"))
    first = attach_dealt(bare.where("i = 1 AND k > 0"), ended, ["k", "prefix"], ["path"])
    under_root = bare.where("i = 1 AND k = 0").crossJoin(F.broadcast(top.select(F.col("lead").alias("parent"))))  # one row
    slim = ["lead", "depth", "parent", "n", "bytes"]
    linked = inside.select(*slim).unionByName(first.select(*slim)).unionByName(under_root.select(*slim))
    linked = stage(linked, "linked")
    children = linked.groupBy(F.col("parent").alias("lead"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    nodes = stage(
        linked.join(children.hint("merge"), ["lead", "depth"], "left")
        .withColumn("children", F.coalesce("children", F.lit(0).cast("bigint"))), "counted",
    )
    owned = nodes.groupBy(F.col("lead").alias("conv")).agg(
        F.sum("bytes").alias("owned"), F.sum((F.col("children") == 0).cast("bigint")).alias("leaves")
    )
    none = F.lit(0).cast("bigint")
    weighed = attach_dealt(placed.select("conv", *sort, "rest"), owned, ["conv"], ["k"], "left").select(
        *sort, "conv", "rest", F.coalesce("owned", none).alias("owned"), F.coalesce("leaves", none).alias("leaves")
    )
    sums = weighed.groupBy(*sort).agg(
        F.count("*").alias("n"), F.sum("rest").alias("rest"), F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"),
        F.min(F.struct("conv", "rest", "owned")).alias("owner"),
    )
    sums = stage(sums.join(classes.select(*sort, "turns").hint("merge"), sort), "class-sums")

    def summed(rows: DataFrame, several: bool) -> DataFrame:
        each = rows.select(
            *NODE, "i", (F.col("rest") + F.col("n") * F.col("tail")).alias("paths"), "owned", "leaves",
            F.struct("owner.conv", (F.col("owner.rest") + F.col("tail")).alias("path"), "owner.owned").alias("owner"),
        )
        if not several:
            return each
        return each.groupBy(*NODE, "i").agg(
            F.sum("paths").alias("paths"), F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"), F.min("owner").alias("owner")
        )

    subtree = nodes_of(sums, summed).select(
        F.col("owner.conv").alias("lead"), depth.alias("depth"), F.col("leaves").alias("n_leaves"),
        (F.col("paths") - F.col("owner.path") - (F.col("owned") - F.col("owner.owned"))).alias("saved_tokens"),
    )
    last = convs.where("length > 0").select("conv", F.floor((F.col("length") - 1) / block).alias("k"))
    closing = stage(
        placed.select("conv", "k", "prefix", F.col("digest").alias("path")).join(last.hint("merge"), ["conv", "k"], "left_semi"), "ends"
    )
    ends = attach_dealt(closing, bare.select(*NODE, "lead", "depth"), NODE, ["conv"]).select("lead", "depth", "conv")
    turnless = convs.where("length = 0").crossJoin(F.broadcast(top.select("lead"))).select("lead", none.alias("depth"), "conv")
    digests = stage(_end_digests(ends.unionByName(turnless)), "end-digests")

    whole = nodes.agg(
        F.coalesce(F.sum((F.col("n") - 1) * F.col("bytes")), none).alias("saved_tokens"),
        F.greatest(F.coalesce(F.sum((F.col("children") == 0).cast("bigint")), none), F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce(F.sum((F.col("depth") == 1).cast("bigint")), none).alias("children"),
    )
    root = top.crossJoin(whole).select(
        "lead", none.alias("depth"), F.lit(None).cast("bigint").alias("parent"), "n", "children", "n_leaves", "saved_tokens"
    )
    below = nodes.drop("bytes").join(subtree.hint("merge"), ["lead", "depth"])
    return (
        below.unionByName(root).join(digests.hint("merge"), ["lead", "depth"], "left")
        .select(
            F.col("lead").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )


def rebuilt_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text).

    Null roles and texts are empty, null turns come first, equal turns stand by the digest of role
    and text, repeated rows are turns of their own. Rows without a conversation id belong to no
    conversation. Other columns are not read. An empty table has no nodes.
    """
    turns, convs = rebuild(slim_turns(rows, conv_col, turn_col))
    return trie(turns, stage(convs, "lengths"), block)


# The same rows for DuckDB, from the definition: every conversation's every prefix.
SQL = """
WITH own AS (
  SELECT conv_id AS c, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
  FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
  )
),
convs AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(
      range(0, 8 * length(CAST(c AS VARCHAR)))::UBIGINT[],
      lambda a, i: xor(
        xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END::UBIGINT) >> 1,
        (xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END::UBIGINT) & 1)
          * 3988292384::UBIGINT),
      4294967295::UBIGINT), 4294967295::UBIGINT) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c)
),
turns AS (
  SELECT v.c, o.pos, 0 AS part, o.digest, o.bytes FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
  UNION ALL
  SELECT v.c, o.pos, 1 AS part, o.digest, o.bytes FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h
),
placed AS (SELECT c, digest, bytes, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM turns),
paths AS (
  SELECT c, depth, bytes, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth)) AS path FROM placed
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
),
lengths AS (SELECT c, max(depth) AS len FROM paths GROUP BY c),
nodes AS (
  SELECT depth, path, min(c) AS lead, count(*) AS n, min(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = len), '')) AS ends_sha256
  FROM paths JOIN lengths USING (c) GROUP BY depth, path
),
linked AS (
  SELECT v.*, u.lead AS parent
  FROM nodes v
  LEFT JOIN paths p ON p.c = v.lead AND p.depth = v.depth - 1
  LEFT JOIN nodes u ON u.depth = p.depth AND u.path = p.path
),
counted AS (
  SELECT l.*, (SELECT count(*) FROM linked x WHERE x.depth = l.depth + 1 AND x.parent = l.lead) AS children FROM linked l
),
below AS (
  SELECT p.depth, p.path, sum((v.n - 1) * v.bytes) AS saved, count(*) FILTER (WHERE v.children = 0) AS leaves
  FROM counted v JOIN paths p ON p.c = v.lead AND p.depth <= v.depth
  GROUP BY p.depth, p.path
)
SELECT lead AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n AS BIGINT) AS n_convs,
       CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN below USING (depth, path)
"""
