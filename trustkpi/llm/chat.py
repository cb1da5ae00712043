"""Chat formatting of reply trees.

A conversation is a tree of messages. Self-joins double the known way to the root round
by round: after k of them each message knows its ancestor 2**k steps up and the score on
the way, so deep threads need few rounds. Leaves are ranked by the score of their path,
and each chosen path is formatted as one conversation, with the places that count for the loss.

The template writes ``<|im_start|>role``, a line end, the text and ``<|im_end|>`` and a line
end. Inside a text every ``<``, any backslashes, ``|`` gets one more backslash before the
bar, so no control string is left and the way back is to take one away.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustkpi.llm.shared import arrow_map
from trustkpi.session import stage

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSE = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _CLOSE.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss spans in code points) of (role, text) pairs."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs back from a formatted conversation."""
    turns = []
    for part in formatted.split(END + "\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((_role_in(role), unescape(text)))
    return turns


def threads(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of plain conversations as trees: each replies to the one before it.

    Rows of a conversation stand by turn (nulls first), then role, then text.
    """
    order = Window.partitionBy("tree").orderBy(turn_col, "role", "text")
    return (
        rows.select(
            _tree(id_col), F.col(id_col).alias("id"), F.col(turn_col),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("node", F.row_number().over(order).cast("bigint"))
        .select("tree", "id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                F.lit(0.0).alias("score"))
    )


def _tree(id_col: str):
    """Key of a conversation; the null id is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).alias("tree")


def _ladder(nodes: DataFrame, count: int) -> list[DataFrame]:
    """Tables (tree, node, up, gain): the ancestor 1, 2, 4, … steps up and the score on the way to it."""
    known = nodes.select("tree", F.col("node").alias("up"))
    step = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain"))
    rungs = [stage(step.join(known.hint("merge"), ["tree", "up"], "left_semi").select("tree", "node", "up", "gain"), "rung")]
    while 1 << len(rungs) <= count:
        last = rungs[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"))
        longer = stage(
            last.join(above.hint("merge"), ["tree", "up"])
            .select("tree", "node", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), "rung",
        )
        if longer.isEmpty():
            return rungs
        rungs.append(longer)
    return rungs


def chosen_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, back): the messages of the best root-to-leaf paths, ``back`` steps from the leaf.

    ``messages`` has tree, node, parent, score. A message whose parent is missing is a
    root; messages on a circle of parents have no root and belong to no path. Paths rank
    by the sum of their scores (null: 0), then the longer, then the smaller leaf.
    """
    nodes = stage(
        messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .dropDuplicates(["tree", "node"]), "messages",
    )
    rungs = _ladder(nodes, nodes.count())
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node"))
    leaves = nodes.join(parents.hint("merge"), ["tree", "node"], "left_anti")
    at = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("score").alias("total"), F.lit(0).alias("depth"))
    for k in reversed(range(len(rungs))):
        at = (
            at.join(rungs[k].hint("merge"), ["tree", "node"], "left")
            .select("tree", "leaf", F.coalesce("up", "node").alias("node"),
                    (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"),
                    (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
        )
    if branches is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "leaf")
        at = at.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches)
    path = stage(at.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("back")), "paths")
    for k in reversed(range(len(rungs))):
        up = path.join(rungs[k].hint("merge"), ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")
        )
        path = stage(path.unionByName(up), "paths")  # read twice by the next step: without this the plan would double
    return path


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen path: id, leaf, formatted, ``loss`` spans (start, end) in code points.

    ``messages`` has tree, id, node, parent, role, text, score; see ``chosen_paths``. Of
    messages with one node number the first by role and text counts. Null roles and texts are empty.
    """
    path = chosen_paths(messages, branches)
    texts = messages.groupBy("tree", "node").agg(
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "id")).alias("m")
    )
    gathered = (
        path.join(texts.hint("merge"), ["tree", "node"]).groupBy("tree", "leaf")
        .agg(F.min("m.id").alias("id"), F.sort_array(F.collect_list(F.struct(-F.col("back"), "m.role", "m.text"))).alias("turns"))
    )

    def run(batches):
        for batch in batches:
            done = [format_turns([tuple(t.values())[1:] for t in turns]) for turns in batch.column(2).to_pylist()]
            loss = [[{"start": a, "end": b} for a, b in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in done], pa.string()),
                 pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["id", "leaf", "formatted", "loss"],
            )

    kind = gathered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
    return arrow_map(gathered.select("id", "leaf", "turns"), run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation what the text itself says: turns, their digest, the loss text."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                listed = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), sha256(listed.encode()).hexdigest(), len(loss),
                             sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
    return arrow_map(formatted.select("id", "formatted", "loss"), run, schema)
