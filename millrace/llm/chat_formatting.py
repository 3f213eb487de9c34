"""Reply trees as training conversations.

Every path from a root to a leaf of a reply tree is one possible conversation.
Paths come from self-joins that double their reach: after k rounds a leaf knows
its ancestors up to 2**k steps away, so a thread of n replies takes log2(n)
rounds. Each jump carries the sum of the scores it passes, so branches are ranked
from one row per leaf; only the chosen ones are written out as paths, and each
is formatted as one text with the character spans that training may learn from.

A turn is written as

    ### role:
    text
    </turn>

with a backslash in front of every backslash, ``#`` and ``</turn>`` of the text,
so that no text can look like a mark and every text can be read back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.shared import stored

# Fixed values of the template.
HEAD, HEAD_END, TURN_END = "### ", ":\n", "\n</turn>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "\\</turn>")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Inverse of both escapes: two backslashes are one, and only between them can others mark something."""

    def part(x: Column) -> Column:
        for marked, plain in (("\\#", "#"), ("\\<", "<"), ("\\n", "\n")):
            x = F.replace(x, F.lit(marked), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of plain conversations as reply trees of one branch: each turn answers the one before.

    Equal turn numbers are ordered by role and text, null first, and all kept.
    """
    rows = turns.select(F.col(tree).alias("tree"), F.col(order).alias("_order"), F.col(role).alias("role"), F.col(text).alias("text"))
    number = F.row_number().over(Window.partitionBy("tree").orderBy("_order", "role", "text"))
    numbered = rows.withColumn("node", number.cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _with_ancestor(left: DataFrame, jumps: DataFrame, how: str = "inner") -> DataFrame:
    """Join the rows whose ``ancestor`` has a jump, with where it leads and the scores it passes; a null tree is a tree."""
    to = jumps.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("ancestor").alias("further"), F.col("sum").alias("more"))
    return left.join(to, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("ancestor") == F.col("_node")), how).drop("_tree", "_node")


@dataclass
class Tree:
    """``nodes`` (tree, node, ancestor, score), the ``leaves`` whose replies reach a root, and jumps of 1, 2, 4, ... replies."""

    nodes: DataFrame
    leaves: DataFrame
    jumps: list[DataFrame]


def trees(messages: DataFrame) -> Tree:
    """Jumps hold ``tree``, ``node``, ``ancestor`` and ``sum``: the scores from the node up to, but without, the ancestor.

    A message whose parent is missing is a root; rows without a node are left
    out; of a repeated node one row counts. Replies that go in a circle reach no
    root and belong to no path. There are as many rows as messages, times the
    logarithm of the deepest tree.
    """
    if "score" not in messages.columns:
        messages = messages.withColumn("score", F.lit(0.0))
    once = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("ancestor"), F.min(F.struct(*_content(messages))).alias("m"))
    nodes = stored(once.select("tree", "node", "ancestor", F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score")))
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds = math.ceil(math.log2(most)) + 1 if most > 1 else 0
    # Parents that are there, and who is a parent.
    known = nodes.select("tree", F.col("node").alias("ancestor"))
    linked = nodes.alias("n").join(known.alias("p"), F.col("n.tree").eqNullSafe(F.col("p.tree")) & (F.col("n.ancestor") == F.col("p.ancestor")), "left_semi")
    jump = stored(linked.select("tree", "node", "ancestor", F.col("score").alias("sum")))
    answered = jump.select(F.col("tree").alias("_tree"), F.col("ancestor").alias("_node")).distinct()
    leaves = nodes.join(answered, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")), "left_anti")
    jumps = [jump]
    for _ in range(rounds):
        longer = _with_ancestor(jumps[-1], jumps[-1])
        jumps.append(stored(longer.select("tree", "node", F.col("further").alias("ancestor"), (F.col("sum") + F.col("more")).alias("sum"))))
    circular = jumps[-1].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    ends = leaves.join(circular, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")), "left_anti")
    return Tree(nodes, ends.select("tree", F.col("node").alias("leaf")), jumps[:-1] if rounds else [])


def _content(messages: DataFrame) -> list[str]:
    return [c for c in ("parent", "role", "text", "score") if c in messages.columns]


def totals(tree: Tree) -> DataFrame:
    """``tree``, ``leaf``, ``score`` and ``length`` of every path: the longest jumps first, one row per leaf all along."""
    at = tree.leaves.select("tree", "leaf", F.col("leaf").alias("ancestor"), F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("length"))
    for k in reversed(range(len(tree.jumps))):
        moved = _with_ancestor(at, tree.jumps[k], "left")
        at = moved.select(
            "tree",
            "leaf",
            F.coalesce("further", "ancestor").alias("ancestor"),
            (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
            (F.col("length") + F.when(F.col("further").isNull(), 0).otherwise(1 << k)).alias("length"),
        )
        at = stored(at)
    # What is left is the root's own score.
    roots = tree.nodes.select("tree", "node", F.col("node").alias("ancestor"), F.col("score").alias("sum"))
    return _with_ancestor(at, roots).select("tree", "leaf", (F.col("score") + F.col("more")).alias("score"), "length")


def paths(tree: Tree, leaves: DataFrame) -> DataFrame:
    """``tree``, ``leaf``, ``node``, ``distance`` (replies from the leaf) of the paths to the given ``leaves``."""
    steps = leaves.select("tree", "leaf", F.col("leaf").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    for k, jump in enumerate(tree.jumps):
        further = _with_ancestor(steps, jump).select("tree", "leaf", F.col("further").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
        steps = stored(steps.unionAll(further))
    return steps.withColumnRenamed("ancestor", "node")


def branches(messages: DataFrame) -> DataFrame:
    """``tree``, ``leaf``, ``node``, ``distance`` of every root-to-leaf path; see ``trees`` for what counts as one."""
    tree = trees(messages)
    return paths(tree, tree.leaves)


def format_branches(messages: DataFrame, best: int = 1, learned: str = LEARNED_ROLE) -> DataFrame:
    """The ``best`` branches of each tree, each as one conversation.

    ``messages`` has ``tree``, ``node``, ``parent``, ``role``, ``text`` and
    ``score``. Branches rank by the sum of their scores (null: 0), then by
    length, then by the smaller leaf. Returns ``tree``, ``leaf``, ``rank``,
    ``score``, ``formatted`` and ``loss_spans``: 0-based start and end, in code
    points, of every text of role ``learned``. Null roles and texts are empty.
    """
    once = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    content = once.select(
        F.col("tree").alias("_tree"),
        F.col("node").alias("_node"),
        F.coalesce("m.role", F.lit("")).alias("role"),
        F.coalesce("m.text", F.lit("")).alias("text"),
    )
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node"))
    tree = trees(messages)
    scored = totals(tree)
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    # Written once: the paths of the chosen leaves, and no others, follow from it.
    chosen = stored(chosen.select("tree", "leaf", "rank", "score"))
    steps = paths(tree, chosen)
    chosen = chosen.select(F.col("tree").alias("c_tree"), F.col("leaf").alias("c_leaf"), "rank", F.col("score").alias("branch_score"))
    of_chosen = F.col("tree").eqNullSafe(F.col("c_tree")) & (F.col("leaf") == F.col("c_leaf"))
    rows = steps.join(chosen, of_chosen).drop("c_tree", "c_leaf").join(content, same).drop("_tree", "_node")
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(HEAD_END))
    body = escape(F.col("text"))
    pieces = rows.select(
        "tree",
        "leaf",
        "rank",
        "branch_score",
        (-F.col("distance")).alias("at"),
        F.concat(head, body, F.lit(TURN_END)).alias("piece"),
        F.length(head).cast("long").alias("head"),
        F.length(body).cast("long").alias("body"),
        (F.col("role") == learned).alias("learned"),
    )
    size = F.length("piece").cast("long")
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col("head"))
    turns = F.sort_array(F.collect_list(F.struct("at", "piece", "start", (F.col("start") + F.col("body")).alias("end"), "learned")))
    whole = placed.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("branch_score").alias("score"), turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return whole.select("tree", "leaf", "rank", "score", F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, in order."""
    pieces = F.split(formatted, TURN_END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        end = F.instr(piece, HEAD_END)
        role = F.substring(piece, F.lit(len(HEAD) + 1), end - len(HEAD) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, end + len(HEAD_END), F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
