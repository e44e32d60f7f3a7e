"""Chat formatting from reply trees, in DataFrame operations only.

Template: every turn is ``<s>`` role, line break, text ``</s>``, line break.
Control strings are ``<s> </s> <<SYS>> <</SYS>> [INST] [/INST]``.  Inside texts
and roles each of them gets one backslash after its first character, and one
that already has backslashes there gets one more, so that taking one away
restores every text and no template mark can be read inside a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.session import materialise

OPEN, CLOSE = "<s>", "</s>\n"
CONTROL = r"(/?s>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so theirs are written as %0A and % as %25."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def threads(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of a linear table: each turn replies to the one before it.
    Rows of one conversation are ordered by (turn, role, text)."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(
        F.col(conv_id).cast("long").alias("tree"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Self-joins that double the reach of every node's pointer: after round k
    it points 2^k ancestors up.  Returns (tree, node, hops, total, open) and the
    pointer table of each round.  A node still open after log2(n) + 1 rounds
    hangs on a loop."""
    now = materialise(nodes.select("tree", "node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("hops"), F.col("score").alias("total")))
    rounds = math.ceil(math.log2(max(2, now.count()))) + 1
    levels: list[DataFrame] = []
    while len(levels) <= rounds:
        going = now.where("jump is not null")
        if going.isEmpty():
            break
        levels.append(going.select("tree", "node", "jump"))
        up = now.select(F.col("tree").alias("t"), F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("hops").alias("more"), F.col("total").alias("plus"))
        far = going.join(up, (going.tree.eqNullSafe(up.t)) & (going.jump == up.jump), "left")
        moved = far.select("tree", "node", F.col("next").alias("jump"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total"))
        now = materialise(now.where("jump is null").union(moved))
    return now.select("tree", "node", "hops", "total", F.col("jump").isNotNull().alias("open")), levels


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees, one row per message of a chosen path:
    (tree, leaf, rank, position, role, text).

    ``messages``: tree, node, parent, role, text, score.  A parent that is null
    or not in the tree makes a root.  Branches of a tree are ranked by mean
    score, then length, then the smaller leaf; ``best`` None keeps all.  Of
    rows with the same (tree, node) the least (parent, role, text) counts; null
    scores count 0, null texts and roles are empty, a null node is left out;
    messages on a loop have no root and are left out; an empty table gives an
    empty result.  Other columns are not read."""
    one = F.struct("parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = materialise(messages.where("node is not null").select("tree", "node", one.alias("m")).groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"))
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = nodes.join(there, nodes.tree.eqNullSafe(there.t) & (nodes.parent == there.n), "left").select("tree", "node", F.col("n").alias("parent"), "score")
    linked = materialise(linked)
    height, levels = _climb(linked)
    inner = linked.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    ends = height.where("not open")
    leaves = ends.join(inner, ends.tree.eqNullSafe(inner.t) & (ends.node == inner.p), "left_anti")
    order = [(F.col("total") / F.col("hops")).desc(), F.col("hops").desc(), F.col("node")]
    if best is not None:
        part = Window.partitionBy("tree", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(*order)
        leaves = leaves.withColumn("r", F.row_number().over(part)).where(F.col("r") <= best).drop("r")
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    walk = materialise(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("hops") - 1).alias("position")))
    for k in reversed(range(len(levels))):
        up = levels[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "jump")
        step = walk.join(up, walk.tree.eqNullSafe(up.t) & (walk.node == up.n)).select("tree", "leaf", "rank", F.col("jump").alias("node"), (F.col("position") - 2**k).alias("position"))
        walk = materialise(walk.union(step))
    said = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return walk.join(said, walk.tree.eqNullSafe(said.t) & (walk.node == said.n)).select("tree", "leaf", "rank", "position", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: tree, leaf, rank, formatted, loss.  ``loss`` lists the
    code-point spans (start, length) of the assistant texts in ``formatted``."""
    turn = F.struct("position", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("own"))
    rows = paths.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))
    none = "cast(array() as array<struct<start:bigint,length:bigint>>)"
    lead = f"(acc.at + {len(OPEN) + 1} + length(t.role))"
    spans = F.expr(
        f"aggregate(turns, struct(0L as at, {none} as spans), (acc, t) -> struct({lead} + length(t.text) + {len(CLOSE)} as at,"
        f" if(t.own, concat(acc.spans, array(struct({lead} as start, bigint(length(t.text)) as length))), acc.spans) as spans), acc -> acc.spans)"
    )
    return rows.select("tree", "leaf", "rank", F.concat_ws("", F.transform("turns", line)).alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: F.startswith(p, F.lit(OPEN)))
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(head(p)) + 2)).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def format_chats(messages: DataFrame, best: int | None = None) -> DataFrame:
    return format_paths(branches(messages, best))
