"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation.

Paths are enumerated by self-joins that double their reach: a node's jump goes to its parent, then to the parent's
parent, and so on, while scores and depths add up; the jumps of each round lead back from a chosen leaf to all nodes
of its path. Rounds grow with the logarithm of the deepest path. Only ids and scores take part; texts are joined at
the end. Branches are ranked by their mean score.

The template is <|role|>text<|end|> for each turn. Inside roles and texts, &, < and [ are written &amp;, &lt; and
&#91;, so that no text can hold a mark of this or another common template; inside roles > and | are written &gt; and
&#124; as well, so that a role ends at its own mark. unescape() gives both back.

Defined results: null roles and texts count as empty; a parent that isn't there or is null makes a root; nodes on a
cycle have no root and are left out; of rows that repeat a node, the smallest (parent, score) counts; ties between
branches go to the deeper one, then to the smallest leaf; rows with a null tree or node are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.llm.common import cut

END = "<|end|>"


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit(">"), F.lit("&gt;")), F.lit("|"), F.lit("&#124;"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("&#124;"), F.lit("|")), F.lit("&gt;"), F.lit(">"))
    c = F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def best_paths(nodes: DataFrame, branches: int = 1, most_rounds: int = 40) -> DataFrame:
    """(tree, rank, depth, node) for the nodes of the best branches of each tree; nodes: (tree, node, parent, score)."""
    one = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("s"))
    n = one.select("tree", "node", F.col("s.parent").alias("jump"), F.coalesce("s.score", F.lit(0.0)).cast("double").alias("total"))
    there = n.select("tree", F.col("node").alias("jump"), F.lit(1).alias("there"))
    n = n.join(there, ["tree", "jump"], "left").select(
        "tree", "node", F.when(F.col("there") == 1, F.col("jump")).alias("jump"), "total", F.lit(1).cast("long").alias("depth")
    )
    state, up = cut(n, "paths"), []
    for _ in range(most_rounds):
        going = state.where("jump is not null")
        if (left := going.count()) == 0 or up and left == before:
            break  # what still jumps after a round without an arrival goes round in a cycle
        up.append(going.select("tree", "node", "jump", F.col("depth").alias("by")))
        to = state.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        met = going.join(to, ["tree", "jump"]).select(
            "tree", "node", F.col("next").alias("jump"), (F.col("total") + F.col("t2")).alias("total"),
            (F.col("depth") + F.col("d2")).alias("depth")
        )
        # nodes that have arrived wait; only those under way are joined again
        before, state = left, cut(state.where("jump is null").select(met.columns).unionByName(met), "paths")
    done = state.where("jump is null")
    inner = n.where("jump is not null").select("tree", F.col("jump").alias("node")).distinct()
    leaves = done.join(inner, ["tree", "node"], "left_anti")
    if branches == 1:
        first = F.min(F.struct((-F.col("total") / F.col("depth")).alias("score"), (-F.col("depth")).alias("depth"), "node"))
        leaves = leaves.groupBy("tree").agg(first.alias("l")).select(
            "tree", F.lit(1).alias("rank"), F.col("l.node").alias("node"), (-F.col("l.depth")).alias("depth")
        )
    else:
        w = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
        leaves = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches).select("tree", "rank", "node", "depth")
    path = leaves
    for step in reversed(up):
        path = path.union(path.join(step, ["tree", "node"]).select("tree", "rank", F.col("jump").alias("node"), (F.col("depth") - F.col("by")).alias("depth")))
        path = cut(path, "walked")
    return path.select("tree", "rank", "depth", "node")


def formatted(paths: DataFrame, turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, rank, formatted, loss): one text for each path and the spans (start, length) that the loss counts.

    paths: (tree, rank, depth, node); turns: (tree, node, role, text). Spans are in code points, from 0.
    """
    first = turns.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("s")).select("tree", "node", "s.*")
    rows = paths.join(first, ["tree", "node"]).select("tree", "rank", "depth", "role", "text")
    head, body = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>")), escape(F.col("text"))
    rows = rows.select("tree", "rank", "depth", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("counts"))
    # where each turn's text starts, from running lengths
    before = Window.partitionBy("tree", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.char_length("head") + F.char_length("body") + F.lit(len(END))
    start = (F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.char_length("head")).cast("int")
    turn = F.struct(
        "depth", F.concat("head", "body", F.lit(END)).alias("piece"), "counts",
        F.struct(start.alias("start"), F.char_length("body").alias("length")).alias("span")
    )
    said = rows.select("tree", "rank", turn.alias("turn")).groupBy("tree", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["counts"]), lambda t: t["span"])
    return said.select("tree", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss"))


def parsed(formatted_col: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted_col, r"<\|end\|>"), lambda p: p != "")
    split = lambda p: F.instr(p, "|>")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(3), split(p) - 3)).alias("role"),
            unescape(F.substring(p, split(p) + 2, F.char_length(p))).alias("text")
        )
    )


def under_loss(formatted_col: Column, loss_col: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(loss_col, lambda s: unescape(F.substring(formatted_col, s["start"] + 1, s["length"]))), "")
