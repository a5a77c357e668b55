"""Connected components of a graph of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links(a, b): the smallest id that it reaches.

    Each round gives every node the smallest label among its own and its neighbours', then that label's label; labels
    halve their distance to the smallest one, so rounds grow with the logarithm of a chain's length. Links whose ends
    agree are dropped as they settle. Each round's tables go to the shared folder: no lineage grows, nothing reaches
    the driver but a count. Null ends and self links are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    both = links.union(links.select("b", "a"))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        one, two = labels.toDF("a", "la"), labels.toDF("b", "lb")
        open_ = cut(links.join(one, "a").join(two, "b").where("la <> lb").select("la", "lb"), "open")
        if open_.isEmpty():
            return labels
        # the labels at the ends of an open link are linked: the larger one takes the smaller, then labels are followed
        hook = cut(open_.select(F.greatest("la", "lb").alias("id"), F.least("la", "lb").alias("to")).groupBy("id").agg(F.min("to").alias("to")), "hooks")
        hook = _followed(hook)
        moved = labels.join(hook.toDF("component", "to"), "component", "left")
        labels = cut(moved.select("id", F.coalesce("to", "component").alias("component")), "labels")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _followed(hook: DataFrame, most_rounds: int = 60) -> DataFrame:
    """hook(id, to) with every to replaced by the end of its chain; to < id, so there are no cycles."""
    for _ in range(most_rounds):
        nxt = hook.toDF("to", "next")
        jumped = cut(hook.join(nxt, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
        hook = jumped.select("id", "to")
        if jumped.where("moved").isEmpty():
            return hook
    raise RuntimeError("labels did not settle")
