"""Connected components over a table of links, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_unsized as cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of a link; comp is the smallest node of its component.

    Local contraction: every node points to one of itself and its neighbours, the one whose id has the smallest hash, and
    is merged into it; links inside a merged node and double links go, the others are the next round's. Only nodes
    that others point to are left, a constant share less each round whatever the links and ids, so all rounds together
    cost little more than the first, and their number grows with the logarithm of the nodes. A link is one row, and its
    ends are renamed one at a time with double rows dropped between, so a hub's leaves are one row before the hub's
    own rename. Each round is cut, without size estimates: a lost executor costs one round at most. Null nodes have no links."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    pair = lambda x, y: (F.greatest(x, y).alias("x"), F.least(x, y).alias("y"))
    edges = cut(links.where(f"`{a}` <> `{b}`").select(*pair(a, b)).distinct())
    loops = links.where(f"`{a}` = `{b}`").select(F.col(a).alias("node"), F.col(a).alias("comp"))
    steps = []
    while not steps or not edges.isEmpty():
        both = edges.select("x", "y").unionAll(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.min(order("y")).alias("m"))
        steps.append(cut(least.select(F.col("x").alias("node"), F.least("m", order("x"))["node"].alias("to"))))
        one = edges.join(steps[-1].withColumnRenamed("node", "x"), "x").select(F.col("to").alias("x"), "y").distinct()
        two = one.join(steps[-1].withColumnRenamed("node", "y"), "y").where("x <> to")
        edges = cut(two.select(*pair("x", "to")).distinct())
    labels = steps.pop()
    while steps:
        upper = labels.select(F.col("node").alias("to"), F.col("to").alias("up"))
        labels = cut(steps.pop().join(upper, "to", "left").select("node", F.coalesce("up", "to").alias("to")))
    named = labels.groupBy("to").agg(F.min("node").alias("comp"))
    found = labels.join(named, "to").select("node", "comp")
    return found.unionAll(loops).groupBy("node").agg(F.min("comp").alias("comp"))
