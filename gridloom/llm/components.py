"""Connected components of a link table, by contraction: rounds of hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): component is the least node reachable.

    Each round every node hooks to its least neighbour, the trees that this makes are flattened by doubling (as many times as
    the logarithm of the deepest), and links are relabelled by their roots; those inside one tree go. So the nodes are at
    least halved, and rounds go on until no link is left. All tables stay distributed and are written to the shared folder,
    and hot nodes only meet unique rows in joins, which AQE splits. An empty table gives an empty one.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("to")))
        hook = saved(both.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("up")), "hook")
        moved = True
        while moved:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = saved(hook.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hook")
            moved = not hook.where("moved").isEmpty()
        hook = hook.drop("moved")
        if nodes is None:
            nodes = hook.select("node", F.col("up").alias("component"))
        else:
            nodes = saved(nodes.join(hook.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "nodes")
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("ca")), hook.select(F.col("node").alias("b"), F.col("up").alias("cb"))
        edges = saved(edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if nodes is None else nodes
