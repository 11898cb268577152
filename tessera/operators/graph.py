"""Graph operators as bounded loops of joins.

Loops end when nothing new is found; each round is written, so lineage
does not grow and a lost executor repeats one round at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): one hop in either direction, without the node itself."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.where("node <> other").distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, keep=None) -> tuple[DataFrame, DataFrame]:
    """Depth of each node reached from the seeds, and every hop taken with its depth.

    Hops to nodes already reached are recorded too, but only new nodes are
    extended. ``keep`` is a condition on an edge.
    """
    edges = edges if keep is None else edges.where(keep)
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, hops = seen, None
    for depth in range(1, max_depth + 1):
        taken = edges.join(frontier.select(F.col("node").alias("src")), "src").withColumn("depth", F.lit(depth))
        hops = taken if hops is None else hops.unionByName(taken)
        new = taken.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen, hops


def reach(edges: DataFrame) -> DataFrame:
    """Transitive closure (src, dst) of at least one step, by doubling; for graphs of components, not of modules."""
    found = cut(edges.select("src", "dst").distinct())
    size = found.count()
    while True:
        step = found.select(F.col("src").alias("mid0"), F.col("dst").alias("end"))
        found = cut(found.unionByName(found.join(step, found.dst == step.mid0).select("src", F.col("end").alias("dst"))).distinct())
        now = found.count()
        if now == size:
            break
        size = now
    return found


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges whose end reaches their start."""
    back = reach(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").distinct().join(back, ["src", "dst"], "left_semi")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without an edge in or out are taken away until none is: all loops, and what lies between them."""
    core = cut(edges.select("src", "dst").distinct())
    size = core.count()
    while size:
        core = cut(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = core.count()
        if now == size:
            break
        size = now
    return core


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other share the smallest name."""
    closure = reach(edges)
    mutual = closure.join(closure.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    least = mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    return nodes.join(least, "node", "left").select("node", F.least("node", F.coalesce("least", "node")).alias("component"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest name of the nodes joined by edges in either direction."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("src"), F.col("component").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("node").alias("j"), F.col("component").alias("far"))
        after = step.join(jump, step.component == jump.j, "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "before")
        after = cut(after)
        same = after.where("component <> before").isEmpty()
        labels = after.select("node", "component")
        if same:
            break
    return labels


def ancestors_of(parents: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for rows (node, parent), the node itself at distance 0; a loop of parents is an error."""
    found = parents.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    last = found
    up = parents.where("parent is not null").select(F.col("node").alias("ancestor"), "parent")
    for distance in count(1):
        last = cut(last.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(distance).alias("distance")))
        if last.isEmpty():
            break
        if not last.where("node = ancestor").isEmpty():
            raise ValueError("the parents form a loop")
        found = found.unionByName(last)
    return found


def follow(links: DataFrame, doublings: int = 64) -> DataFrame:
    """(node, end): the end of each chain of (node, next), by pointer jumping (each round doubles the links followed, 2**64 in all); null if the chain is a loop."""
    now = cut(links.select("node", F.col("next").alias("end")))
    for _ in range(doublings):
        hop = now.select(F.col("node").alias("n"), F.col("end").alias("far"))
        after = cut(now.join(hop, now.end == hop.n, "left").select("node", "end", "far"))
        done = after.where("far is not null and far <> end").isEmpty()
        now = cut(after.select("node", F.coalesce("far", "end").alias("end")))
        if done:
            break
    loops = now.join(links.select(F.col("node").alias("end")), "end", "left_semi").select("node")
    return now.join(loops.withColumn("loop", F.lit(True)), "node", "left").select("node", F.when(F.col("loop").isNull(), F.col("end")).alias("end"))
