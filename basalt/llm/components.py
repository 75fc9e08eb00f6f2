"""Connected components of a distributed list of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: So many links at most are left to one task: the last step at every size, as contraction goes on until no more are left.
TAIL = 1000


def tail(links: DataFrame) -> DataFrame:
    """node and to (its smallest reachable node) of at most TAIL links, by union-find in one task."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "to"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, to long")


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (its smallest reachable node) of every node in links (a, b).

    Each round gives every node the neighbour, or itself, that comes first in a random order of the round, and
    contracts the links to these; a constant share of the nodes goes with each round, also on long chains. Hot nodes are
    pre-aggregated in the map tasks, and nothing but a count of links reaches the driver. The last TAIL links are
    joined in one task.
    """
    links = scratch.keep(links.where("a <> b").select("a", "b").distinct(), f"{name}-links0")
    steps: list[DataFrame] = []
    left = links.count()
    while left > TAIL:
        k = len(steps)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), "b")).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("b"))
        step = scratch.keep(first.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("to")), f"{name}-step{k}")
        steps.append(step)
        from_a, from_b = step.select(F.col("node").alias("a"), F.col("to").alias("c")), step.select(F.col("node").alias("b"), F.col("to").alias("d"))
        links = links.join(from_a, "a").join(from_b, "b").where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        links = scratch.keep(links, f"{name}-links{k + 1}")
        left = links.count()
    if left:
        steps.append(scratch.keep(tail(links), f"{name}-tail"))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0]
    for step in steps[1:]:
        more = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = out.join(more, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if len(steps) == 1 and left:
        return out.withColumnRenamed("to", "component")
    out = scratch.keep(out, f"{name}-roots")
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return scratch.keep(out.join(least, "to").select("node", "component"), name)


def joined(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """found (node, component) after further links (a, b) between components; a node that found lacks is its own."""
    step = components(links, scratch, f"{name}-step")
    to = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
    old = found.join(to, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return scratch.keep(old.unionByName(step.join(found.select("node"), "node", "left_anti")), name)
