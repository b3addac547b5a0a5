"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge, the component being its smallest node.

    Each round points every node to its smallest neighbour if that is smaller,
    follows pointers to their ends, and contracts; at least half of the nodes of
    a component that still has edges go, so that rounds grow with the logarithm
    of the largest component. Each step is a table in the shared folder. Loops
    and repeated edges are allowed, edges with a null end ignored; no edges give
    no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    links = common.stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    maps: list[DataFrame] = []
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    while True:
        links = links.where("u <> v")
        if links.isEmpty():
            break
        # The larger end of a link points down, the smaller one may have its own smaller neighbour.
        up = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
        roots = links.select(F.col("u").alias("node")).distinct().join(up.select("node"), "node", "left_anti")
        pointers = common.stored(up.unionByName(roots.withColumn("to", F.col("node"))), "pointers")
        while True:
            end = pointers.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = common.stored(pointers.join(end, "to").select("node", F.col("far").alias("to"), (F.col("far") < F.col("to")).alias("moved")), "jumped")
            pointers = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        maps.append(pointers)
        first, second = (pointers.select(F.col("node").alias(x), F.col("to").alias(x + "2")) for x in ("u", "v"))
        contracted = links.join(first, "u").join(second, "v").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        links = common.stored(contracted.where("u <> v").distinct(), "links")
    out = nodes.withColumn("component", F.col("node"))
    for m in maps:
        step = m.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
