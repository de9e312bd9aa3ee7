"""Connected components by hooking and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends and contracts
    the edges, so the number of rounds is logarithmic. All steps are joins and minima with partial
    aggregation, and nodes that very many point at are looked up by broadcast; nothing but counts comes to the
    driver. Null ends are ignored.
    """
    edges = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "hooks")
        while True:
            at = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(lookup(up, at, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jumps")
            up = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = up.select(F.col("u").alias("root"), "p").where("root <> p")
            labels = materialise(labels.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        for end in ("u", "v"):  # contract: each end becomes what it points at
            to = up.select(F.col("u").alias(end), F.col("p").alias("to"))
            edges = materialise(lookup(edges, to, end).withColumn(end, F.col("to")).drop("to"), "edges")
        edges = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
