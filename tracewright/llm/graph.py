"""Connected components of an edge table, by contraction. Nothing is gathered on the driver but one row count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checkpoint


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long), undirected -> (node, root): every node of an edge, with one root per component.

    Each round every node points at the neighbour (or itself) whose hash is lowest and the graph shrinks to the nodes
    pointed at. Hash order makes long chains shrink by a constant factor and a star vanish within two rounds. Minima are
    partial aggregates and the joins carry one row per node on one side, so a node with very many edges is split by
    AQE. Both tables are checkpointed in every round."""
    edges = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        lowest = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        parents = checkpoint(lowest.select(F.col("a").alias("node"), F.least("m", order("a"))["id"].alias("parent")))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("node").alias("__n"), "parent")
            labels = checkpoint(labels.join(step, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("parent", "root").alias("root")))
        pa, pb = (parents.select(F.col("node").alias(f"__{c}"), F.col("parent").alias(f"p{c}")) for c in "ab")
        moved = edges.join(pa, F.col("a") == F.col("__a")).join(pb, F.col("b") == F.col("__b")).where("pa <> pb")
        edges = checkpoint(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components: not contracted after {max_rounds} rounds")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
