"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root: smallest node that the edges (a, b) lead to), for every node of an edge between different nodes.

    Stars are drawn to the smallest neighbour in turn from larger and from smaller nodes until nothing moves, which takes
    about log(nodes) rounds. Every round is written to the shared folder. The joins of a hub are split where they are skewed, and
    a hub's neighbours are never gathered. Edges with a null end are left out.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    state = _state(pairs)
    while state[0]:
        # Larger neighbours of each node point to the node's smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that the join below deals its rows anew and can split those of a hub.
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Smaller neighbours of each node, and the node, point to the smallest.
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state, before = _state(pairs), state
        if state == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
