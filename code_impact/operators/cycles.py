"""Strongly connected components of the links of each repository, so that a cycle counts as one node."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.session import cut_lineage

# Links of a repository that one task may hold (some 100 bytes each).
MOST_LINKS = 1_000_000


def components_of(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the number of its component, by one depth-first walk with a stack of open nodes."""
    order = np.argsort(source, kind="stable")
    following = target[order].tolist()
    begin = np.searchsorted(source[order], np.arange(n + 1)).tolist()
    seen, low, found = [0] * n, [0] * n, [-1] * n
    open_: list[int] = []
    clock = number = 0
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        path = [(root, begin[root])]
        while path:
            node, at = path[-1]
            if at < begin[node + 1]:
                path[-1] = (node, at + 1)
                other = following[at]
                if not seen[other]:
                    clock += 1
                    seen[other] = low[other] = clock
                    open_.append(other)
                    path.append((other, begin[other]))
                elif found[other] < 0:
                    low[node] = min(low[node], seen[other])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == seen[node]:
                while True:
                    member = open_.pop()
                    found[member] = number
                    if member == node:
                        break
                number += 1
    return np.array(found, np.int64)


def _in_one_task(links: DataFrame) -> DataFrame:
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([rows["used"].to_numpy(), rows["user"].to_numpy()]).astype(str)
        names, numbers = np.unique(ends, return_inverse=True)
        found = components_of(len(names), numbers[: len(rows)], numbers[len(rows) :])
        # Names are sorted, so the first of a component is its smallest.
        _, first = np.unique(found, return_index=True)
        return pd.DataFrame({"repository": rows["repository"].iloc[0], "node": names, "component": names[first][found]})

    return links.groupBy("repository").applyInPandas(walk, "repository string, node string, component string")


def _state(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _spread(links: DataFrame) -> DataFrame:
    """Components of more than one node, by colouring forwards and collecting backwards.

    Nodes that nothing leads to or from are taken off again and again. Every node then takes the largest name that reaches it;
    what reaches the node of a colour inside the colour is a component. The rest goes round again. Each step is a join of links
    with one row a node, written out.
    """
    key, done = ["repository", "node"], []
    left = cut_lineage(links.where("used <> user").select("repository", "used", "user").distinct())
    while True:
        n = left.count()
        while n:
            ends = left.select("repository", F.col("used").alias("node")).distinct().intersect(left.select("repository", F.col("user").alias("node")))
            ends = cut_lineage(ends)
            inner = left.join(ends.withColumnRenamed("node", "used"), ["repository", "used"], "left_semi")
            left = cut_lineage(inner.join(ends.withColumnRenamed("node", "user"), ["repository", "user"], "left_semi"))
            n, before = left.count(), n
            if n == before:
                break
        if not n:
            break
        colours = cut_lineage(left.select("repository", F.col("used").alias("node")).distinct().withColumn("colour", F.col("node")))
        state = _state(colours)
        while True:
            given = left.join(colours.withColumnRenamed("node", "used"), ["repository", "used"]).select("repository", F.col("user").alias("node"), "colour")
            colours = cut_lineage(colours.unionByName(given).groupBy(key).agg(F.max("colour").alias("colour")))
            state, before = _state(colours), state
            if state == before:
                break
        of = lambda end: colours.withColumnsRenamed({"node": end, "colour": f"{end}_colour"})
        same = left.join(of("used"), ["repository", "used"]).join(of("user"), ["repository", "user"]).where("used_colour = user_colour")
        same = cut_lineage(same.select("repository", "used", "user"))
        front = cut_lineage(colours.where("node = colour"))
        members = [front]
        while True:
            back = same.join(front.withColumnRenamed("node", "user"), ["repository", "user"]).select("repository", F.col("used").alias("node"), "colour").distinct()
            front = cut_lineage(back.join(reduce(DataFrame.unionByName, members), key, "left_anti"))
            if front.isEmpty():
                break
            members.append(front)
        found = cut_lineage(reduce(DataFrame.unionByName, members))
        done.append(found)
        for end in ("used", "user"):
            left = left.join(found.select("repository", F.col("node").alias(end)), ["repository", end], "left_anti")
        left = cut_lineage(left)
    if not done:
        return left.select("repository", F.col("used").alias("node"), F.col("used").alias("component"))
    rows = reduce(DataFrame.unionByName, done)
    smallest = rows.groupBy("repository", "colour").agg(F.min("node").alias("component"))
    return rows.join(smallest, ["repository", "colour"]).select("repository", "node", "component")


def strong_components(links: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(repository, node, component: its smallest node, cyclic) of all nodes of links (repository, used, user).

    A repository of up to ``most_links`` links is walked in one task, a larger one is coloured in rounds of joins; both give the same rows.
    A node is cyclic if a way of links leads back to it.
    """
    links = links.select("repository", "used", "user").distinct()
    counts = cut_lineage(links.groupBy("repository").agg(F.count(F.lit(1)).alias("_n")))
    of_size = lambda test: links.join(counts.where(test).select("repository"), "repository", "left_semi")
    found = _in_one_task(of_size(F.col("_n") <= most_links))
    if not counts.where(F.col("_n") > most_links).isEmpty():
        large = of_size(F.col("_n") > most_links)
        nodes = large.select("repository", F.col("used").alias("node")).unionByName(large.select("repository", F.col("user").alias("node"))).distinct()
        parts = nodes.join(_spread(large), ["repository", "node"], "left").withColumn("component", F.coalesce("component", "node"))
        found = found.unionByName(parts)
    found = cut_lineage(found)
    several = found.groupBy("repository", "component").agg((F.count(F.lit(1)) > 1).alias("several"))
    itself = links.where("used = user").select("repository", F.col("used").alias("node"), F.lit(True).alias("itself"))
    rows = found.join(several, ["repository", "component"]).join(itself, ["repository", "node"], "left")
    return rows.select("repository", "node", "component", (F.col("several") | F.coalesce("itself", F.lit(False))).alias("cyclic"))


def condensed(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct links between different components: (repository, used, user)."""
    of = lambda end: parts.select("repository", F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    rows = links.join(of("used"), ["repository", "used"]).join(of("user"), ["repository", "user"]).where("used_part <> user_part")
    return rows.select("repository", F.col("used_part").alias("used"), F.col("user_part").alias("user")).distinct()
