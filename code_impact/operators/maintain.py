"""Upkeep of an index by what changed: merged tables, links between files and their closure follow a delta of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from code_impact.operators import java
from code_impact.operators.files import language_stats
from code_impact.operators.index import file_changes_since, incremental_types, merge_classes, merge_edges, merge_files
from code_impact.session import cut_lineage

FILE, CLASS, EDGE, LINK, PAIR = ["repository", "path"], ["repository", "name"], ["repository", "src", "dst"], ["repository", "user", "used"], ["repository", "start", "affected"]


def _replaced(old: DataFrame, keys: DataFrame, fresh: DataFrame, on: list[str]) -> DataFrame:
    return old.join(keys, on, "left_anti").unionByName(fresh)


def refresh_index(index: dict[str, DataFrame], types: DataFrame, new_files: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The index after ``new_files`` took the place of the files it was built from: (index, types, changed files).

    Only added and changed files are parsed. Classes and edges are merged again only where a changed file had or has one
    of their key, so all files that share such a key are asked who wins; all other rows are taken over.
    """
    changed = cut_lineage(file_changes_since(index["files"], new_files))
    fresh = cut_lineage(incremental_types(types, index["files"], new_files))
    touched = types.join(changed, FILE, "left_semi").unionByName(fresh.join(changed, FILE, "left_semi"))
    names = cut_lineage(touched.select(CLASS).distinct())
    ends = cut_lineage(java.edges(touched).select(EDGE).distinct())

    merged = cut_lineage(merge_classes(fresh.join(names, CLASS, "left_semi")))
    methods = merged.select("repository", F.col("name").alias("class"), F.posexplode("methods").alias("method_no", "m")).select("repository", "class", "method_no", "m.*")
    own = new_files.join(changed, FILE, "left_semi")
    found = {
        "files": _replaced(index["files"], changed, merge_files(own, fresh.join(changed, FILE, "left_semi")), FILE),
        "classes": _replaced(index["classes"], names, merged.drop("methods"), CLASS),
        "methods": _replaced(index["methods"], names.withColumnRenamed("name", "class"), methods, ["repository", "class"]),
        "edges": _replaced(index["edges"], ends, merge_edges(java.edges(fresh).join(ends, EDGE, "left_semi")), EDGE),
        "languages": language_stats(new_files),
    }
    return {part: cut_lineage(rows) for part, rows in found.items()}, fresh, changed


def _signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two tables without repeats that only one has, with sign 1 where it is the new one and -1 where it is the old."""
    columns = old.columns
    return new.join(old, columns, "left_anti").withColumn("sign", F.lit(1)).unionByName(old.join(new, columns, "left_anti").withColumn("sign", F.lit(-1)))


def _ends(index: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    edges = index["edges"].select("repository", "src", "dst", F.col("file").alias("user"))
    classes = index["classes"].select("repository", F.col("name").alias("dst"), F.col("path").alias("used"))
    return edges, classes


def link_support(index: dict[str, DataFrame]) -> DataFrame:
    """(repository, user, used, support): links between files, each with the number of edges that make it."""
    edges, classes = _ends(index)
    return edges.join(classes, ["repository", "dst"]).groupBy(LINK).agg(F.count(F.lit(1)).alias("support"))


def refresh_links(support: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(support, changes: links with sign 1 where they came and -1 where they went) after an index became another.

    The difference of a join is the new edges with the old classes and all edges with the new classes, signed; only links that
    it names are summed again. A link goes when the last edge that makes it goes.
    """
    (old_edges, old_classes), (new_edges, new_classes) = _ends(old), _ends(new)
    edges, classes = cut_lineage(_signed(old_edges, new_edges)), cut_lineage(_signed(old_classes, new_classes))
    parts = edges.join(old_classes, ["repository", "dst"]).select(*LINK, "sign").unionByName(new_edges.join(classes, ["repository", "dst"]).select(*LINK, "sign"))
    delta = cut_lineage(parts.groupBy(LINK).agg(F.sum("sign").alias("by")).where(F.col("by") != 0))
    held = delta.join(support, LINK, "left").withColumn("was", F.coalesce("support", F.lit(0))).withColumn("is", F.col("was") + F.col("by"))
    held = cut_lineage(held.select(*LINK, "was", "is"))
    kept = support.join(held.select(LINK), LINK, "left_anti").unionByName(held.where(F.col("is") > 0).select(*LINK, F.col("is").alias("support")))
    came, went = (F.col("was") == 0) & (F.col("is") > 0), (F.col("was") > 0) & (F.col("is") == 0)
    return cut_lineage(kept), held.where(came | went).select(*LINK, F.when(came, 1).otherwise(-1).alias("sign"))


def _grow(front: DataFrame, links: DataFrame, known: DataFrame, only: DataFrame | None = None) -> list[DataFrame]:
    """Pairs that ``front`` leads to over links (repository, at, to), without those known, and among ``only`` if given."""
    pieces = []
    while not front.isEmpty():
        pieces.append(front)
        step = front.join(links, [F.col("affected") == F.col("at"), front["repository"] == links["repository"]]).select(front["repository"], "start", F.col("to").alias("affected")).distinct()
        step = step.join(reduce(DataFrame.unionByName, [known, *pieces]), PAIR, "left_anti")
        front = cut_lineage(step if only is None else step.join(only, PAIR, "left_semi"))
        if len(pieces) == 16:
            pieces = [cut_lineage(reduce(DataFrame.unionByName, pieces))]
    return pieces


def refresh_closure(pairs: DataFrame, starts: DataFrame, old_links: DataFrame, new_links: DataFrame) -> DataFrame:
    """The closure (repository, start, affected) of links (repository, used, user) after they changed, from the one before.

    Pairs that a lost link may have carried are taken out, following the old links from it; those of them that the new links
    still give, and those that a new link adds, are found from what is left. The work follows the pairs that change or might
    have, on cycles too. ``starts`` (repository, start) are all that are asked for now; starts asked for the first time are followed whole.
    """
    same = lambda links: links.select("repository", F.col("used").alias("at"), F.col("user").alias("to")).distinct()
    was, now = cut_lineage(same(old_links)), cut_lineage(same(new_links))
    change = cut_lineage(_signed(was, now))
    lost, won = change.where("sign < 0").drop("sign"), change.where("sign > 0").drop("sign")
    starts = cut_lineage(starts.select("repository", "start").distinct())
    pairs = pairs.join(starts, ["repository", "start"], "left_semi")
    begun = pairs.select("repository", "start").distinct()
    at_start = lambda rows: rows.withColumn("affected", F.col("start"))

    def over(front: DataFrame, links: DataFrame) -> DataFrame:
        hop = front.select("repository", "start", F.col("affected").alias("at")).join(links, ["repository", "at"])
        return hop.select("repository", "start", F.col("to").alias("affected")).distinct()

    known = cut_lineage(pairs)
    doubtful = cut_lineage(over(known.unionByName(at_start(starts)), lost).join(known, PAIR, "left_semi"))
    none = known.limit(0)
    out = cut_lineage(reduce(DataFrame.unionByName, _grow(doubtful, was, none, known), none))
    kept = cut_lineage(known.join(out, PAIR, "left_anti"))
    every = kept.unionByName(at_start(starts))
    again = over(every, now.join(out.select("repository", F.col("affected").alias("to")).distinct(), ["repository", "to"], "left_semi")).join(out, PAIR, "left_semi")
    added = over(every, won)
    first = over(at_start(starts.join(begun, ["repository", "start"], "left_anti")), now)
    front = cut_lineage(again.unionByName(added).unionByName(first).distinct().join(kept, PAIR, "left_anti"))
    return cut_lineage(reduce(DataFrame.unionByName, [kept, *_grow(front, now, kept)]))
