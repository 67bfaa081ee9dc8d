"""Lookups and impact queries over the index. Questions come as tables, so any number of them is one join.

Answers are rows, never lists per class: a class everybody uses would not fit one row. AQE splits the hub keys of the
joins on ``dst``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from code_impact.operators.cycles import condensed, strong_components
from code_impact.session import cut_lineage

# Weight of a related file by fragments of its path, and of a file that only depends on the change.
PATH_WEIGHTS = {
    "service": 2.0, "controller": 1.8, "repository": 1.6, "model": 1.5, "interface": 1.5, "dto": 1.4, "entity": 1.4,
    "test": 0.3, "spec": 0.3, "mock": 0.4, ".config": 0.5,
}
DEPENDENT_WEIGHT = 0.7
RELATED_FILES = 10
SECOND_LEVEL_FILES = 10
KINDS = ["service", "controller", "repository", "model", "interface", "dto", "entity"]


def find_class(classes: DataFrame, asked: DataFrame) -> DataFrame:
    return classes.join(asked.select("repository", "name").distinct(), ["repository", "name"])


def dependents_of(edges: DataFrame) -> DataFrame:
    """Distinct (repository, name, dependent)."""
    return edges.select("repository", F.col("dst").alias("name"), F.col("src").alias("dependent")).distinct()


def find_dependents(edges: DataFrame, asked: DataFrame) -> DataFrame:
    return dependents_of(edges).join(asked.select("repository", "name").distinct(), ["repository", "name"])


def find_dependencies(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """Direct superclass and interfaces of the asked classes."""
    return find_class(classes, asked).select("repository", "name", F.explode("dependencies").alias("dependency"))


def methods_in_class(methods: DataFrame, asked: DataFrame) -> DataFrame:
    wanted = asked.select("repository", F.col("name").alias("class")).distinct()
    return methods.join(wanted, ["repository", "class"])


def files_by_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.col("language") == language).select("repository", "path")


def classes_in_file(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Classes of the asked paths; a path the index does not know keeps one row with a null class."""
    wanted = asked.select("repository", "path").distinct()
    return wanted.join(files.select("repository", "path", "classes"), ["repository", "path"], "left").select(
        "repository", "path", F.explode_outer("classes").alias("class")
    )


def _two_levels(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(repository, name, level, dependent), each pair once per level. Hop one is deduplicated before hop two."""
    users = dependents_of(edges)
    first = find_dependents(edges, asked)
    back = users.select("repository", F.col("name").alias("middle"), F.col("dependent").alias("_second"))
    second = first.withColumnRenamed("dependent", "middle").join(back, ["repository", "middle"])
    second = second.select("repository", "name", F.col("_second").alias("dependent")).distinct()
    return first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))


def impact_files(edges: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """Files of first- and second-level dependents that exist as classes."""
    where = classes.select("repository", F.col("name").alias("dependent"), "path")
    return _two_levels(edges, asked).join(where, ["repository", "dependent"]).select("repository", "name", "path").distinct()


def analyze_impact(edges: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """Direct dependents, affected files and total impact of each asked class."""
    where = classes.select("repository", F.col("name").alias("dependent"), "path")
    rows = _two_levels(edges, asked).join(where, ["repository", "dependent"], "left")
    counted = rows.groupBy("repository", "name").agg(
        F.count_if(F.col("level") == 1).alias("direct_dependents"),
        F.count_distinct("path").alias("affected_files"),
        F.count(F.lit(1)).alias("total_impact"),
    )
    every = asked.select("repository", "name").distinct()
    return every.join(counted, ["repository", "name"], "left").na.fill(0)


def closure(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Everything that reaches a start over ``links(repository, used, user)``: (repository, start, affected).

    Breadth first, all starts at once. A start appears in its own answer only when a cycle leads back to it. Each round
    is written out, so the plan of a round does not contain the rounds before.
    """
    links = links.select("repository", F.col("used").alias("node"), "user").distinct()
    frontier = starts.select("repository", "start", F.col("start").alias("node")).distinct()
    pieces: list[DataFrame] = []
    while True:
        step = frontier.join(links, ["repository", "node"]).select("repository", "start", F.col("user").alias("node")).distinct()
        if pieces:
            step = step.join(reduce(DataFrame.unionByName, pieces), ["repository", "start", "node"], "left_anti")
        frontier = cut_lineage(step)
        pieces.append(frontier)
        if frontier.isEmpty():
            break
        if len(pieces) == 16:
            pieces = [cut_lineage(reduce(DataFrame.unionByName, pieces))]
    return reduce(DataFrame.unionByName, pieces).withColumnRenamed("node", "affected")


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of ``closure``, found between strongly connected components: a cycle is walked as one node, whatever its size."""
    links = cut_lineage(links.select("repository", "used", "user").distinct())
    parts = cut_lineage(strong_components(links))
    asked = starts.select("repository", F.col("start").alias("node")).distinct().join(parts, ["repository", "node"])
    asked = cut_lineage(asked.select("repository", F.col("node").alias("start"), F.col("component").alias("part"), "cyclic"))
    ways = closure(condensed(links, parts), asked.select("repository", F.col("part").alias("start")))
    own = asked.where("cyclic").select("repository", F.col("part").alias("start"), F.col("part").alias("affected")).distinct()
    pairs = ways.unionByName(own).select("repository", F.col("start").alias("part"), F.col("affected").alias("component"))
    members = parts.select("repository", "component", F.col("node").alias("affected"))
    return asked.join(pairs, ["repository", "part"]).join(members, ["repository", "component"]).select("repository", "start", "affected")


def transitive_dependents(edges: DataFrame, asked: DataFrame) -> DataFrame:
    links = edges.select("repository", F.col("dst").alias("used"), F.col("src").alias("user"))
    return reached(links, asked.select("repository", F.col("name").alias("start")))


def file_links(index: dict[str, DataFrame]) -> DataFrame:
    """Distinct (repository, user, used) between files: the file of an edge and the file of the class it names."""
    target = index["classes"].select("repository", F.col("name").alias("dst"), F.col("path").alias("used"))
    return index["edges"].join(target, ["repository", "dst"]).select("repository", F.col("file").alias("user"), "used").distinct()


def reverse_index(index: dict[str, DataFrame]) -> DataFrame:
    return file_links(index).select("repository", F.col("used").alias("path"), F.col("user").alias("used_by"))


def second_level_dependencies(index: dict[str, DataFrame], changes: DataFrame, limit: int = SECOND_LEVEL_FILES) -> DataFrame:
    """Files outside a pull request its files need (level 1), and what those need (level 2, the first ``limit``)."""
    links = file_links(index)
    pr = ["repository", "pr_number"]
    inside = changes.select(*pr, F.col("filename").alias("path")).distinct()
    needs = links.select("repository", F.col("user").alias("path"), F.col("used").alias("_next"))
    outside = lambda rows, known: rows.join(known, [*pr, "path"], "left_anti")
    hop = lambda rows: rows.join(needs, ["repository", "path"]).select(*pr, F.col("_next").alias("path")).distinct()
    first = outside(hop(inside), inside)
    second = outside(hop(first), inside.unionByName(first))
    ranked = second.withColumn("_rn", F.row_number().over(Window.partitionBy(*pr).orderBy("path"))).where(F.col("_rn") <= limit)
    return first.withColumn("level", F.lit(1)).unionByName(ranked.drop("_rn").withColumn("level", F.lit(2)))


def first_dependents(index: dict[str, DataFrame], changes: DataFrame, limit: int = 3) -> DataFrame:
    """The first users of each changed file, by path, as context for a review. The rank is cut per file, once, before the
    changes are joined."""
    order = Window.partitionBy("repository", "used").orderBy("user")
    first = file_links(index).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    users = first.select("repository", F.col("used").alias("filename"), F.col("user").alias("dependent"), "rank")
    return changes.select("repository", "pr_number", "filename").distinct().join(users, ["repository", "filename"])


def impact_radius(index: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """Users of each changed file, and users of the users counted once per way. Only counts are joined."""
    links = file_links(index)
    direct = links.groupBy("repository", "used").agg(F.count(F.lit(1)).alias("n"))
    of_user = direct.select("repository", F.col("used").alias("user"), "n")
    indirect = links.join(of_user, ["repository", "user"], "left").groupBy("repository", F.col("used").alias("path")).agg(
        F.count(F.lit(1)).alias("direct_impact"), F.coalesce(F.sum("n"), F.lit(0)).alias("indirect_impact")
    )
    asked = changes.select("repository", F.col("filename").alias("path")).distinct()
    return asked.join(indirect, ["repository", "path"], "left").na.fill(0)


def path_priority(path: Column) -> Column:
    product = F.lit(1.0)
    for fragment, weight in PATH_WEIGHTS.items():
        product = product * F.when(F.contains(path, F.lit(fragment)), weight).otherwise(1.0)
    return product


def _top(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("priority").desc(), "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _state(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def best_dependents(links: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` files by priority and path that reach each file, at any distance: (repository, start, path, priority, rank).

    Files of a cycle are reached by the same files, so the best are looked for per strongly connected component. They are among
    the users of its files and the best of each component that uses it, so only ``limit`` rows a component are kept, and the step
    is repeated until nothing changes. That is exact, and the rows of a round are at most ``limit`` per link.
    """
    key = ["repository", "start"]
    parts = cut_lineage(strong_components(links))
    ways = cut_lineage(condensed(links, parts))
    used = parts.select("repository", F.col("node").alias("used"), F.col("component").alias("start"))
    direct = links.join(used, ["repository", "used"]).select("repository", "start", F.col("user").alias("path")).distinct()
    direct = cut_lineage(_top(direct.withColumn("priority", path_priority(F.col("path"))), key, limit)).drop("rank")
    best = cut_lineage(_top(direct, key, limit))
    state = _state(best)
    while True:
        of_users = best.select("repository", F.col("start").alias("user"), "path", "priority")
        via = ways.join(of_users, ["repository", "user"]).select("repository", F.col("used").alias("start"), "path", "priority")
        rows = direct.unionByName(via).groupBy(*key, "path").agg(F.first("priority").alias("priority"))
        best = cut_lineage(_top(rows, key, limit))
        state, before = _state(best), state
        if state == before:
            break
    files = parts.select("repository", F.col("component").alias("start"), "node")
    return best.join(files, key).select("repository", F.col("node").alias("start"), "path", "priority", "rank")


def related_files(index: dict[str, DataFrame], changes: DataFrame, limit: int = RELATED_FILES) -> DataFrame:
    """Best related files per pull request: what the changed files need, and whatever depends on them at any distance.

    Only the best ``limit`` of a file can be among the best of a pull request, so only those are looked for.
    """
    links = cut_lineage(file_links(index))
    pr = ["repository", "pr_number"]
    known = index["files"].select("repository", "path")
    changed = changes.select(*pr, F.col("filename").alias("path")).distinct().join(known, ["repository", "path"], "left_semi")
    affected = best_dependents(links, limit).select("repository", "start", "path", (F.col("priority") * DEPENDENT_WEIGHT).alias("priority"))
    needed = links.select("repository", F.col("user").alias("start"), F.col("used").alias("path"))
    needed = needed.withColumn("priority", path_priority(F.col("path")))
    per_file = changed.withColumnRenamed("path", "start")
    rows = per_file.join(needed.unionByName(affected), ["repository", "start"])
    best = rows.groupBy(*pr, "path").agg(F.max("priority").alias("priority"))
    return _top(best, pr, limit)


def affected_by_kind(affected: DataFrame) -> DataFrame:
    """Affected files of each pull request counted by the kind their path names; one file may count in several."""
    counts = [F.count_if(F.contains("path", F.lit(kind))).alias(f"affected_{kind}") for kind in KINDS]
    return affected.groupBy("repository", "pr_number").agg(F.count(F.lit(1)).alias("affected_files"), *counts)


def breaking_with_impact(breaking: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Each breaking change with the number of files using its class, counted before the join."""
    where = index["classes"].select("repository", F.col("name").alias("dependent"), "path")
    users = dependents_of(index["edges"]).join(where, ["repository", "dependent"])
    counted = users.groupBy("repository", F.col("name").alias("class")).agg(F.count_distinct("path").alias("affected_files"))
    return breaking.join(counted, ["repository", "class"], "left").na.fill(0, ["affected_files"])


def import_dependents(imports: DataFrame, changes: DataFrame, class_of: Column) -> DataFrame:
    """Files whose imports end in a changed class: one row per pull request, file and class, scored by matching imports."""
    used = imports.select("repository", "path", F.substring_index("import", ".", -1).alias("class"))
    scored = used.groupBy("repository", "class", "path").agg(F.count(F.lit(1)).alias("score"))
    changed = changes.select("repository", "pr_number", class_of.alias("class")).distinct()
    found = changed.join(scored, ["repository", "class"])
    return found.select("repository", "pr_number", "path", F.concat(F.lit("Imports "), F.col("class")).alias("reason"), "score")


def related_code_once(related: DataFrame) -> DataFrame:
    """Related code without repeats of (path, first 50 characters), ranked in four classes. The first of each wins."""
    code, reason = F.col("code"), F.col("reason")
    keyed = related.withColumn("_head", F.substring(code, 1, 50))
    kept = keyed.groupBy("repository", "path", "_head").agg(F.min_by(F.struct("pos", "reason", "code"), "pos").alias("w"))
    rows = kept.select("repository", "path", "w.*")
    relevance = (
        F.when(F.contains(code, F.lit("interface")), 0)
        .when(F.contains(reason, F.lit("Parent class")), 1)
        .when(F.contains(reason, F.lit("Imported by")), 2)
        .otherwise(3)
    )
    return rows.withColumn("relevance", relevance)


def within_token_budget(related: DataFrame, budget: int, keep: int) -> DataFrame:
    """Related files of each pull request (``rank``, ``length`` of the content) with ``kept_chars``, at 4 characters a token.

    All files stay whole where they fit together. Where they do not, the first ``keep`` stay and the content of the one that
    passes the budget is cut; those behind it have no room. Only lengths are read: a caller cuts the content of the rows given.
    """
    every = Window.partitionBy("repository", "pr_number")
    earlier = every.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    most = budget * 4
    sized = related.withColumn("_fits", F.sum("length").over(every) <= most).withColumn("_before", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    kept = F.when(F.col("_fits"), F.col("length")).otherwise(F.least(F.col("length"), most - F.col("_before")))
    room = F.col("_fits") | ((F.col("rank") <= keep) & (F.col("_before") < most))
    return sized.where(room).withColumn("kept_chars", kept.cast("bigint")).drop("_fits", "_before")
