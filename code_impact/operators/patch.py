"""Analyses of pull-request patches. Patch text is read inside its own row; only what it yields is joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions import paths
from code_impact.functions.arrays import each, let, sums_before, with_once
from code_impact.operators.graph import dependents_of
from code_impact.session import cut_lineage

# Texts of findings and summaries.
REMOVED_LIVE = "Public method '%s' was removed from %s"
REMOVED_V2 = "Public method '%s' was removed"
CHANGED_V2 = "Method signature changed: %s"
CLASS_V2 = "Class '%s' was removed"
SUGGESTIONS = {
    "method-removed": "Consider deprecating the method first before removal",
    "signature-changed": "Ensure all callers are updated",
    "class-removed": "Check all references to this class",
}
NO_INDEX = "No dependency index available for analysis"
MANIFESTS = ["pom.xml", "build.gradle", "package.json"]

PR = ["repository", "pr_number"]
# The same inside a whole patch, whose lines end in \n alone: names on removed lines, on lines an added one follows, and
# on any line.
_GAP, _LINE = r"[\s&&[^\n]]*\(", r"[^\n]*"
_REMOVED_CALL = rf"(?dm)^-(?!--){_LINE}?public[^(\n]*?(\w+){_GAP}"
_REMOVED_NAME = rf"(?dm)^-(?!--)(?={_LINE}public){_LINE}?(\w+){_GAP}"
_OPEN = rf"{_LINE}(?:public|protected)"
_MODIFIED_NAME = rf"(?dm)^-(?={_OPEN}{_LINE}\n\+{_OPEN}){_LINE}?(\w+){_GAP}"
_OPEN_NAME = rf"(?dm)^(?={_OPEN}){_LINE}?(\w+){_GAP}"
_HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def lines_of(patch: Column) -> Column:
    return F.split(patch, "\n", -1)


def removed_of(patch: Column) -> Column:
    """Removed lines without their marker."""
    gone = F.filter(lines_of(patch), lambda line: line.startswith("-") & ~line.startswith("---"))
    return F.transform(gone, lambda line: F.substr(line, F.lit(2)))


def _has(line: Column, *words: str) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(line, F.lit(word))
    return hit


def _names(lines: Column, pattern: str) -> Column:
    return F.filter(F.transform(lines, lambda line: F.regexp_extract(line, pattern, 1)), lambda name: name != "")


def _all_names(patch: Column, pattern: str, *needed: str) -> Column:
    """Names a pattern finds line by line, in one pass over the patch; none where a text is missing that every match has."""
    found = F.regexp_extract_all(patch, F.lit(pattern), F.lit(1))
    if needed:
        found = F.when(reduce(Column.__and__, [F.contains(patch, F.lit(text)) for text in needed]), found)
    return F.coalesce(found, F.array().cast("array<string>"))


def removed_methods(patch: Column) -> Column:
    """Names of public methods on removed lines; null patch gives an empty array."""
    return _all_names(patch, _REMOVED_CALL, "public", "(")


def modified_methods(patch: Column) -> Column:
    """Names on removed public or protected lines directly followed by an added one."""
    return _all_names(patch, _MODIFIED_NAME, "\n+", "(")


def removed_lines(changes: DataFrame) -> DataFrame:
    return changes.select(*PR, "file_no", "filename", F.posexplode(each(removed_of(F.col("patch")))).alias("pos", "line"))


def modified_signatures(changes: DataFrame) -> DataFrame:
    return changes.select(*PR, "file_no", "filename", F.explode(each(modified_methods(F.col("patch")))).alias("method"))


def diff_line_map(changes: DataFrame) -> DataFrame:
    """File line of each diff line; null for removed lines. A diff line several hunks have goes to the first."""
    hunks = F.filter(F.split("patch", rf"(?m)^(?={_HUNK})", -1), lambda h: h.rlike(f"^{_HUNK}"))

    def lines(hunk: Column) -> Column:
        body = F.filter(F.slice(lines_of(F.regexp_replace(hunk, r"\n$", "")), 2, 1 << 30), lambda line: ~line.startswith("@@"))
        start = F.regexp_extract(hunk, _HUNK, 1).cast("int")

        def mapped(rows: Column) -> Column:
            moves = F.transform(rows, lambda line: (line.startswith("+") | line.startswith(" ")).cast("int"))
            return F.zip_with(
                rows, sums_before(moves), lambda line, before: F.when(~line.startswith("-"), start + before)
            )

        return let(body, mapped)

    def first_wins(parts: Column) -> Column:
        longest_before = lambda h: F.coalesce(F.array_max(F.transform(F.slice(parts, 1, h), F.size)), F.lit(0))
        numbered = lambda part, h: F.filter(
            F.transform(part, lambda file_line, i: F.struct((i + 1).alias("diff_line"), file_line.alias("file_line"))),
            lambda row: row["diff_line"] > longest_before(h),
        )
        return F.flatten(F.transform(parts, numbered))

    found = changes.where(F.col("patch").isNotNull()).select(
        *PR, "file_no", F.explode(each(let(F.transform(hunks, lines), first_wins))).alias("m")
    )
    return found.select(*PR, "file_no", "m.diff_line", "m.file_line")


# Live analysis -------------------------------------------------------------------------------------------------------


def _touched(changes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed source files, and the same per class the index knows in them. Patches end here, as method names."""
    source = changes.where(paths.is_impact_source(F.col("filename"))).select(
        *PR, "file_no", "filename", removed_methods(F.col("patch")).alias("removed")
    )
    known = files.select("repository", F.col("path").alias("filename"), F.explode("classes").alias("class"))
    return source, source.join(known, ["repository", "filename"])


def breaking_changes(changes: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Removed public methods, one row per class of the changed file. Only these rows reach the joins, not the patches."""
    source = changes.where(paths.is_impact_source(F.col("filename")))
    return breaking_methods(source.select(*PR, "file_no", "filename", F.explode(each(removed_methods(F.col("patch")))).alias("method")), index)


def breaking_methods(gone: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """The same from rows (repository, pr_number, file_no, filename, method) of methods removed from source files."""
    known = index["files"].select("repository", F.col("path").alias("filename"), F.explode("classes").alias("class"))
    where = index["classes"].select("repository", F.col("name").alias("class"), "path")
    rows = gone.join(known, ["repository", "filename"]).join(where, ["repository", "class"])
    return rows.select(
        *PR, "file_no", F.lit("method-removed").alias("type"), F.lit("high").alias("severity"), F.col("class").alias("class_name"),
        F.col("method").alias("method_name"), F.format_string(REMOVED_LIVE, "method", "class").alias("description"),
        F.col("path").alias("file"),
    )


def affected_classes(changes: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Distinct classes of the changed files and the classes that use them, whether the index knows these or not."""
    _, in_file = _touched(changes, index["files"])
    own = in_file.select(*PR, "class").distinct()
    users = dependents_of(index["edges"]).withColumnRenamed("name", "class")
    hit = own.join(users, ["repository", "class"]).select(*PR, F.col("dependent").alias("class"))
    return own.unionByName(hit).distinct()


def affected_files(changes: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Distinct changed source files and the files of classes that use theirs. Users are reduced to files before they are joined."""
    source, in_file = _touched(changes, index["files"])
    own = in_file.select(*PR, "class").distinct()
    where = index["classes"].select("repository", F.col("name").alias("dependent"), "path").where(F.col("path").isNotNull())
    users = dependents_of(index["edges"]).join(where, ["repository", "dependent"]).select("repository", F.col("name").alias("class"), "path").distinct()
    hit = own.join(users, ["repository", "class"]).select(*PR, "path")
    return source.select(*PR, F.col("filename").alias("path")).unionByName(hit).distinct()


def risk_level(critical: Column, high: Column, files: Column, many: int) -> Column:
    return (
        F.when(critical > 0, "critical")
        .when((high >= 3) | (files > many), "high")
        .when((high > 0) | (files > 5), "medium")
        .otherwise("low")
    )


def _sentence(parts: list[tuple[Column, str]], risk: Column) -> Column:
    texts = [F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {text}"))) for count, text in parts]
    return F.concat_ws(". ", *texts, F.concat(F.lit("Risk level: "), risk))


def _profiles(users: DataFrame) -> DataFrame:
    """(repository, class, kind, unit, weight) of users (repository, class, kind, name): names of a kind that use the same classes
    count as one unit, named by the first of them and weighed by their number. The classes of a name are what one file uses."""
    used = users.groupBy("repository", "kind", "name").agg(F.sort_array(F.collect_set("class")).alias("_classes"))
    units = used.groupBy("repository", "kind", "_classes").agg(F.min("name").alias("unit"), F.count(F.lit(1)).alias("weight"))
    return units.select("repository", "kind", "unit", "weight", F.explode("_classes").alias("class"))


def _union_sizes(own: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pull requests of ``own`` (repository, pr_number, class), distinct, and how many users (repository, class, kind, name) of
    a kind all classes of a pull request have together: (repository, pr_number, affected_files, affected_classes)."""
    alike = ["repository", "_size", "_a", "_b"]
    sets = own.groupBy(*PR).agg(
        F.count(F.lit(1)).alias("_size"), F.bit_xor(F.xxhash64("class")).alias("_a"), F.bit_xor(F.xxhash64(F.lit("set"), "class")).alias("_b")
    )
    sets = cut_lineage(sets)
    first = cut_lineage(sets.groupBy(*alike).agg(F.min("pr_number").alias("pr_number")))
    members = own.join(first, PR).select(*alike, "class")
    hit = members.join(_profiles(users), ["repository", "class"]).groupBy(*alike, "kind", "unit").agg(F.max("weight").alias("weight"))
    size = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("weight"))), F.lit(0))
    found = hit.groupBy(*alike).agg(size("file").alias("affected_files"), size("class").alias("affected_classes"))
    return sets, sets.join(found, alike).select(*PR, "affected_files", "affected_classes")


def _reach(source: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """(repository, pr_number, affected_files, affected_classes): what users of the classes in changed source files add to a
    pull request's own.

    Pairs of pull requests and users are not made: a hub has many of both. Pull requests that change the same used classes share
    one count, told by two hashes of the set, and users of the same classes count together. What a pull request changes
    itself is among the users of its other classes at times; that is found from its own side and taken off.
    """
    source = source.where(F.col("pr_number").isNotNull()).select(*PR, "filename")
    known = index["files"].select("repository", F.col("path").alias("filename"), F.explode("classes").alias("class"))
    users = dependents_of(index["edges"]).withColumnRenamed("name", "class")
    used = cut_lineage(known.join(users.select("repository", "class").distinct(), ["repository", "class"], "left_semi"))
    own = cut_lineage(source.join(used, ["repository", "filename"]).select(*PR, "class").distinct())

    where = index["classes"].select("repository", F.col("name").alias("dependent"), "path")
    users = users.join(own.select("repository", "class").distinct(), ["repository", "class"], "left_semi")
    in_files = users.join(where, ["repository", "dependent"]).where(F.col("path").isNotNull())
    as_class = users.select("repository", "class", F.lit("class").alias("kind"), F.col("dependent").alias("name"))
    as_file = in_files.select("repository", "class", F.lit("file").alias("kind"), F.col("path").alias("name")).distinct()
    users = cut_lineage(as_class.unionByName(as_file))

    sets, found = _union_sizes(own, users)
    near = cut_lineage(source.join(sets.select(*PR), PR, "left_semi").distinct())
    twice = near.select(*PR, F.lit("file").alias("kind"), F.col("filename").alias("name")).unionByName(
        near.join(known, ["repository", "filename"]).select(*PR, F.lit("class").alias("kind"), F.col("class").alias("name")).distinct()
    )
    same = (twice["repository"] == users["repository"]) & (twice["kind"] == users["kind"]) & twice["name"].eqNullSafe(users["name"])
    twice = twice.join(users, same).select(*[twice[c] for c in PR], twice["kind"], twice["name"], users["class"])
    twice = twice.join(own, [*PR, "class"], "left_semi").select(*PR, "kind", "name").distinct()
    less = lambda kind: F.when(F.col("kind") == kind, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    return found.unionByName(twice.select(*PR, less("file").alias("affected_files"), less("class").alias("affected_classes")))


def analyze(changes: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """One row per pull request: breaking changes, affected files and classes, risk and summary.

    The lists behind the counts are the tables ``breaking_changes``, ``affected_files`` and ``affected_classes``. A
    repository without an index gives an empty analysis.
    """
    # Read once and stored without the patches, which are most of it.
    removed = F.when(paths.is_impact_source(F.col("filename")), F.size(removed_methods(F.col("patch"))))
    read = cut_lineage(changes.select(*PR, "filename", removed.alias("removed")))
    source = read.where(F.col("removed").isNotNull())
    known = index["files"].select("repository", F.col("path").alias("filename"), F.explode("classes").alias("class"))
    in_file = source.join(known, ["repository", "filename"])
    none = F.lit(0).cast("bigint")
    row = lambda rows, breaking=none, files=none, classes=none: rows.select(
        *PR, breaking.cast("bigint").alias("breaking_changes"), files.cast("bigint").alias("affected_files"), classes.cast("bigint").alias("affected_classes")
    )
    own = in_file.groupBy(*PR, "class").agg(F.sum("removed").alias("n"))
    reach = _reach(source, index)
    parts = [
        row(source.select(*PR, "filename").distinct(), files=F.lit(1)),
        row(own, breaking=F.col("n"), classes=F.lit(1)),
        row(reach, files=F.col("affected_files"), classes=F.col("affected_classes")),
    ]
    # A pull request without a number has no analysis of its own.
    counted = reduce(DataFrame.unionByName, [part.where(F.col("pr_number").isNotNull()) for part in parts])
    counts = ["breaking_changes", "affected_files", "affected_classes"]
    joined = row(read.select(*PR).distinct()).unionByName(counted).groupBy(*PR).agg(*[F.sum(c).alias(c) for c in counts])
    indexed = index["files"].select("repository").distinct().withColumn("_indexed", F.lit(True))
    joined = joined.join(indexed, "repository", "left")
    known = F.col("_indexed").isNotNull()
    filled = joined.select(
        *PR, known.alias("_known"), *[F.when(known, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(c) for c in counts]
    )
    risk = risk_level(F.lit(0), F.col("breaking_changes"), F.col("affected_files"), 15)
    text = _sentence(
        [
            (F.col("breaking_changes"), "potential breaking changes detected"),
            (F.col("affected_files"), "files potentially affected"),
            (F.col("affected_classes"), "classes impacted"),
        ],
        F.col("risk_level"),
    )
    return filled.withColumn("risk_level", risk).select(
        *PR, *counts, "risk_level", F.when(F.col("_known"), text).otherwise(F.lit(NO_INDEX)).alias("summary")
    )


# Second variant ------------------------------------------------------------------------------------------------------


def removed_names(patch: Column) -> Column:
    """First called name on each removed line that says public."""
    return _all_names(patch, _REMOVED_NAME, "public", "(")


def _java_patch() -> Column:
    return F.col("filename").endswith(".java") & (F.col("patch") != "")


def breaking_changes_v2(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Findings on Java files the index knows: removed methods, changed signatures, removed classes."""
    known = files.select("repository", F.col("path").alias("filename"))
    finding = lambda kind, severity, text: F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), text.alias("description"), F.lit(SUGGESTIONS[kind]).alias("suggestion")
    )
    patch = F.col("patch")
    gone = F.transform(removed_names(patch), lambda n: finding("method-removed", "critical", F.format_string(REMOVED_V2, n)))
    moved = F.transform(modified_methods(patch), lambda n: finding("signature-changed", "high", F.format_string(CHANGED_V2, n)))
    dropped = F.when(
        F.col("status") == "removed",
        F.array(finding("class-removed", "critical", F.format_string(CLASS_V2, paths.class_of_file(F.col("filename"))))),
    )
    found = F.flatten(F.array_compact(F.array(gone, moved, dropped)))
    rows = changes.where(_java_patch()).select(*PR, "file_no", "filename", F.explode(each(found)).alias("f"))
    wanted = rows.join(known, ["repository", "filename"], "left_semi")
    return wanted.select(*PR, "file_no", F.col("filename").alias("file"), "f.*")


def _named(changes: DataFrame) -> DataFrame:
    """(repository, filename, name): changed files, each once, with the lower-cased class name it stands for. Stored."""
    listed = changes.select("repository", "filename").distinct()
    named = with_once(listed, "name", F.lower(paths.class_of_file(F.col("filename"))))
    return cut_lineage(named.where(F.col("name") != ""))


# Characters by which places of a path are looked up among the beginnings of names.
_START = 3


def _paths_with(names: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (repository, path, name) of ``files`` whose path contains a name (repository, name; distinct) of its repository.

    Joined on equality twice: places of a path with the beginnings of names, of which there are few, and what stands at the places
    left, cut to the lengths of names that begin so, with the names. No pair is tried that does not match.
    """
    names = cut_lineage(names)
    # Stored, so that its size is known and a small one is sent to the paths instead of the places to it.
    starts = cut_lineage(names.select("repository", F.substring("name", 1, _START).alias("_start"), F.length("name").alias("_length")).distinct())
    size = F.length("path")
    places = files.where(size > 0).select("repository", "path", F.explode(F.sequence(F.lit(1), size)).alias("_at"))
    places = places.select("*", F.explode(F.sequence(F.lit(1), F.lit(_START))).alias("_n")).where(F.col("_at") + F.col("_n") <= size + 1)
    begun = places.withColumn("_start", F.substring(F.col("path"), F.col("_at"), F.col("_n"))).join(starts, ["repository", "_start"])
    pieces = begun.where(F.col("_at") + F.col("_length") <= size + 1)
    pieces = pieces.select("repository", "path", F.substring(F.col("path"), F.col("_at"), F.col("_length")).alias("name"))
    return pieces.join(names, ["repository", "name"], "left_semi").select("repository", "path", "name").distinct()


def affected_files_v2(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose path contains the lower-cased class name of a changed file, other than that file."""
    named = _named(changes)
    met = _paths_with(named.select("repository", "name").distinct(), files)
    hit = named.join(met, ["repository", "name"]).where(F.col("path") != F.col("filename")).select("repository", "filename", "path")
    return changes.select(*PR, "filename").distinct().join(hit, ["repository", "filename"]).select(*PR, "path").distinct()


def affected_counts_v2(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, pr_number, affected_files) whose sums are the numbers of rows of ``affected_files_v2``, without its pairs.

    All paths with a name of the pull request are counted as in the first analysis, by sets of names and sets of paths. One too
    many is a changed file that has its own name in its path and no name of another changed file.
    """
    changes = changes.where(F.col("pr_number").isNotNull()).select(*PR, "filename")
    named = _named(changes)
    met = cut_lineage(_paths_with(named.select("repository", "name").distinct(), files))
    found = cut_lineage(named.join(met.select("repository", "name").distinct(), ["repository", "name"], "left_semi"))
    own = cut_lineage(changes.join(found, ["repository", "filename"]).distinct())
    users = met.select("repository", F.col("name").alias("class"), F.lit("file").alias("kind"), F.col("path").alias("name"))
    _, found = _union_sizes(own.select(*PR, F.col("name").alias("class")).distinct(), users)
    at = met.withColumnRenamed("path", "filename")
    mine = cut_lineage(own.join(at, ["repository", "name", "filename"], "left_semi").select(*PR, "filename"))
    ends = own.groupBy(*PR, "name").agg(F.min("filename").alias("_low"), F.max("filename").alias("_high"))
    others = mine.join(at, ["repository", "filename"]).join(ends, [*PR, "name"])
    others = others.where((F.col("_low") != F.col("filename")) | (F.col("_high") != F.col("filename")))
    alone = mine.join(others, [*PR, "filename"], "left_anti")
    return found.select(*PR, "affected_files").unionByName(alone.select(*PR, F.lit(-1).cast("bigint").alias("affected_files")))


def affected_classes_v2(changes: DataFrame, classes: DataFrame) -> DataFrame:
    """The class each changed file is named after, with the superclass and interfaces of that class."""
    named = changes.select(*PR, paths.class_of_file(F.col("filename")).alias("class")).where(F.col("class") != "")
    known = classes.select("repository", F.col("name").alias("class"), "dependencies")
    both = named.join(known, ["repository", "class"], "left")
    every = F.concat(F.array("class"), F.coalesce("dependencies", F.array().cast("array<string>")))
    return both.select(*PR, F.explode(every).alias("class")).distinct()


def methods_on_lines(patch: Column) -> Column:
    """Distinct names on any patch line, added, removed or context, that says public or protected."""
    return F.array_distinct(_all_names(patch, _OPEN_NAME, "("))


def affected_methods(changes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``methods_on_lines`` of each changed file, as distinct rows; ``keep`` names further columns."""
    return changes.select(*PR, *keep, F.explode(each(methods_on_lines(F.col("patch")))).alias("method")).distinct()


_ARTIFACT = r"<artifactId>(.*?)</artifactId>"


def packages_added(patch: Column) -> Column:
    """Packages on added lines of a manifest. Each line is tried against three formats; repeats stay."""
    group = lambda line, pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    def names(line: Column) -> Column:
        npm = group(line, r'"([^"]+)":\s*"[^"]+"')
        return F.array_compact(
            F.array(
                F.when(_has(line, "<dependency>", "<artifactId>"), group(line, _ARTIFACT)),
                F.when(_has(line, "implementation", "compile"), group(line, r"""['"]([^'"]+)['"]""")),
                F.when(_has(line, '"') & _has(line, ":") & ~npm.startswith("@"), npm),
            )
        )

    added = F.filter(lines_of(patch), lambda line: line.startswith("+"))
    return F.flatten(F.transform(added, names))


def packages_removed(patch: Column) -> Column:
    return _names(F.filter(lines_of(patch), lambda line: line.startswith("-") & _has(line, "<artifactId>")), _ARTIFACT)


def manifest_added(changes: DataFrame) -> DataFrame:
    rows = changes.where(F.col("filename").isin(MANIFESTS))
    return rows.select(*PR, "file_no", "filename", F.explode(each(packages_added(F.col("patch")))).alias("package"))


def manifest_removed(changes: DataFrame) -> DataFrame:
    rows = changes.where(F.col("filename").isin(MANIFESTS))
    return rows.select(*PR, "file_no", "filename", F.explode(each(packages_removed(F.col("patch")))).alias("package"))


def _read_v2(changes: DataFrame) -> DataFrame:
    """Changed files with the numbers of findings and packages in each, read in one pass. Patches end here."""
    patch = F.col("patch")
    count = lambda test, value: F.coalesce(F.when(test, value), F.lit(0)).cast("bigint")
    size = lambda values: F.size(each(values))
    in_manifest = F.col("filename").isin(MANIFESTS) & patch.isNotNull()
    dropped = F.when(F.col("status") == "removed", F.lit(1)).otherwise(F.lit(0))
    return changes.select(
        *PR, "filename", count(_java_patch(), F.size(removed_names(patch)) + dropped).alias("critical"),
        count(_java_patch(), F.size(modified_methods(patch))).alias("high"),
        count(in_manifest, size(packages_added(patch))).alias("added"), count(in_manifest, size(packages_removed(patch))).alias("removed"),
    )


def analyze_v2(changes: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Counts, risk and summary of the second variant, one row per pull request."""
    counts = ["critical", "high", "affected_files", "added", "removed"]
    read = cut_lineage(_read_v2(changes))
    known = index["files"].select("repository", F.col("path").alias("filename"))
    broken = read.where((F.col("critical") > 0) | (F.col("high") > 0)).select(*PR, "filename", "critical", "high")
    packages = read.where((F.col("added") > 0) | (F.col("removed") > 0)).select(*PR, "added", "removed")
    parts = [broken.join(known, ["repository", "filename"], "left_semi"), affected_counts_v2(read, index["files"]), packages]
    # A pull request without a repository or a number has no counts.
    named = F.col("repository").isNotNull() & F.col("pr_number").isNotNull()
    row = lambda rows: rows.select(*PR, *[(F.col(c) if c in rows.columns else F.lit(0)).cast("bigint").alias(c) for c in counts])
    counted = reduce(DataFrame.unionByName, [row(part.where(named)) for part in parts], row(read.select(*PR).distinct()))
    joined = counted.groupBy(*PR).agg(*[F.sum(c).alias(c) for c in counts])
    filled = joined.na.fill(0).withColumn("breaking_changes", F.col("critical") + F.col("high"))
    risk = risk_level(F.col("critical"), F.col("high"), F.col("affected_files"), 10)
    text = _sentence(
        [
            (F.col("breaking_changes"), "breaking changes detected"),
            (F.col("affected_files"), "files potentially affected"),
            (F.col("added"), "new dependencies added"),
            (F.col("removed"), "dependencies removed"),
        ],
        F.col("risk_level"),
    )
    return filled.withColumn("risk_level", risk).withColumn("summary", text)


def comment_summary(breaking: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """One comment per pull request with breaking changes: how many, and how many files use the classes hit."""
    where = index["classes"].select("repository", F.col("name").alias("dependent"), "path")
    users = dependents_of(index["edges"]).join(where, ["repository", "dependent"])
    users = users.select("repository", F.col("name").alias("class_name"), "path").distinct()
    changes = breaking.groupBy(*PR, "class_name", "method_name").agg(F.count(F.lit(1)).alias("n"))
    found = changes.groupBy(*PR).agg(F.count(F.lit(1)).alias("breaking_changes"))
    hit = changes.select(*PR, "class_name").distinct().join(users, ["repository", "class_name"])
    files = hit.select(*PR, "path").distinct().groupBy(*PR).agg(F.count(F.lit(1)).alias("affected_files"))
    joined = found.join(files, PR, "left").na.fill(0, ["affected_files"])
    body = F.format_string("Breaking changes: %d. Affected files to check before merging: %d", "breaking_changes", "affected_files")
    return joined.withColumn("body", body)
