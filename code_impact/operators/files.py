"""Filters, counts and totals over file listings and changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from code_impact.functions import paths
from code_impact.functions.arrays import each, with_once

# Review rules. The first three look for a fragment in the path, the others are globs.
FRAGMENT_RULES = {
    "critical_files": ["auth", "payment", "db"],
    "api_changes": ["controller"],
    "business_logic": ["service"],
}
GLOB_RULES = {
    "Security Review": ["**/auth/**", "**/payment/**"],
    "API Review": ["**/controller/**"],
}
IGNORE_GLOBS = ["*.test.ts", "*.spec.ts", "migrations/*"]

FILES_PER_PAGE = 100


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", paths.detect_language(F.col("path")))


def source_files(files: DataFrame) -> DataFrame:
    return with_language(files).where(paths.is_source(F.col("language")))


def indexable_files(files: DataFrame, languages: list[str]) -> DataFrame:
    """Source files of the languages that have an extraction strategy."""
    return source_files(files).where(F.col("language").isin(languages))


def language_stats(files: DataFrame) -> DataFrame:
    return source_files(files).groupBy("repository", "language").agg(F.count(F.lit(1)).alias("files"))


def primary_language(files: DataFrame) -> DataFrame:
    """Most frequent source language; on a tie the one seen first. Repositories without source files get null."""
    counts = source_files(files).groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("repository").agg(F.max_by("language", F.struct(F.col("n"), -F.col("first"))).alias("language"))
    return files.select("repository").distinct().join(best, "repository", "left")


def language_share(files: DataFrame) -> DataFrame:
    """Share of each language among all files of the repository, in percent, two decimals."""
    total = files.groupBy("repository").agg(F.count(F.lit(1)).alias("total"))
    part = language_stats(files)
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("files") / F.col("total") * 100, 2))
    return part.join(total, "repository").select("repository", "language", share.alias("percent"))


def oversize_prs(changes: DataFrame, limit: int = paths.MAX_FILES_PER_PR) -> DataFrame:
    counted = changes.groupBy("repository", "pr_number").agg(F.count(F.lit(1)).alias("file_count"))
    return counted.where(F.col("file_count") > limit).withColumn("max_allowed", F.lit(limit).cast("bigint"))


def oversize_files(files: DataFrame, limit_mb: int = paths.MAX_FILE_MB) -> DataFrame:
    mb = F.col("size") / F.lit(1024 * 1024)
    return files.where(mb > limit_mb).select("repository", "path", F.round(mb, 2).alias("size_mb"))


def review_strategies(changes: DataFrame) -> DataFrame:
    """One row per file and matching rule; files under an ignore glob give none."""
    path = F.col("path")
    tests = []
    for name, fragments in FRAGMENT_RULES.items():
        tests.append((name, path.rlike("|".join(fragments))))
    for name, globs in GLOB_RULES.items():
        tests.append((name, path.rlike("|".join(paths.glob_to_regex(g) for g in globs))))
    ignored = path.rlike("|".join(paths.glob_to_regex(g) for g in IGNORE_GLOBS))
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return changes.where(~ignored).withColumn("rule", F.explode(each(names)))


def changes_by_dir(changes: DataFrame) -> DataFrame:
    """Changed files grouped by folder. Totals instead of member lists, so a folder may hold any number of changes."""
    folder = F.when(F.contains("filename", F.lit("/")), F.regexp_extract("filename", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    return (
        changes.withColumn("dir", folder)
        .groupBy("repository", "dir", "filename")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("additions").alias("additions"))
        .groupBy("repository", "dir")
        .agg(F.sum("n").alias("changes"), F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"))
    )


def changes_page(changes: DataFrame, page: int = FILES_PER_PAGE) -> DataFrame:
    """The first page of files of each pull request, as the code host lists them."""
    order = Window.partitionBy("repository", "pr_number").orderBy("file_no")
    kept = changes.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= page).drop("_rn")
    if "previous_filename" not in kept.columns:
        kept = kept.withColumn("previous_filename", F.lit(None).cast("string"))
    return kept


def pr_totals(changes: DataFrame) -> DataFrame:
    """Files, additions and deletions per pull request, over all files and over the reviewable ones."""
    valid = paths.is_reviewable(F.col("filename"))
    return changes.groupBy("repository", "pr_number").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.count_if(valid).alias("valid_files"),
        F.coalesce(F.sum(F.when(valid, F.col("additions"))), F.lit(0)).alias("valid_additions"),
        F.coalesce(F.sum(F.when(valid, F.col("deletions"))), F.lit(0)).alias("valid_deletions"),
    )


_USER = "struct<id:bigint,login:string,avatar_url:string,html_url:string,type:string>"
_REPO = (
    "struct<id:bigint,name:string,full_name:string,private:boolean,html_url:string,clone_url:string,ssh_url:string,"
    f"owner:{_USER},default_branch:string>"
)
PR_SCHEMA = (
    f"number bigint, title string, body string, state string, html_url string, user {_USER}, "
    f"head struct<sha:string,ref:string,repo:{_REPO}>, base struct<sha:string,ref:string,repo:{_REPO}>, "
    "changed_files bigint, additions bigint, deletions bigint"
)


def _or(value, default):
    """The value unless it is null or empty."""
    if isinstance(default, str):
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
    return F.coalesce(value, F.lit(default))


def _user(user):
    return F.struct(
        _or(user["id"], 0).cast("bigint").alias("id"),
        _or(user["login"], "unknown").alias("login"),
        _or(user["avatar_url"], "").alias("avatar_url"),
        _or(user["html_url"], "").alias("html_url"),
        _or(user["type"], "User").alias("type"),
    )


def _owner(user):
    return _user(user).withField("login", _or(user["login"], ""))


def _side(side, repository):
    repo = side["repo"]
    return F.struct(
        side["sha"].alias("sha"),
        side["ref"].alias("ref"),
        F.struct(
            _or(repo["id"], 0).cast("bigint").alias("id"),
            _or(repo["name"], "").alias("name"),
            F.coalesce(F.nullif(repo["full_name"], F.lit("")), repository).alias("full_name"),
            _or(repo["private"], False).alias("private"),
            _or(repo["html_url"], "").alias("html_url"),
            _or(repo["clone_url"], "").alias("clone_url"),
            _or(repo["ssh_url"], "").alias("ssh_url"),
            _owner(repo["owner"]).alias("owner"),
            _or(repo["default_branch"], "main").alias("default_branch"),
        ).alias("repo"),
    )


def normalise_pr_records(records: DataFrame) -> DataFrame:
    """Raw pull-request JSON (``repository``, ``record``) to one typed record with defaults filled in."""
    pr = F.col("_pr")
    parsed = with_once(records, "_pr", F.from_json("record", PR_SCHEMA))
    return parsed.select(
        "repository",
        *[pr[f].alias(f) for f in ("number", "title", "body", "state", "html_url")],
        _user(pr["user"]).alias("user"),
        _side(pr["head"], F.col("repository")).alias("head"),
        _side(pr["base"], F.col("repository")).alias("base"),
        *[pr[f].alias(f) for f in ("changed_files", "additions", "deletions")],
    )
