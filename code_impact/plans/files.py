"""Queries over file listings and changed files."""

from pyspark.sql import functions as F

from code_impact.functions import paths
from code_impact.operators import files as ops
from code_impact.plans.registry import query
from code_impact.session import scratch_path
from code_impact.sources.code_files import scan_code_files as scan_code_files_of
from code_impact.sources.code_files import write_files

LANGUAGE = """CASE pos % 16 WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'go'
 WHEN 4 THEN 'dockerfile' WHEN 5 THEN 'json' WHEN 6 THEN 'maven' WHEN 8 THEN 'kotlin' WHEN 9 THEN 'java'
 WHEN 11 THEN 'rust' WHEN 12 THEN 'ruby' WHEN 14 THEN 'cpp' WHEN 15 THEN 'typescript' END"""
SOURCE = "pos % 16 IN (0, 1, 2, 3, 8, 9, 11, 12, 14, 15)"


@query("scan_code_files", "SELECT 'all' AS repository, repository || '/' || path AS path, (size % 100)::BIGINT AS size FROM file_listing WHERE pos % 9 <> 0 AND pos % 10 <> 0")
def scan_code_files(t):
    """The listing, written as files of up to 99 characters, the empty ones too, and scanned."""
    root = scratch_path(t.spark, "scanned")
    listed = t["file_listing"]
    write_files(listed.select(F.concat_ws("/", "repository", "path").alias("path"), F.repeat(F.lit("x"), (F.col("size") % 100).cast("int")).alias("content")), root)
    return scan_code_files_of(t.spark, root, "all").select("repository", "path", "size")


@query("detect_language", f"SELECT path, {LANGUAGE} AS language FROM file_listing")
def detect_language(t):
    return ops.with_language(t["file_listing"]).select("path", "language")


@query("source_files", f"SELECT path, {LANGUAGE} AS language FROM file_listing WHERE {SOURCE}")
def source_files(t):
    return ops.source_files(t["file_listing"]).select("path", "language")


@query("indexable_files", "SELECT path, 'java' AS language FROM file_listing WHERE pos % 16 IN (0, 9)")
def indexable_files(t):
    return ops.indexable_files(t["file_listing"], ["java"]).select("path", "language")


@query("language_stats", f"SELECT repository, {LANGUAGE} AS language, count(*) AS files FROM file_listing WHERE {SOURCE} GROUP BY 1, 2")
def language_stats(t):
    return ops.language_stats(t["file_listing"])


@query(
    "primary_language",
    f"""WITH c AS (SELECT repository, {LANGUAGE} AS language, count(*) AS n, min(pos) AS f FROM file_listing WHERE {SOURCE} GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, f) AS k FROM c)
    SELECT a.repository, r.language FROM (SELECT DISTINCT repository FROM file_listing) a
    LEFT JOIN r ON r.repository = a.repository AND r.k = 1""",
)
def primary_language(t):
    return ops.primary_language(t["file_listing"])


@query(
    "language_share",
    f"""SELECT a.repository, a.language, round(a.n * 100.0 / b.total, 2)::DOUBLE AS percent FROM
    (SELECT repository, {LANGUAGE} AS language, count(*) AS n FROM file_listing WHERE {SOURCE} GROUP BY 1, 2) a
    JOIN (SELECT repository, count(*) AS total FROM file_listing GROUP BY 1) b ON a.repository = b.repository""",
)
def language_share(t):
    return ops.language_share(t["file_listing"])


@query(
    "reviewable_files",
    """SELECT path, pos % 16 IN (0, 1, 2, 3, 5, 7, 9, 15) AS supported, (pos % 9 = 0 OR pos % 10 = 0 OR pos % 16 = 10) AS ignored,
    pos % 16 IN (0, 1, 2, 3, 5, 7, 9, 15) AND NOT (pos % 9 = 0 OR pos % 10 = 0 OR pos % 16 = 10) AS reviewable FROM file_listing""",
)
def reviewable_files(t):
    path = F.col("path")
    return t["file_listing"].select(
        "path",
        paths.is_review_supported(path).alias("supported"),
        paths.is_review_ignored(path).alias("ignored"),
        paths.is_reviewable(path).alias("reviewable"),
    )


@query("text_files", "SELECT path FROM file_listing WHERE pos % 16 IN (0, 1, 2, 3, 5, 6, 7, 9, 15)")
def text_files(t):
    return t["file_listing"].where(paths.is_text_file(F.col("path"))).select("path")


@query(
    "oversize_prs",
    """SELECT repository, pr_number, count(*) AS file_count, 50::BIGINT AS max_allowed FROM file_changes
    GROUP BY repository, pr_number HAVING count(*) > 50""",
)
def oversize_prs(t):
    return ops.oversize_prs(t.unnumbered("file_changes"))


@query(
    "oversize_files",
    "SELECT repository, path, round(size / 1048576.0, 2)::DOUBLE AS size_mb FROM file_sizes WHERE size > 10 * 1048576",
)
def oversize_files(t):
    return ops.oversize_files(t["file_sizes"])


@query(
    "review_strategies",
    """WITH k AS (SELECT * FROM review_paths WHERE pos % 11 <> 0 AND pos % 7 NOT IN (0, 1))
    SELECT repository, path, 'critical_files' AS rule FROM k WHERE pos % 5 IN (0, 3)
    UNION ALL SELECT repository, path, 'Security Review' FROM k WHERE pos % 5 IN (0, 3)
    UNION ALL SELECT repository, path, 'api_changes' FROM k WHERE pos % 5 = 1
    UNION ALL SELECT repository, path, 'API Review' FROM k WHERE pos % 5 = 1
    UNION ALL SELECT repository, path, 'business_logic' FROM k WHERE pos % 5 = 2""",
)
def review_strategies(t):
    return ops.review_strategies(t["review_paths"]).select("repository", "path", "rule")


@query(
    "group_changes_by_dir",
    """SELECT repository, CASE WHEN strpos(filename, '/') > 0 THEN regexp_extract(filename, '^(.*)/[^/]*$', 1) ELSE '' END AS dir,
    count(*) AS changes, count(DISTINCT filename) AS files, sum(additions)::BIGINT AS additions FROM file_changes GROUP BY 1, 2""",
)
def group_changes_by_dir(t):
    return ops.changes_by_dir(t.unnumbered("file_changes"))


CHANGE_COLUMNS = ["repository", "pr_number", "file_no", "filename", "status", "additions", "deletions", "patch", "previous_filename"]


@query(
    "file_changes_source",
    """SELECT repository, pr_number, file_no::BIGINT AS file_no, filename, status, additions, deletions, patch,
    CAST(NULL AS VARCHAR) AS previous_filename FROM file_changes WHERE file_no <= 100""",
)
def file_changes_source(t):
    page = ops.changes_page(t["file_changes"])
    return page.withColumn("file_no", F.col("file_no").cast("bigint")).select(CHANGE_COLUMNS)


@query(
    "pr_totals",
    """SELECT repository, pr_number, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions,
    count(*) FILTER (filename <> 'pom.xml') AS valid_files,
    coalesce(sum(additions) FILTER (filename <> 'pom.xml'), 0)::BIGINT AS valid_additions,
    coalesce(sum(deletions) FILTER (filename <> 'pom.xml'), 0)::BIGINT AS valid_deletions
    FROM file_changes GROUP BY repository, pr_number""",
)
def pr_totals(t):
    return ops.pr_totals(t.unnumbered("file_changes"))


@query(
    "normalise_pr_record",
    """SELECT o_orderkey + 1 AS number, 't' || o_orderkey AS title, CAST(NULL AS VARCHAR) AS body,
    CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN 7 ELSE 0 END AS user_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'u' || o_custkey ELSE 'unknown' END AS user_login,
    CASE o_orderkey % 3 WHEN 0 THEN 'Bot' ELSE 'User' END AS user_type,
    'abc' AS head_sha, CASE o_orderkey % 4 WHEN 0 THEN 'org/repo' || (o_custkey % 5) ELSE 'fork/n' END AS head_full_name,
    o_orderkey % 4 <> 0 AS head_private, CASE o_orderkey % 4 WHEN 0 THEN 'main' ELSE 'dev' END AS head_default_branch,
    CASE o_orderkey % 4 WHEN 0 THEN '' ELSE 'own' END AS head_owner, 9::BIGINT AS base_id,
    'org/repo' || (o_custkey % 5) AS base_full_name, 'main' AS base_default_branch, o_custkey % 9 AS changed_files
    FROM orders""",
)
def normalise_pr_record(t):
    return ops.normalise_pr_records(t["pr_records"]).select(
        "number", "title", "body", F.col("user.id").alias("user_id"), F.col("user.login").alias("user_login"),
        F.col("user.type").alias("user_type"), F.col("head.sha").alias("head_sha"),
        F.col("head.repo.full_name").alias("head_full_name"), F.col("head.repo.private").alias("head_private"),
        F.col("head.repo.default_branch").alias("head_default_branch"), F.col("head.repo.owner.login").alias("head_owner"),
        F.col("base.repo.id").alias("base_id"), F.col("base.repo.full_name").alias("base_full_name"),
        F.col("base.repo.default_branch").alias("base_default_branch"), "changed_files",
    )
