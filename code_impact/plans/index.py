"""Queries over index building, storage and incremental refresh."""

from pyspark.sql import functions as F

from code_impact.operators import index as ops
from code_impact.operators import graph, java, maintain
from code_impact.plans.java import PATH, REPO
from code_impact.plans.registry import query
from code_impact.session import scratch_path
from code_impact.sources import store

# Merged edges of ``code_files``: a field of the base type keeps the later ``extends``.
EDGES = f"""SELECT {REPO} AS repository, 'C' || p_partkey AS src, 'C' || (p_partkey % 50) AS dst, 'extends' AS type FROM part
 UNION ALL SELECT {REPO}, 'C' || p_partkey, 'I' || p_size, 'implements' FROM part
 UNION ALL SELECT {REPO}, 'C' || p_partkey, 'C' || ((p_partkey * 7 + 3) % 97), 'field_injection' FROM part WHERE (p_partkey * 7 + 3) % 97 <> p_partkey % 50"""

AS_OF = "2001-08-01"


@query(
    "build_index",
    f"""SELECT 'file' AS part, {REPO} AS repository, {PATH} AS key, 'C' || p_partkey AS detail FROM part
    UNION ALL SELECT 'class', {REPO}, 'C' || p_partkey, {PATH} FROM part
    UNION ALL SELECT 'edge', repository, src || ' -> ' || dst, type FROM ({EDGES}) e
    UNION ALL SELECT 'language', {REPO}, 'java', count(*)::VARCHAR FROM part GROUP BY 2""",
)
def build_index(t):
    files = t["code_files"]
    built = ops.build_index(files, t.types("code_files"))
    row = lambda df, part, key, detail: df.select(F.lit(part).alias("part"), "repository", key.alias("key"), detail.alias("detail"))
    parts = [
        row(built["files"], "file", F.col("path"), F.array_join("classes", ",")),
        row(built["classes"], "class", F.col("name"), F.col("path")),
        row(built["edges"], "edge", F.concat_ws(" -> ", "src", "dst"), F.col("type")),
        row(built["languages"], "language", F.col("language"), F.col("files").cast("string")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "merge_files",
    f"""SELECT {REPO} AS repository, {PATH} AS path, 'java' AS language, 'C' || p_partkey AS classes FROM part
    UNION ALL SELECT {REPO}, 'src/' || CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'main' END || '/S' || p_partkey || '.java', 'java',
    'S' || p_partkey || ',N' || p_partkey || ',P' || p_partkey FROM part""",
)
def merge_files(t):
    files = t["code_files"].unionByName(t["service_files"])
    types = t.types("code_files").unionByName(t.types("service_files"))
    merged = ops.merge_files(files, types)
    return merged.select("repository", "path", "language", F.array_join("classes", ",").alias("classes"))


COPIED = "(p_partkey % 10 = 4 AND p_partkey % 11 <> 0)"


@query(
    "merge_classes",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS name, CASE WHEN {COPIED} THEN 'zz/' ELSE '' END || {PATH} AS path,
    CASE WHEN {COPIED} THEN '' ELSE 'C' || (p_partkey % 50) || ',I' || p_size END AS dependencies FROM part""",
)
def merge_classes(t):
    merged = ops.merge_classes(t.types("code_files_copies"))
    return merged.select("repository", "name", "path", F.array_join("dependencies", ",").alias("dependencies"))


@query("merge_edges", EDGES)
def merge_edges(t):
    return ops.merge_edges(java.edges(t.types("code_files_copies"))).select("repository", "src", "dst", "type")


STATS = f"""SELECT f.repository, f.n AS total_files, f.n AS total_classes, e.n AS total_dependencies, 'java' AS languages
 FROM (SELECT {REPO} AS repository, count(*) AS n FROM part GROUP BY 1) f
 JOIN (SELECT repository, count(*) AS n FROM ({EDGES}) x GROUP BY 1) e ON e.repository = f.repository"""


@query("index_stats", STATS)
def index_stats(t):
    return ops.index_stats(t.index("code_files"))


@query("save_and_reload_index", STATS)
def save_and_reload_index(t):
    saved = store.IndexStore(t.spark, scratch_path(t.spark, "saved-index"))
    saved.save(t.index("code_files"), snapshot_date=AS_OF)
    return ops.index_stats(saved.load(snapshot_date=AS_OF))


@query(
    "validate_index",
    """SELECT o_orderkey AS doc_id, u.c AS failed_check FROM orders, LATERAL (SELECT unnest(CASE o_orderkey % 8
    WHEN 1 THEN ['repository'] WHEN 2 THEN ['repository_mismatch'] WHEN 3 THEN ['metadata'] WHEN 4 THEN ['index']
    WHEN 5 THEN ['index.dependencies', 'index.files'] WHEN 6 THEN ['index.files'] WHEN 7 THEN ['json'] ELSE [] END) AS c) u""",
)
def validate_index(t):
    return ops.validate_documents(t["index_documents"])


@query(
    "list_indexes",
    """SELECT 'org/repo' || n_nationkey AS repository,
    'org/repo' || n_nationkey IN (SELECT repository FROM index_snapshots) AS found FROM nation""",
)
def list_indexes(t):
    asked = t["nation"].select(F.concat(F.lit("org/repo"), F.col("n_nationkey").cast("string")).alias("repository"))
    return store.indexes_exist(t["index_snapshots"], asked)


@query(
    "expire_snapshots",
    f"""SELECT repository, snapshot_date, snapshot_date = newest AS is_current FROM
    (SELECT *, max(snapshot_date) OVER (PARTITION BY repository) AS newest FROM index_snapshots) s
    WHERE date_diff('day', snapshot_date, DATE '{AS_OF}') <= CASE WHEN snapshot_date = newest THEN 90 ELSE 30 END""",
)
def expire_snapshots(t):
    return store.kept_snapshots(t["index_snapshots"], AS_OF)


@query(
    "stage_artifacts",
    """SELECT repository, pr_number, md5(repository || '#' || pr_number) AS job_id,
    repository || '/' || pr_number || '/' || md5(repository || '#' || pr_number) || '/code.tar.gz' AS code_key,
    repository || '/' || pr_number || '/' || md5(repository || '#' || pr_number) || '/dependency-index.json' AS index_key
    FROM (SELECT DISTINCT repository, pr_number FROM file_changes) p""",
)
def stage_artifacts(t):
    prs = t["file_changes"].select("repository", "pr_number").distinct()
    jobs = prs.withColumn("job_id", F.md5(F.concat_ws("#", "repository", F.col("pr_number").cast("string"))))
    staged = store.stage_artifacts(jobs, scratch_path(t.spark, "artifacts"))
    return staged.select("repository", "pr_number", "job_id", "code_key", "index_key")


@query(
    "incremental_index",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS name,
    'C' || p_partkey || '(C' || ((p_partkey * 7 + 3) % 97) || ' dep),void ' || CASE WHEN p_partkey % 6 = 1 THEN 'n' ELSE 'm' END || p_size || '(Long id)' AS methods,
    CASE WHEN p_partkey % 6 = 1 THEN '' ELSE 'C' || (p_partkey % 50) || ',I' || p_size END AS dependencies FROM part WHERE p_partkey % 11 <> 0""",
)
def incremental_index(t):
    fresh = ops.incremental_types(t.types("code_files"), t.index("code_files")["files"], t["code_files_next"])
    return ops.merge_classes(fresh).select(
        "repository", "name", F.array_join(F.transform("methods", lambda m: m["signature"]), ",").alias("methods"),
        F.array_join("dependencies", ",").alias("dependencies"),
    )


# Of the next version, files of every sixth part have a class without a superclass or fields, and every eleventh file is gone.
NEXT = "(SELECT * FROM part WHERE p_partkey % 11 <> 0)"
EDGES_NEXT = EDGES.replace("FROM part", "FROM (SELECT * FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 6 <> 1)")
LINKS_NEXT = f"""SELECT DISTINCT e.repository, s.path AS user_path, d.path AS used_path FROM ({EDGES_NEXT}) e
 JOIN (SELECT {REPO} AS repository, 'C' || p_partkey AS name, {PATH} AS path FROM {NEXT}) s ON s.repository = e.repository AND s.name = e.src
 JOIN (SELECT {REPO} AS repository, 'C' || p_partkey AS name, {PATH} AS path FROM {NEXT}) d ON d.repository = e.repository AND d.name = e.dst"""


def _refreshed(t):
    """The index of the next version, made from the stored one by the files that differ; once per application."""
    path = t.once("refreshed-index", lambda at: store.IndexStore(t.spark, at).save(maintain.refresh_index(t.index("code_files"), t.types("code_files"), t["code_files_next"])[0]))
    return store.IndexStore(t.spark, path).load()


@query(
    "incremental_tables",
    f"""SELECT 'file' AS part, {REPO} AS repository, {PATH} AS key, 'C' || p_partkey AS detail FROM {NEXT}
    UNION ALL SELECT 'class', {REPO}, 'C' || p_partkey, {PATH} FROM {NEXT}
    UNION ALL SELECT 'method', {REPO}, 'C' || p_partkey, 'C' || p_partkey || '(C' || ((p_partkey * 7 + 3) % 97) || ' dep)' FROM {NEXT}
    UNION ALL SELECT 'method', {REPO}, 'C' || p_partkey, 'void ' || CASE WHEN p_partkey % 6 = 1 THEN 'n' ELSE 'm' END || p_size || '(Long id)' FROM {NEXT}
    UNION ALL SELECT 'edge', repository, src || ' -> ' || dst, type FROM ({EDGES_NEXT}) e""",
)
def incremental_tables(t):
    index = _refreshed(t)
    row = lambda part, key, detail: index[{"class": "classes"}.get(part, part + "s")].select(F.lit(part).alias("part"), "repository", key.alias("key"), detail.alias("detail"))
    parts = [row("class", F.col("name"), F.col("path")), row("method", F.col("class"), F.col("signature")), row("edge", F.concat_ws(" -> ", "src", "dst"), F.col("type"))]
    found = row("file", F.col("path"), F.array_join("classes", ","))
    for part in parts:
        found = found.unionByName(part)
    return found


@query("incremental_reverse_index", f"SELECT repository, used_path AS path, user_path AS used_by FROM ({LINKS_NEXT}) l")
def incremental_reverse_index(t):
    old = t.index("code_files")
    support, _ = maintain.refresh_links(t.stored("link-support", lambda: maintain.link_support(old)), old, _refreshed(t))
    return support.select("repository", F.col("used").alias("path"), F.col("user").alias("used_by"))


@query(
    "incremental_closure",
    f"""WITH RECURSIVE e AS ({EDGES_NEXT}),
    r(repository, start, affected) AS (
      SELECT DISTINCT e.repository, e.dst, e.src FROM e JOIN (SELECT DISTINCT repository, dst FROM e WHERE type = 'extends') s ON s.repository = e.repository AND s.dst = e.dst
      UNION SELECT r.repository, r.start, e.src FROM r JOIN e ON e.repository = r.repository AND e.dst = r.affected)
    SELECT repository, start, affected FROM r""",
)
def incremental_closure(t):
    links = lambda edges: edges.select("repository", F.col("dst").alias("used"), F.col("src").alias("user"))
    starts = lambda edges: edges.where(F.col("type") == "extends").select("repository", F.col("dst").alias("start")).distinct()
    old, new = t.index("code_files")["edges"], _refreshed(t)["edges"]
    before = t.stored("closure", lambda: graph.reached(links(old), starts(old)))
    return maintain.refresh_closure(before, starts(new), links(old), links(new))
