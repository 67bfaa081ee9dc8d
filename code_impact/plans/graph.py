"""Queries over the class graph."""

from pyspark.sql import functions as F

from code_impact.functions import paths
from code_impact.operators import diff, graph, java
from code_impact.plans.diff import CHANGED, GONE, REMOVED
from code_impact.plans.index import EDGES
from code_impact.plans.java import PATH, REPO
from code_impact.plans.registry import query

CLASSES = f"SELECT {REPO} AS repository, 'C' || p_partkey AS name, {PATH} AS path, p_partkey, p_size FROM part"
# Class names of the changed Java files.
ASKED = "SELECT DISTINCT repository, regexp_extract(filename, '(C[0-9]+)[.]java', 1) AS name FROM file_changes WHERE filename LIKE '%.java'"


def _asked(t):
    java_only = t["file_changes"].where(F.col("filename").endswith(".java"))
    return java_only.select("repository", paths.class_of_file(F.col("filename")).alias("name")).distinct()


@query("find_class", f"SELECT c.repository, c.name, c.path, 'class' AS kind FROM ({CLASSES}) c JOIN ({ASKED}) a ON a.repository = c.repository AND a.name = c.name")
def find_class(t):
    return graph.find_class(t.index("code_files")["classes"], _asked(t)).select("repository", "name", "path", "kind")


@query(
    "find_dependents",
    f"SELECT a.repository, a.name, e.src AS dependent FROM ({EDGES}) e JOIN ({ASKED}) a ON a.repository = e.repository AND a.name = e.dst",
)
def find_dependents(t):
    return graph.find_dependents(t.index("code_files")["edges"], _asked(t))


@query(
    "find_dependencies",
    f"""SELECT c.repository, c.name, u.dependency FROM ({CLASSES}) c JOIN ({ASKED}) a ON a.repository = c.repository AND a.name = c.name,
    LATERAL (SELECT unnest(['C' || (c.p_partkey % 50), 'I' || c.p_size]) AS dependency) u""",
)
def find_dependencies(t):
    return graph.find_dependencies(t.index("code_files")["classes"], _asked(t))


@query(
    "methods_in_class",
    f"""SELECT c.repository, c.name AS class, u.signature FROM ({CLASSES}) c JOIN ({ASKED}) a ON a.repository = c.repository AND a.name = c.name,
    LATERAL (SELECT unnest(['C' || c.p_partkey || '(C' || ((c.p_partkey * 7 + 3) % 97) || ' dep)', 'void m' || c.p_size || '(Long id)']) AS signature) u""",
)
def methods_in_class(t):
    return graph.methods_in_class(t.index("code_files")["methods"], _asked(t)).select("repository", "class", "signature")


@query("files_by_language", f"SELECT {REPO} AS repository, {PATH} AS path FROM part")
def files_by_language(t):
    return graph.files_by_language(t.index("code_files")["files"], "java")


@query(
    "classes_in_file",
    f"""SELECT a.repository, a.filename AS path, c.name AS class FROM (SELECT DISTINCT repository, filename FROM file_changes) a
    LEFT JOIN ({CLASSES}) c ON c.repository = a.repository AND c.path = a.filename""",
)
def classes_in_file(t):
    asked = t["file_changes"].select("repository", F.col("filename").alias("path"))
    return graph.classes_in_file(t.index("code_files")["files"], asked)


@query(
    "analyze_impact",
    f"""WITH e AS ({EDGES}), c AS ({CLASSES}),
    l1 AS (SELECT DISTINCT repository, dst AS name, src AS dependent FROM e),
    l2 AS (SELECT DISTINCT a.repository, a.name, b.dependent FROM l1 a JOIN l1 b ON b.repository = a.repository AND b.name = a.dependent),
    f AS (SELECT x.repository, x.name, count(DISTINCT c.path) AS n FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) x
      JOIN c ON c.repository = x.repository AND c.name = x.dependent GROUP BY 1, 2)
    SELECT c.repository, c.name, coalesce(a.n, 0)::BIGINT AS direct_dependents, coalesce(f.n, 0)::BIGINT AS affected_files,
    (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS total_impact FROM c
    LEFT JOIN (SELECT repository, name, count(*) AS n FROM l1 GROUP BY 1, 2) a ON a.repository = c.repository AND a.name = c.name
    LEFT JOIN (SELECT repository, name, count(*) AS n FROM l2 GROUP BY 1, 2) b ON b.repository = c.repository AND b.name = c.name
    LEFT JOIN f ON f.repository = c.repository AND f.name = c.name""",
)
def analyze_impact(t):
    index = t.index("code_files")
    return graph.analyze_impact(index["edges"], index["classes"], index["classes"])


@query(
    "transitive_dependents",
    f"""WITH RECURSIVE e AS ({EDGES}),
    r(repository, start, affected) AS (
      SELECT DISTINCT e.repository, e.dst, e.src FROM e JOIN (SELECT DISTINCT repository, dst FROM e WHERE type = 'extends') s ON s.repository = e.repository AND s.dst = e.dst
      UNION SELECT r.repository, r.start, e.src FROM r JOIN e ON e.repository = r.repository AND e.dst = r.affected)
    SELECT repository, start, affected FROM r""",
)
def transitive_dependents(t):
    edges = t.index("code_files")["edges"]
    bases = edges.where(F.col("type") == "extends").select("repository", F.col("dst").alias("name")).distinct()
    return graph.transitive_dependents(edges, bases)


LINKS = f"""SELECT DISTINCT e.repository, s.path AS user_path, d.path AS used_path FROM ({EDGES}) e
 JOIN ({CLASSES}) s ON s.repository = e.repository AND s.name = e.src JOIN ({CLASSES}) d ON d.repository = e.repository AND d.name = e.dst"""


@query("reverse_index", f"SELECT repository, used_path AS path, user_path AS used_by FROM ({LINKS}) l")
def reverse_index(t):
    return graph.reverse_index(t.index("code_files"))


@query(
    "second_level_deps",
    f"""WITH l AS ({LINKS}), p AS (SELECT DISTINCT repository, pr_number, filename AS path FROM file_changes),
    f AS (SELECT DISTINCT p.repository, p.pr_number, l.used_path AS path FROM p JOIN l ON l.repository = p.repository AND l.user_path = p.path),
    f1 AS (SELECT * FROM f WHERE (repository, pr_number, path) NOT IN (SELECT repository, pr_number, path FROM p)),
    s AS (SELECT DISTINCT f1.repository, f1.pr_number, l.used_path AS path FROM f1 JOIN l ON l.repository = f1.repository AND l.user_path = f1.path),
    s1 AS (SELECT * FROM s WHERE (repository, pr_number, path) NOT IN (SELECT repository, pr_number, path FROM p UNION ALL SELECT repository, pr_number, path FROM f1)),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY repository, pr_number ORDER BY path) AS rn FROM s1)
    SELECT repository, pr_number, path, 1 AS level FROM f1 UNION ALL SELECT repository, pr_number, path, 2 FROM s2 WHERE rn <= 10""",
)
def second_level_deps(t):
    return graph.second_level_dependencies(t.index("code_files"), t["file_changes"])


@query(
    "first_dependents",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY repository, used_path ORDER BY user_path) AS rank FROM ({LINKS}) x)
    SELECT a.repository, a.pr_number, a.filename, l.user_path AS dependent, l.rank FROM (SELECT DISTINCT repository, pr_number, filename FROM file_changes) a
    JOIN l ON l.repository = a.repository AND l.used_path = a.filename WHERE l.rank <= 3""",
)
def first_dependents(t):
    found = graph.first_dependents(t.index("code_files"), t.unnumbered("file_changes"))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "impact_radius",
    f"""WITH l AS ({LINKS}), d AS (SELECT repository, used_path, count(*) AS n FROM l GROUP BY 1, 2),
    i AS (SELECT l.repository, l.used_path, sum(coalesce(d.n, 0))::BIGINT AS n FROM l LEFT JOIN d ON d.repository = l.repository AND d.used_path = l.user_path GROUP BY 1, 2)
    SELECT a.repository, a.filename AS path, coalesce(d.n, 0)::BIGINT AS direct_impact, coalesce(i.n, 0)::BIGINT AS indirect_impact
    FROM (SELECT DISTINCT repository, filename FROM file_changes) a
    LEFT JOIN d ON d.repository = a.repository AND d.used_path = a.filename LEFT JOIN i ON i.repository = a.repository AND i.used_path = a.filename""",
)
def impact_radius(t):
    return graph.impact_radius(t.index("code_files"), t["file_changes"])


LAYERED = """lc AS (SELECT repository, 'C' || k AS name, 'C' || (k % 50) AS base, 'C' || ((k * 7 + 3) % 97) AS dep, path FROM
  (SELECT repository, path, regexp_extract(path, 'C([0-9]+)[.]java', 1)::BIGINT AS k FROM layered_files) x),
 le AS (SELECT repository, name AS src, path AS user_path, base AS dst FROM lc UNION SELECT repository, name, path, dep FROM lc),
 ll AS (SELECT DISTINCT le.repository, le.user_path, lc.path AS used_path FROM le JOIN lc ON lc.repository = le.repository AND lc.name = le.dst)"""
WEIGHT = """CASE WHEN path LIKE 'src/service/%' THEN 2.0 WHEN path LIKE 'src/controller/%' THEN 1.8 WHEN path LIKE 'src/repository/%' THEN 1.6
 WHEN path LIKE 'src/model/%' THEN 1.5 WHEN path LIKE 'src/dto/%' THEN 1.4 WHEN path LIKE 'src/entity/%' THEN 1.4
 WHEN path LIKE 'src/test/%' THEN 0.3 ELSE 0.4 END::DOUBLE"""


@query(
    "related_files_ranked",
    f"""WITH RECURSIVE {LAYERED},
    p AS (SELECT DISTINCT a.repository, a.pr_number, a.filename FROM layered_changes a JOIN lc ON lc.repository = a.repository AND lc.path = a.filename),
    r(repository, start, path) AS (SELECT repository, used_path, user_path FROM ll
      UNION SELECT r.repository, r.start, ll.user_path FROM r JOIN ll ON ll.repository = r.repository AND ll.used_path = r.path),
    c AS (SELECT p.repository, p.pr_number, ll.used_path AS path, 1.0 AS f FROM p JOIN ll ON ll.repository = p.repository AND ll.user_path = p.filename
      UNION ALL SELECT p.repository, p.pr_number, r.path, 0.7 FROM p JOIN r ON r.repository = p.repository AND r.start = p.filename),
    m AS (SELECT repository, pr_number, path, max({WEIGHT} * f::DOUBLE) AS priority FROM c GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY repository, pr_number ORDER BY round(priority, 9) DESC, path) AS rank FROM m)
    SELECT repository, pr_number, path, round(priority, 4) AS priority, rank FROM k WHERE rank <= 10""",
)
def related_files_ranked(t):
    found = graph.related_files(t.index("layered_files"), t["layered_changes"])
    return found.select("repository", "pr_number", "path", F.round("priority", 4).alias("priority"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "context_budget",
    f"""WITH RECURSIVE {LAYERED},
    p AS (SELECT DISTINCT a.repository, a.pr_number, a.filename FROM layered_changes a JOIN lc ON lc.repository = a.repository AND lc.path = a.filename),
    r(repository, start, path) AS (SELECT repository, used_path, user_path FROM ll
      UNION SELECT r.repository, r.start, ll.user_path FROM r JOIN ll ON ll.repository = r.repository AND ll.used_path = r.path),
    c AS (SELECT p.repository, p.pr_number, ll.used_path AS path, 1.0 AS f FROM p JOIN ll ON ll.repository = p.repository AND ll.user_path = p.filename
      UNION ALL SELECT p.repository, p.pr_number, r.path, 0.7 FROM p JOIN r ON r.repository = p.repository AND r.start = p.filename),
    m AS (SELECT repository, pr_number, path, max({WEIGHT} * f::DOUBLE) AS priority FROM c GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY repository, pr_number ORDER BY round(priority, 9) DESC, path) AS rank FROM m),
    b AS (SELECT k.repository, k.pr_number, k.path, k.rank, length(f.content) AS n
      FROM k JOIN layered_files f ON f.repository = k.repository AND f.path = k.path WHERE k.rank <= 10),
    w AS (SELECT *, sum(n) OVER (PARTITION BY repository, pr_number) AS total,
      coalesce(sum(n) OVER (PARTITION BY repository, pr_number ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
    SELECT repository, pr_number, path, rank, (CASE WHEN total <= 160 THEN n ELSE least(n, 160 - before) END)::BIGINT AS kept_chars
    FROM w WHERE total <= 160 OR (rank <= 5 AND before < 160)""",
)
def context_budget(t):
    found = graph.related_files(t.index("layered_files"), t["layered_changes"])
    lengths = t["layered_files"].select("repository", "path", F.length("content").alias("length"))
    kept = graph.within_token_budget(found.join(lengths, ["repository", "path"]), 40, keep=5)
    return kept.select("repository", "pr_number", "path", F.col("rank").cast("bigint").alias("rank"), "kept_chars")


@query(
    "breaking_with_impact",
    f"""WITH b AS ({REMOVED} UNION ALL {GONE} UNION ALL {CHANGED}), e AS ({EDGES}), c AS ({CLASSES}),
    u AS (SELECT e.repository, e.dst, count(DISTINCT c.path) AS n FROM e JOIN c ON c.repository = e.repository AND c.name = e.src GROUP BY 1, 2)
    SELECT b.repository, b.type, b.class, b.method, coalesce(u.n, 0)::BIGINT AS affected_files FROM b
    LEFT JOIN u ON u.repository = b.repository AND u.dst = b.class""",
)
def breaking_with_impact(t):
    breaking = diff.breaking_changes(t.types("code_files"), t.types("code_files_v2"))
    return graph.breaking_with_impact(breaking, t.index("code_files")).select("repository", "type", "class", "method", "affected_files")


@query(
    "import_dependents",
    f"""SELECT a.repository, a.pr_number, c.path, 'Imports ' || a.name AS reason, 1::BIGINT AS score FROM
    (SELECT DISTINCT repository, pr_number, regexp_extract(filename, '(C[0-9]+)[.]java', 1) AS name FROM file_changes WHERE filename LIKE '%.java') a
    JOIN ({CLASSES}) c ON c.repository = a.repository AND a.name = 'C' || (c.p_partkey % 50)""",
)
def import_dependents(t):
    imports = java.java_imports(t["code_files"])
    changes = t["file_changes"].where(F.col("filename").endswith(".java"))
    return graph.import_dependents(imports, changes, paths.class_of_file(F.col("filename")))
