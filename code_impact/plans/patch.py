"""Queries over pull-request patches and the flagship analysis."""

from pyspark.sql import functions as F

from code_impact.operators import graph
from code_impact.operators import patch as ops
from code_impact.plans.graph import CLASSES, LAYERED
from code_impact.plans.index import EDGES
from code_impact.plans.registry import query

# Kinds of patches by the columns they are generated from: supplier key in ``s``, read back from the text.
LINES = """SELECT repository, pr_number, file_no::BIGINT AS file_no, filename, status, u.line, u.i FROM file_changes,
 LATERAL (SELECT unnest(string_split(patch, chr(10))) AS line, generate_subscripts(string_split(patch, chr(10)), 1) AS i) u WHERE patch IS NOT NULL"""


def _no(df):
    return df.withColumn("file_no", F.col("file_no").cast("bigint"))


@query(
    "removed_lines",
    f"SELECT repository, pr_number, file_no, filename, substr(line, 2) AS line FROM ({LINES}) l WHERE line LIKE '-%' AND line NOT LIKE '---%'",
)
def removed_lines(t):
    return _no(ops.removed_lines(t["file_changes"])).drop("pos")


@query(
    "modified_signatures",
    f"""SELECT repository, pr_number, file_no, filename, regexp_extract(line, 'm[0-9]+', 0) AS method FROM
    (SELECT *, lead(line) OVER (PARTITION BY repository, pr_number, file_no ORDER BY i) AS next FROM ({LINES}) l) x
    WHERE line LIKE '-    public void m%' AND next LIKE '+    public void m%'""",
)
def modified_signatures(t):
    return _no(ops.modified_signatures(t["file_changes"]))


@query(
    "diff_line_map",
    """WITH c AS (SELECT repository, pr_number, file_no::BIGINT AS file_no, CASE WHEN filename = 'pom.xml' THEN 0 WHEN patch LIKE '%(String id)%' THEN 1
      WHEN patch LIKE '%gone%' THEN 2 ELSE 3 END AS kind FROM file_changes WHERE patch IS NOT NULL),
    m(kind, diff_line, file_line) AS (VALUES (0, 1, NULL), (0, 2, 1), (1, 1, 8), (1, 2, NULL), (1, 3, 9), (2, 1, NULL), (2, 2, 8), (3, 1, 1), (3, 2, 2))
    SELECT c.repository, c.pr_number, c.file_no, m.diff_line, m.file_line FROM c JOIN m ON m.kind = c.kind""",
)
def diff_line_map(t):
    return _no(ops.diff_line_map(t["file_changes"]))


PUBLIC = f"""SELECT repository, pr_number, file_no, filename, regexp_extract(line, '(\\w+)\\s*\\(', 1) AS method FROM ({LINES}) l
 WHERE line LIKE '-%' AND line NOT LIKE '---%' AND line LIKE '%public%' AND filename LIKE '%.java'"""
BREAKING = f"""SELECT p.repository, p.pr_number, p.file_no, 'method-removed' AS type, 'high' AS severity, c.name AS class_name, p.method AS method_name,
 'Public method ''' || p.method || ''' was removed from ' || c.name AS description, c.path AS file
 FROM ({PUBLIC}) p JOIN ({CLASSES}) c ON c.repository = p.repository AND c.path = p.filename"""


@query("pr_breaking_changes", BREAKING)
def pr_breaking_changes(t):
    return _no(ops.breaking_changes(t["file_changes"], t.index("code_files")))


OWN = f"""SELECT DISTINCT f.repository, f.pr_number, c.name FROM file_changes f JOIN ({CLASSES}) c ON c.repository = f.repository AND c.path = f.filename"""
DEPENDENTS = f"""SELECT DISTINCT o.repository, o.pr_number, e.src FROM ({OWN}) o JOIN ({EDGES}) e ON e.repository = o.repository AND e.dst = o.name"""
AFFECTED_CLASSES = f"SELECT repository, pr_number, name AS class FROM ({OWN}) a UNION SELECT repository, pr_number, src FROM ({DEPENDENTS}) b"
AFFECTED_FILES = f"""SELECT repository, pr_number, filename AS path FROM file_changes WHERE filename LIKE '%.java'
 UNION SELECT d.repository, d.pr_number, c.path FROM ({DEPENDENTS}) d JOIN ({CLASSES}) c ON c.repository = d.repository AND c.name = d.src"""


@query("pr_affected_classes", AFFECTED_CLASSES)
def pr_affected_classes(t):
    return ops.affected_classes(t["file_changes"], t.index("code_files"))


@query("pr_affected_files", AFFECTED_FILES)
def pr_affected_files(t):
    return ops.affected_files(t["file_changes"], t.index("code_files"))


ANALYSIS = f"""WITH p AS (SELECT DISTINCT repository, pr_number FROM file_changes),
 b AS (SELECT repository, pr_number, count(*) AS n FROM ({BREAKING}) x GROUP BY 1, 2),
 f AS (SELECT repository, pr_number, count(*) AS n FROM ({AFFECTED_FILES}) x GROUP BY 1, 2),
 c AS (SELECT repository, pr_number, count(*) AS n FROM ({AFFECTED_CLASSES}) x GROUP BY 1, 2),
 j AS (SELECT p.repository, p.pr_number, coalesce(b.n, 0)::BIGINT AS breaking_changes, coalesce(f.n, 0)::BIGINT AS affected_files, coalesce(c.n, 0)::BIGINT AS affected_classes
  FROM p LEFT JOIN b ON b.repository = p.repository AND b.pr_number = p.pr_number
  LEFT JOIN f ON f.repository = p.repository AND f.pr_number = p.pr_number LEFT JOIN c ON c.repository = p.repository AND c.pr_number = p.pr_number),
 k AS (SELECT *, CASE WHEN breaking_changes >= 3 OR affected_files > 15 THEN 'high' WHEN breaking_changes > 0 OR affected_files > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM j),
 z AS (SELECT *, concat_ws('. ', CASE WHEN breaking_changes > 0 THEN breaking_changes || ' potential breaking changes detected' END,
  CASE WHEN affected_files > 0 THEN affected_files || ' files potentially affected' END,
  CASE WHEN affected_classes > 0 THEN affected_classes || ' classes impacted' END, 'Risk level: ' || risk_level) AS summary FROM k)"""


@query("analyze_pr", f"{ANALYSIS} SELECT repository, pr_number, breaking_changes, affected_files, affected_classes, risk_level, summary FROM z")
def analyze_pr(t):
    return ops.analyze(t["file_changes"], t.index("code_files"))


@query("pr_risk", f"{ANALYSIS} SELECT repository, pr_number, risk_level FROM z")
def pr_risk(t):
    return ops.analyze(t["file_changes"], t.index("code_files")).select("repository", "pr_number", "risk_level")


V2 = f"""SELECT p.repository, p.pr_number, p.file_no, p.filename AS file, 'method-removed' AS type, 'critical' AS severity,
  'Public method ''' || p.method || ''' was removed' AS description, 'Consider deprecating the method first before removal' AS suggestion FROM ({PUBLIC}) p
 UNION ALL SELECT repository, pr_number, file_no, filename, 'signature-changed', 'high', 'Method signature changed: ' || regexp_extract(line, 'm[0-9]+', 0), 'Ensure all callers are updated'
  FROM ({LINES}) l WHERE line LIKE '-    public void m%'
 UNION ALL SELECT repository, pr_number, file_no::BIGINT, filename, 'class-removed', 'critical', 'Class ''' || regexp_extract(filename, '(C[0-9]+)[.]java', 1) || ''' was removed', 'Check all references to this class'
  FROM file_changes WHERE status = 'removed' AND patch IS NOT NULL AND filename LIKE '%.java'"""


@query("pr_breaking_v2", V2)
def pr_breaking_v2(t):
    return _no(ops.breaking_changes_v2(t["file_changes"], t.index("code_files")["files"]))


@query(
    "pr_affected_classes_v2",
    f"""SELECT repository, pr_number, regexp_replace(regexp_replace(filename, '^.*/', ''), '[.]java$', '') AS class FROM file_changes
    UNION SELECT o.repository, o.pr_number, 'C' || (c.p_partkey % 50) FROM ({OWN}) o JOIN ({CLASSES}) c ON c.repository = o.repository AND c.name = o.name
    UNION SELECT o.repository, o.pr_number, 'I' || c.p_size FROM ({OWN}) o JOIN ({CLASSES}) c ON c.repository = o.repository AND c.name = o.name""",
)
def pr_affected_classes_v2(t):
    return ops.affected_classes_v2(t.unnumbered("file_changes"), t.index("code_files")["classes"])


NAMED = """SELECT DISTINCT repository, pr_number, filename, lower(regexp_replace(regexp_replace(filename, '^.*/', ''), '[.]java$', '')) AS name FROM layered_changes"""
HIT_V2 = f"""SELECT DISTINCT n.repository, n.pr_number, f.path FROM ({NAMED}) n
 JOIN layered_files f ON f.repository = n.repository AND f.path <> n.filename AND contains(f.path, n.name)"""


@query("pr_affected_files_v2", HIT_V2)
def pr_affected_files_v2(t):
    return ops.affected_files_v2(t.unnumbered("layered_changes"), t.index("layered_files")["files"])


@query(
    "pr_affected_methods",
    f"""SELECT DISTINCT repository, pr_number, regexp_extract(line, '(\\w+)\\s*\\(', 1) AS method FROM ({LINES}) l WHERE line LIKE '%public%'""",
)
def pr_affected_methods(t):
    return ops.affected_methods(t["file_changes"])


@query(
    "manifest_added",
    f"""SELECT repository, pr_number, file_no, filename, regexp_extract(line, 'new[0-9]+', 0) AS package FROM ({LINES}) l WHERE line LIKE '+<artifactId>%'
    UNION ALL SELECT repository, pr_number, file_no::BIGINT, filename, 'p' || additions FROM manifest_changes WHERE additions % 3 = 0
    UNION ALL SELECT repository, pr_number, file_no::BIGINT, filename, 'g:a:' || additions FROM manifest_changes WHERE additions % 3 = 1""",
)
def manifest_added(t):
    return _no(ops.manifest_added(t["file_changes"].unionByName(t["manifest_changes"])))


@query(
    "manifest_removed",
    f"SELECT repository, pr_number, file_no, filename, regexp_extract(line, 'old[0-9]+', 0) AS package FROM ({LINES}) l WHERE line LIKE '-<artifactId>%'",
)
def manifest_removed(t):
    return _no(ops.manifest_removed(t["file_changes"].unionByName(t["manifest_changes"])))


ANALYSIS_V2 = f"""WITH {LAYERED}, p AS (SELECT DISTINCT repository, pr_number FROM layered_changes),
 w AS (SELECT repository, pr_number, filename, status, u.line FROM layered_changes, LATERAL (SELECT unnest(string_split(patch, chr(10))) AS line) u WHERE patch IS NOT NULL),
 b AS (SELECT repository, pr_number, count(*) FILTER (line LIKE '-    public%') AS crit, count(*) FILTER (line LIKE '-    public void m%') AS high FROM w GROUP BY 1, 2),
 r AS (SELECT repository, pr_number, count(*) AS n FROM layered_changes WHERE status = 'removed' AND patch IS NOT NULL AND filename LIKE '%.java' GROUP BY 1, 2),
 f AS (SELECT repository, pr_number, count(*) AS n FROM ({HIT_V2}) h GROUP BY 1, 2),
 a AS (SELECT repository, pr_number, count(*) FILTER (line LIKE '+<artifactId>%') AS added, count(*) FILTER (line LIKE '-<artifactId>%') AS removed FROM w GROUP BY 1, 2),
 j AS (SELECT p.repository, p.pr_number, coalesce(b.crit, 0) + coalesce(r.n, 0) AS critical, coalesce(b.high, 0) AS high, coalesce(f.n, 0) AS files, coalesce(a.added, 0) AS added, coalesce(a.removed, 0) AS removed
  FROM p LEFT JOIN b ON b.repository = p.repository AND b.pr_number = p.pr_number LEFT JOIN r ON r.repository = p.repository AND r.pr_number = p.pr_number
  LEFT JOIN f ON f.repository = p.repository AND f.pr_number = p.pr_number LEFT JOIN a ON a.repository = p.repository AND a.pr_number = p.pr_number),
 z AS (SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high >= 3 OR files > 10 THEN 'high' WHEN high > 0 OR files > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM j)"""


@query("pr_risk_v2", f"{ANALYSIS_V2} SELECT repository, pr_number, risk_level FROM z")
def pr_risk_v2(t):
    return ops.analyze_v2(t.unnumbered("layered_changes"), t.index("layered_files")).select("repository", "pr_number", "risk_level")


@query(
    "pr_summary",
    f"""{ANALYSIS_V2} SELECT repository, pr_number, concat_ws('. ', CASE WHEN critical + high > 0 THEN (critical + high) || ' breaking changes detected' END,
    CASE WHEN files > 0 THEN files || ' files potentially affected' END, CASE WHEN added > 0 THEN added || ' new dependencies added' END,
    CASE WHEN removed > 0 THEN removed || ' dependencies removed' END, 'Risk level: ' || risk_level) AS summary FROM z""",
)
def pr_summary(t):
    return ops.analyze_v2(t.unnumbered("layered_changes"), t.index("layered_files")).select("repository", "pr_number", "summary")


@query(
    "pr_comment_summary",
    f"""WITH b AS ({BREAKING}), c AS ({CLASSES}), e AS ({EDGES}),
    u AS (SELECT DISTINCT e.repository, e.dst, c.path FROM e JOIN c ON c.repository = e.repository AND c.name = e.src)
    SELECT b.repository, b.pr_number, count(DISTINCT b.class_name || chr(9) || b.method_name) AS breaking_changes, count(DISTINCT u.path) AS affected_files,
    'Breaking changes: ' || count(DISTINCT b.class_name || chr(9) || b.method_name) || '. Affected files to check before merging: ' || count(DISTINCT u.path) AS body
    FROM b LEFT JOIN u ON u.repository = b.repository AND u.dst = b.class_name GROUP BY 1, 2""",
)
def pr_comment_summary(t):
    index = t.index("code_files")
    return ops.comment_summary(ops.breaking_changes(t["file_changes"], index), index)


@query(
    "impact_by_kind",
    f"""WITH {LAYERED}, o AS (SELECT DISTINCT a.repository, a.pr_number, lc.name FROM layered_changes a JOIN lc ON lc.repository = a.repository AND lc.path = a.filename),
    f AS (SELECT repository, pr_number, filename AS path FROM layered_changes WHERE filename LIKE '%.java'
      UNION SELECT o.repository, o.pr_number, le.user_path FROM o JOIN le ON le.repository = o.repository AND le.dst = o.name)
    SELECT repository, pr_number, count(*) AS affected_files, {", ".join(f"count(*) FILTER (path LIKE '%{k}%') AS affected_{k}" for k in graph.KINDS)}
    FROM f GROUP BY 1, 2""",
)
def impact_by_kind(t):
    return graph.affected_by_kind(ops.affected_files(t["layered_changes"], t.index("layered_files")))
