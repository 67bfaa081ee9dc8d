"""Queries over package manifests."""

from pyspark.sql import functions as F

from code_impact.operators import manifests as ops
from code_impact.plans.registry import query

NPM = """SELECT p_partkey AS project_id, 'express' AS name, '^4.' || p_size || '.0' AS version, 'dependency' AS type, 'web-framework' AS category FROM part
 UNION ALL SELECT p_partkey, 'lib' || (p_partkey % 30), '0.' || p_size || '.1', 'dependency', 'library' FROM part
 UNION ALL SELECT p_partkey, 'jest', '^29.0.0', 'devDependency', 'testing' FROM part"""


def _npm(t):
    return ops.npm_packages(t["manifests"])


@query("npm_packages", f"SELECT *, 'package.json' AS file_path, true AS is_direct FROM ({NPM}) n")
def npm_packages(t):
    return _npm(t)


@query(
    "npm_lock",
    """SELECT p_partkey AS project_id, 'express' AS name, '4.' || p_size || '.2' AS version, 'sha512-e' AS integrity, p_partkey % 3 = 0 AS is_direct, false AS is_dev, false AS is_optional,
     CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'accepts' END AS dependencies FROM part
    UNION ALL SELECT p_partkey, 'jest', '29.1.0', NULL, p_partkey % 3 = 0, true, false, '' FROM part
    UNION ALL SELECT p_partkey, 'tools/x', '0.0.1', NULL, true, false, true, '' FROM part WHERE p_partkey % 3 <> 0""",
)
def npm_lock(t):
    return ops.npm_lock(t["lock_files"]).withColumn("dependencies", F.array_join("dependencies", ",")).drop("depth")


@query(
    "enrich_lock",
    f"""SELECT project_id, name, version, CASE name WHEN 'express' THEN '4.' || p_size || '.2' WHEN 'jest' THEN '29.1.0' END AS resolved_version,
    CASE name WHEN 'express' THEN 'sha512-e' END AS integrity FROM ({NPM}) n JOIN part ON p_partkey = project_id""",
)
def enrich_lock(t):
    return ops.enrich_lock(_npm(t), ops.npm_lock(t["lock_files"])).select("project_id", "name", "version", "resolved_version", "integrity")


@query(
    "pip_packages",
    """SELECT p_partkey AS project_id, 'django' AS name, '>=' || p_size || '.0' AS version FROM part UNION ALL SELECT p_partkey, 'requests', '*' FROM part
    UNION ALL SELECT p_partkey, 'lib' || (p_partkey % 30), '==1.0' FROM part UNION ALL SELECT p_partkey, 'celery', '==5.0' FROM part""",
)
def pip_packages(t):
    return ops.pip_packages(t["requirements_files"]).select("project_id", "name", "version")


@query(
    "pipfile_packages",
    """SELECT p_partkey AS project_id, 'flask' AS name, '*' AS version, 'dependency' AS type FROM part UNION ALL SELECT p_partkey, 'lib' || (p_partkey % 30), p_size || '.0', 'dependency' FROM part
    UNION ALL SELECT p_partkey, 'pytest', '*', 'devDependency' FROM part UNION ALL SELECT p_partkey, 'pinned', '==2.0', 'dependency' FROM part""",
)
def pipfile_packages(t):
    return ops.pipfile_packages(t["pipfiles"]).drop("file_path")


@query(
    "poetry_packages",
    """SELECT p_partkey AS project_id, 'python' AS name, '^3.' || (p_size % 12) AS version, 'languageVersion' AS type, NULL::VARCHAR AS extra FROM part
    UNION ALL SELECT p_partkey, 'numpy', '>=1.' || p_size, 'dependency', NULL FROM part UNION ALL SELECT p_partkey, 'black', '*', 'devDependency', NULL FROM part
    UNION ALL SELECT p_partkey, 'sphinx', '*', 'optionalDependency', 'docs' FROM part UNION ALL SELECT p_partkey, 'lib' || (p_partkey % 30), '*', 'optionalDependency', 'docs' FROM part""",
)
def poetry_packages(t):
    return ops.poetry_packages(t["poetry_files"]).drop("file_path")


@query(
    "maven_packages",
    """SELECT p_partkey AS project_id, 'org.g:lib' || (p_partkey % 30) AS name, p_size || '.1' AS version, 'dependency' AS type, false AS optional FROM part
    UNION ALL SELECT p_partkey, 'junit:junit', '4.12', 'testDependency', false FROM part UNION ALL SELECT p_partkey, 'com.google:guava', '*', 'dependency', true FROM part""",
)
def maven_packages(t):
    return ops.maven_packages(t["pom_files"]).drop("file_path")


@query(
    "gradle_packages",
    """SELECT p_partkey AS project_id, 'org.g:lib' || (p_partkey % 30) AS name, p_size || '.0' AS version, 'dependency' AS type, 'implementation' AS scope FROM part
    UNION ALL SELECT p_partkey, 'com.google:guava', '*', 'dependency', 'api' FROM part UNION ALL SELECT p_partkey, 'junit:junit', '4.12', 'testDependency', 'testImplementation' FROM part""",
)
def gradle_packages(t):
    return ops.gradle_packages(t["gradle_files"]).drop("file_path")


@query(
    "go_packages",
    """SELECT p_partkey AS project_id, u.n AS name, u.v AS version, u.d AS is_direct, CASE WHEN u.d THEN 'dependency' ELSE 'indirectDependency' END AS type, 'example.com/m' || p_partkey AS module, '1.' || (p_size % 22) AS go_version
    FROM part, LATERAL (SELECT * FROM (VALUES ('github.com/single/one', 'v0.1.0', true), ('github.com/spf13/cobra', 'v1.' || p_size || '.0', true), ('golang.org/x/crypto', 'v0.1.0', false)) x(n, v, d)) u""",
)
def go_packages(t):
    return ops.go_packages(t["go_files"]).drop("file_path")


@query(
    "csproj_packages",
    """SELECT p_partkey AS project_id, 'Newtonsoft.Json' AS name, '13.' || p_size AS version FROM part UNION ALL SELECT p_partkey, 'Lib' || (p_partkey % 30), '*' FROM part""",
)
def csproj_packages(t):
    return ops.csproj_packages(t["csproj_files"]).select("project_id", "name", "version")


@query(
    "detect_manager",
    """SELECT 'org/r' || p_partkey AS repository, CASE p_partkey % 6 WHEN 0 THEN 'poetry' WHEN 1 THEN 'pipenv' ELSE 'pip' END AS manager,
    CASE WHEN p_partkey % 6 = 3 OR p_partkey % 5 IN (1, 3) THEN 'javascript' WHEN p_partkey % 6 IN (0, 2) OR p_partkey % 5 = 0 THEN 'python' WHEN p_partkey % 6 = 4 THEN 'java'
     WHEN p_partkey % 5 = 4 THEN 'go' WHEN p_partkey % 6 = 5 THEN 'csharp' ELSE 'unknown' END AS language FROM part""",
)
def detect_manager(t):
    return ops.detect_manager(t["project_paths"])


@query(
    "monorepos",
    """SELECT 'org/r' || p_partkey AS repository, p_partkey % 5 IN (1, 2) OR p_partkey % 4 IN (0, 1, 2) AS is_monorepo,
    CASE WHEN p_partkey % 5 = 1 AND p_partkey % 4 IN (1, 2) THEN 'packages/a' WHEN p_partkey % 5 = 3 AND p_partkey % 4 = 1 THEN 'mods/b' END AS folder FROM part""",
)
def monorepos(t):
    paths, roots = t["project_paths"], t["root_manifests"]
    return ops.monorepos(paths, roots).join(ops.sub_projects(paths, roots), "repository", "left")


ENRICHED = f"""SELECT n.*, r.description, r.license, coalesce(r.is_deprecated, false) AS is_deprecated FROM ({NPM}) n LEFT JOIN registry r ON r.name = n.name"""


@query("enrich_registry", f"SELECT project_id, name, version, description, license, is_deprecated FROM ({ENRICHED}) e")
def enrich_registry(t):
    found = ops.enrich_registry(_npm(t), t["registry"])
    return found.select("project_id", "name", "version", "description", "license", "is_deprecated")


@query(
    "categorise_packages",
    """SELECT project_id, name, CASE project_id % 12 WHEN 0 THEN 'framework' WHEN 1 THEN 'web-framework' WHEN 2 THEN 'web-framework' WHEN 3 THEN 'web-framework' WHEN 4 THEN 'testing' WHEN 5 THEN 'data-science'
     WHEN 6 THEN 'testing' WHEN 7 THEN 'cli' ELSE 'library' END AS category,
    CASE project_id % 12 WHEN 0 THEN 'web-framework' WHEN 4 THEN 'testing' WHEN 6 THEN 'testing' WHEN 9 THEN 'database' WHEN 10 THEN 'cloud' ELSE 'library' END AS generic_category FROM package_names""",
)
def categorise_packages(t):
    return ops.categorise(t["package_names"]).select("project_id", "name", "category", "generic_category")


LICENSE = "CASE license WHEN 'MIT' THEN 'permissive' WHEN 'Apache-2.0' THEN 'permissive' WHEN 'LGPL-3.0' THEN 'weak-copyleft' WHEN 'GPL-3.0' THEN 'copyleft' ELSE 'unknown' END"


@query("license_class", f"SELECT project_id, name, {LICENSE} AS license_class FROM ({ENRICHED}) e")
def license_class(t):
    return ops.enrich_registry(_npm(t), t["registry"]).select("project_id", "name", ops.license_class(F.col("license")).alias("license_class"))


@query(
    "package_risk",
    f"""SELECT e.project_id, e.name, CASE WHEN e.version LIKE '0.%' OR e.is_deprecated THEN 'high' WHEN TIMESTAMP '2001-08-01' - o.o_orderdate > INTERVAL 365 DAY THEN 'medium' ELSE 'low' END AS breaking_risk
    FROM ({ENRICHED}) e LEFT JOIN orders o ON o.o_orderkey = e.project_id""",
)
def package_risk(t):
    published = t["orders"].select(F.col("o_orderkey").alias("project_id"), "o_orderdate")
    found = ops.enrich_registry(_npm(t), t["registry"]).join(published, "project_id", "left")
    risk = ops.breaking_risk(F.col("version"), F.col("is_deprecated"), F.col("o_orderdate"), "2001-08-01")
    return found.select("project_id", "name", risk.alias("breaking_risk"))


SECURED = f"""SELECT n.project_id, n.name, n.version, count(v.cve_id) AS vulnerabilities, count(*) FILTER (v.severity = 'critical') AS critical, count(*) FILTER (v.severity = 'high') AS high
 FROM ({NPM}) n JOIN part ON p_partkey = n.project_id
 LEFT JOIN vulnerabilities_ranged v ON v.package = n.name AND CASE v.kind WHEN 0 THEN true WHEN 1 THEN p_size > v.bound ELSE p_size < v.bound END GROUP BY 1, 2, 3"""


def _secured(t):
    return ops.package_security(_npm(t), t["vulnerabilities_ranged"])


@query(
    "package_security",
    f"""SELECT project_id, name, version, vulnerabilities, critical, high, CASE WHEN critical > 0 THEN 'high' WHEN high > 0 THEN 'medium' WHEN vulnerabilities > 0 THEN 'low' ELSE 'none' END AS security_risk FROM ({SECURED}) s""",
)
def package_security(t):
    return _secured(t).select("project_id", "name", "version", "vulnerabilities", "critical", "high", "security_risk")


@query(
    "security_summary",
    f"""SELECT project_id, count(*) FILTER (vulnerabilities > 0) AS vulnerable_packages, sum(vulnerabilities)::BIGINT AS total_vulnerabilities, sum(critical)::BIGINT AS critical_count FROM ({SECURED}) s GROUP BY 1""",
)
def security_summary(t):
    return ops.security_summary(_secured(t))


@query(
    "package_tags",
    f"""SELECT project_id, name, 'javascript,' || category || ',' || type || ',npm' || CASE WHEN is_deprecated THEN ',deprecated' ELSE '' END AS tags FROM ({ENRICHED}) e""",
)
def package_tags(t):
    found = ops.enrich_registry(_npm(t), t["registry"])
    tags = ops.package_tags([F.lit("javascript"), F.col("category"), F.col("type"), F.lit("npm")], {"deprecated": F.col("is_deprecated")})
    return found.select("project_id", "name", F.array_join(tags, ",").alias("tags"))


@query("package_ids", f"SELECT project_id, name, md5(name || '-' || version || '-' || type) AS id, 'javascript-' || name || '-' || version AS language_id FROM ({NPM}) n")
def package_ids(t):
    return _npm(t).select("project_id", "name", ops.package_id().alias("id"), F.concat_ws("-", F.lit("javascript"), "name", "version").alias("language_id"))


@query(
    "package_documents",
    f"""SELECT project_id, name, concat_ws(' ', name, description, category, type) AS document, concat_ws(' ', 'javascript package ' || name, description, category, 'version ' || version) AS embedding_document FROM ({ENRICHED}) e""",
)
def package_documents(t):
    found = ops.enrich_registry(_npm(t), t["registry"])
    plain = ops.search_document([F.col("name"), F.col("description"), F.col("category"), F.col("type")])
    titled = ops.search_document(
        [F.concat(F.lit("javascript package "), F.col("name")), F.col("description"), F.col("category"), F.concat(F.lit("version "), F.col("version"))]
    )
    return found.select("project_id", "name", plain.alias("document"), titled.alias("embedding_document"))


@query(
    "package_metadata",
    f"""SELECT md5(e.name || '-' || e.version || '-' || e.type) AS id, e.name, e.version, e.type, e.category, 'javascript' AS language, coalesce(e.license, 'unknown') AS license, 'app' || e.project_id AS repository,
    'package.json' AS file_path, true AS is_direct, e.is_deprecated, s.vulnerabilities > 0 AS has_vulnerabilities, s.vulnerabilities AS vulnerability_count, 0::BIGINT AS download_count
    FROM ({ENRICHED}) e JOIN ({SECURED}) s ON s.project_id = e.project_id AND s.name = e.name AND s.version = e.version""",
)
def package_metadata(t):
    found = ops.enrich_registry(_secured(t), t["registry"]).withColumn("language", F.lit("javascript")).withColumn("download_count", F.lit(None).cast("bigint"))
    return ops.metadata(found, F.concat(F.lit("app"), F.col("project_id").cast("string"))).withColumn("download_count", F.col("download_count").cast("bigint"))
