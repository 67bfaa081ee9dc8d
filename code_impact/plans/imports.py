"""Queries over imports and exports of other languages."""

from pyspark.sql import functions as F

from code_impact.operators import diff
from code_impact.operators import imports as ops
from code_impact.operators import index as indexes
from code_impact.operators import manifests, patch
from code_impact.operators.strategies import EVERY
from code_impact.plans.registry import query
from code_impact.sources.store import IndexStore

JSREPO = "'org/js' || (p_partkey % 5)"
JSPATH = "'src/m/f' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '/index.ts' ELSE '.ts' END"
TARGET = "'src/m/f' || (p_partkey % 50) || CASE WHEN (p_partkey % 50) % 7 = 0 THEN '/index.ts' ELSE '.ts' END"


def _js_imports(t):
    return ops.js_imports(t["manifests"])


@query(
    "js_imports",
    """SELECT p_partkey AS project_id, 'require' AS kind, 'express' AS module FROM part UNION ALL SELECT p_partkey, 'static', 'lib' || (p_partkey % 31) || '/sub' FROM part
    UNION ALL SELECT p_partkey, 'static', './local' FROM part UNION ALL SELECT p_partkey + 1000000000, 'dynamic', '@scope/pkg/sub' FROM part
    UNION ALL SELECT p_partkey + 1000000000, 'static', 'lodash/fp' FROM part UNION ALL SELECT p_partkey + 1000000000, 'static', './nowhere/x' || (p_partkey % 3) FROM part
    UNION ALL SELECT p_partkey + 1000000000, 'static', CASE WHEN p_partkey % 7 = 0 THEN '../f' ELSE './f' END || (p_partkey % 50) FROM part""",
)
def js_imports(t):
    number = F.regexp_extract("path", "f([0-9]+)", 1).cast("bigint") + 1000000000
    modules = t["js_modules"].select(number.alias("project_id"), F.col("content").alias("source"))
    return ops.js_imports(t["manifests"].select("project_id", "source").unionByName(modules))


@query(
    "js_package_names",
    """SELECT DISTINCT 'express' AS module, 'express' AS package FROM part UNION SELECT DISTINCT 'lib' || (p_partkey % 31) || '/sub', 'lib' || (p_partkey % 31) FROM part
    UNION SELECT DISTINCT './local', NULL FROM part UNION SELECT DISTINCT '@scope/pkg/sub', '@scope/pkg' FROM part UNION SELECT DISTINCT 'lodash/fp', 'lodash' FROM part
    UNION SELECT DISTINCT './nowhere/x' || (p_partkey % 3), NULL FROM part UNION SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN '../f' ELSE './f' END || (p_partkey % 50), NULL FROM part""",
)
def js_package_names(t):
    return js_imports(t).select("module", ops.package_of_import(F.col("module")).alias("package")).distinct()


@query(
    "js_exports",
    f"""SELECT {JSREPO} AS repository, {JSPATH} AS path, 'class' AS kind, 'A' || p_partkey AS name FROM part
    UNION ALL SELECT {JSREPO}, {JSPATH}, 'function', 'run' || p_partkey FROM part UNION ALL SELECT {JSREPO}, {JSPATH}, 'const', 'c' || p_partkey FROM part""",
)
def js_exports(t):
    return ops.js_exports(t["js_modules"])


def _resolved(t):
    files = t["js_modules"]
    return ops.resolve_imports(ops.named_imports(files), files)


@query(
    "resolve_imports",
    f"""SELECT {JSREPO} AS repository, {JSPATH} AS path, CASE WHEN p_partkey % 7 = 0 THEN '../f' ELSE './f' END || (p_partkey % 50) AS module, {TARGET} AS resolved FROM part
    UNION ALL SELECT {JSREPO}, {JSPATH}, './nowhere/x' || (p_partkey % 3), CASE WHEN p_partkey % 7 = 0 THEN 'src/m/f' || p_partkey || '/' ELSE 'src/m/' END || 'nowhere/x' || (p_partkey % 3) FROM part""",
)
def resolve_imports(t):
    return _resolved(t).select("repository", "path", "module", "resolved")


@query(
    "referenced_items",
    f"SELECT {JSREPO} AS repository, {TARGET} AS path, {JSPATH} AS importer, 'A' || (p_partkey % 50) AS name, 'class' AS kind FROM part",
)
def referenced_items(t):
    return ops.referenced_items(_resolved(t), ops.js_exports(t["js_modules"]))


@query(
    "diff_removed_exports",
    f"SELECT {JSREPO} AS repository, {JSPATH} AS path, 'c' || p_partkey AS name FROM part WHERE p_partkey % 10 = 4 AND p_partkey % 7 <> 0",
)
def diff_removed_exports(t):
    return diff.removed_exports(ops.js_exports(t["js_modules"]), ops.js_exports(t["js_modules_v2"]))


PY = """SELECT p_partkey AS project_id, 'import' AS kind, 'os' AS module FROM part UNION ALL SELECT p_partkey, 'import', 'numpy' FROM part UNION ALL SELECT p_partkey, 'import', 'sys' FROM part
 UNION ALL SELECT p_partkey, 'from', 'pkg' || (p_partkey % 5) FROM part UNION ALL SELECT p_partkey, 'from', '' FROM part"""


@query("py_imports", PY)
def py_imports(t):
    return ops.py_imports(t["py_sources"])


@query("py_stdlib_imports", f"SELECT * FROM ({PY}) p WHERE module IN ('os', 'sys')")
def py_stdlib_imports(t):
    return ops.py_stdlib_imports(ops.py_imports(t["py_sources"]))


@query(
    "py_public_api",
    """SELECT p_partkey AS project_id, 'app/m' || p_partkey || '.py' AS path, 'function' AS kind, 'pub' || p_partkey AS name FROM part
    UNION ALL SELECT p_partkey, 'app/m' || p_partkey || '.py', 'class', 'Pub' || p_partkey FROM part UNION ALL SELECT p_partkey, 'app/m' || p_partkey || '.py', 'class', '_Hidden' FROM part""",
)
def py_public_api(t):
    return ops.py_public_api(t["py_sources"])


@query(
    "unused_packages",
    """SELECT p_partkey AS project_id, 'jest' AS name FROM part UNION ALL SELECT p_partkey, 'lib' || (p_partkey % 30) FROM part WHERE p_partkey % 30 <> p_partkey % 31""",
)
def unused_packages(t):
    return ops.unused_packages(manifests.npm_packages(t["manifests"]), _js_imports(t))


@query("missing_packages", "SELECT p_partkey AS project_id, 'lib' || (p_partkey % 31) AS name FROM part WHERE p_partkey % 30 <> p_partkey % 31")
def missing_packages(t):
    return ops.missing_packages(manifests.npm_packages(t["manifests"]), _js_imports(t))


def _module_index(t):
    """The index of the JavaScript modules, built once per application."""
    path = t.once("module-index", lambda at: IndexStore(t.spark, at).save(indexes.build_index(t["js_modules"], strategies=EVERY)))
    return IndexStore(t.spark, path).load()


@query(
    "module_index",
    f"""WITH m AS (SELECT {JSREPO} AS repository, {JSPATH} AS path, 'src/m/f' || p_partkey AS module, p_partkey AS p FROM part)
    SELECT 'file' AS part, repository, path AS key, module || ',A' || p AS detail FROM m
    UNION ALL SELECT 'class', repository, module, path FROM m UNION ALL SELECT 'class', repository, 'A' || p, path FROM m
    UNION ALL SELECT 'method', repository, module, 'run' || p || '()' FROM m
    UNION ALL SELECT 'edge', repository, module || ' -> src/m/f' || (p % 50), 'A' || (p % 50) || ',missing' FROM m
    UNION ALL SELECT 'edge', repository, module || ' -> ' || CASE WHEN p % 7 = 0 THEN module || '/' ELSE 'src/m/' END || 'nowhere/x' || (p % 3), 'gone' FROM m""",
)
def module_index(t):
    index = _module_index(t)
    row = lambda part, table, key, detail: index[table].select(F.lit(part).alias("part"), "repository", key.alias("key"), detail.alias("detail"))
    return (
        row("file", "files", F.col("path"), F.array_join("classes", ","))
        .unionByName(row("class", "classes", F.col("name"), F.col("path")))
        .unionByName(row("method", "methods", F.col("class"), F.col("signature")))
        .unionByName(row("edge", "edges", F.concat_ws(" -> ", "src", "dst"), F.array_join("usage", ",")))
    )


@query(
    "analyze_pr_modules",
    """WITH c AS (SELECT repository, pr_number, CAST(regexp_extract(filename, 'f([0-9]+)', 1) AS BIGINT) AS q FROM js_changes),
    n AS (SELECT c.repository, c.pr_number, count(p.p_partkey) AS n FROM c LEFT JOIN part p ON p.p_partkey % 50 = c.q AND p.p_partkey <> c.q GROUP BY 1, 2)
    SELECT repository, pr_number, 0::BIGINT AS breaking_changes, (1 + n)::BIGINT AS affected_files, (2 + n)::BIGINT AS affected_classes,
    CASE WHEN 1 + n > 15 THEN 'high' WHEN 1 + n > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM n""",
)
def analyze_pr_modules(t):
    return patch.analyze(t["js_changes"], _module_index(t)).drop("summary")
