"""Imports and exports of JavaScript, TypeScript and Python sources, by pattern, inside each file's own row."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions.arrays import each

# Suffixes tried for a relative import, in this order, then again for ``index`` in a folder.
TRIED_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".json"]

_QUOTED = r"""['"`]([^'"`]+)['"`]"""
_JS = {
    "static": rf"import\s+.*?\s+from\s+{_QUOTED}",
    "dynamic": rf"import\s*\(\s*{_QUOTED}\s*\)",
    "require": rf"require\s*\(\s*{_QUOTED}\s*\)",
}
_PY = {"import": r"(?m)^import[ \t]+([^\n#;]+)", "from": r"(?m)^from\s+([^\s]+)\s+import"}
_EXPORT = r"export\s+(?:default\s+)?(class|function|interface|const|let|var)\s+(\w+)"
_NAMED_IMPORT = r"""import\s+\{([^}]+)\}\s+from\s+['"]([^'"]+)['"]"""


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _tagged(text: Column, patterns: dict[str, str]) -> Column:
    tag = lambda kind, found: F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("module")))
    return F.concat(*[tag(kind, _all(text, pattern, 1)) for kind, pattern in patterns.items()])


def js_imports(sources: DataFrame) -> DataFrame:
    """Distinct imported modules of a project by kind: static, dynamic, require."""
    rows = sources.select("project_id", F.explode(F.array_distinct(_tagged(F.col("source"), _JS))).alias("i"))
    return rows.select("project_id", "i.kind", "i.module").distinct()


def py_imports(sources: DataFrame) -> DataFrame:
    """Distinct root packages a project imports, of ``import a.b as c, d`` both a and d."""
    rows = sources.select("project_id", F.explode(each(_tagged(F.col("source"), _PY))).alias("i"))
    rows = rows.select("project_id", "i.kind", F.explode(F.split("i.module", ",")).alias("named"))
    root = F.substring_index(F.regexp_extract("named", r"^\s*(\S*)", 1), ".", 1)
    return rows.select("project_id", "kind", root.alias("module")).distinct()


def py_stdlib_imports(imports: DataFrame) -> DataFrame:
    """Imports of the standard library of the running Python."""
    return imports.where(F.col("module").isin(sorted(sys.stdlib_module_names)))


def py_public_api(sources: DataFrame) -> DataFrame:
    """Top-level functions not starting with an underscore, and all top-level classes."""
    patterns = {"function": r"(?m)^def\s+([A-Za-z]\w*)", "class": r"(?m)^class\s+(\w+)"}
    rows = sources.select("project_id", "path", F.explode(each(_tagged(F.col("source"), patterns))).alias("i"))
    return rows.select("project_id", "path", "i.kind", F.col("i.module").alias("name"))


def js_exports(files: DataFrame) -> DataFrame:
    found = F.arrays_zip(_all(F.col("content"), _EXPORT, 1).alias("kind"), _all(F.col("content"), _EXPORT, 2).alias("name"))
    return files.select("repository", "path", F.explode(each(found)).alias("e")).select("repository", "path", "e.kind", "e.name")


def package_of_import(module: Column) -> Column:
    """Package an import names: null for a local path, two parts when scoped, else the first part."""
    scoped = F.substring_index(module, "/", 2)
    local = module.startswith(".") | module.startswith("/")
    return F.when(~local, F.when(module.startswith("@"), scoped).otherwise(F.substring_index(module, "/", 1)))


def joined_path(folder: Column, relative: Column) -> Column:
    """Path of a relative import seen from a folder, with ``.`` and ``..`` taken out."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        can_go_up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(can_go_up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def named_imports(files: DataFrame) -> DataFrame:
    """Named imports with a source: (repository, path, module, names)."""
    found = F.arrays_zip(_all(F.col("content"), _NAMED_IMPORT, 1).alias("names"), _all(F.col("content"), _NAMED_IMPORT, 2).alias("module"))
    rows = files.select("repository", "path", F.explode(each(found)).alias("i"))
    names = F.transform(F.split("i.names", ","), lambda n: F.regexp_extract(n, r"^\s*(\S+)", 1))
    return rows.select("repository", "path", "i.module", names.alias("names"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``resolved``: the file a relative import means, its bare path when there is none, other imports unchanged.

    Files are keyed by what an import would say for them, with the rank of the suffix, so an import is one key.
    """
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    rank = F.array_position(F.array(*[F.lit(s) for s in TRIED_SUFFIXES]), suffix)
    known = files.select("repository", "path", rank.alias("_rank")).where(F.col("_rank") > 0)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    plain = F.struct(stem.alias("key"), F.col("_rank").alias("rank"))
    as_folder = F.when(stem.rlike("(^|/)index$"), F.struct(F.regexp_replace(stem, "/?index$", "").alias("key"), (F.col("_rank") + len(TRIED_SUFFIXES)).alias("rank")))
    keyed = known.select("repository", "path", F.explode(F.array_compact(F.array(plain, as_folder))).alias("k"))
    best = keyed.groupBy("repository", F.col("k.key").alias("_key")).agg(F.min_by("path", "k.rank").alias("_file"))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    relative = F.col("module").startswith(".")
    keys = imports.withColumn("_key", F.when(relative, joined_path(folder, F.col("module"))))
    joined = keys.join(best, ["repository", "_key"], "left")
    return joined.withColumn("resolved", F.coalesce("_file", "_key", "module")).drop("_key", "_file")


def referenced_items(resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """Classes, functions and interfaces of a file that another file imports by name."""
    wanted = resolved.select("repository", F.col("path").alias("importer"), F.col("resolved").alias("path"), F.explode("names").alias("name"))
    kinds = exports.where(F.col("kind").isin("class", "function", "interface")).select("repository", "path", "name", "kind").distinct()
    return wanted.join(kinds, ["repository", "path", "name"]).select("repository", "path", "importer", "name", "kind")


def used_packages(imports: DataFrame) -> DataFrame:
    """Distinct packages static imports and require calls name."""
    used = imports.where(F.col("kind").isin("static", "require")).select("project_id", package_of_import(F.col("module")).alias("name"))
    return used.where(F.col("name").isNotNull()).distinct()


def unused_packages(declared: DataFrame, imports: DataFrame) -> DataFrame:
    direct = declared.where(F.col("type").isin("dependency", "devDependency")).select("project_id", "name").distinct()
    return direct.join(used_packages(imports), ["project_id", "name"], "left_anti")


def missing_packages(declared: DataFrame, imports: DataFrame) -> DataFrame:
    direct = declared.where(F.col("type").isin("dependency", "devDependency")).select("project_id", "name").distinct()
    return used_packages(imports).join(direct, ["project_id", "name"], "left_anti")
