"""JavaScript and TypeScript through the index: modules, classes, exported functions, and imports as edges between modules.

A module is named by its path without suffix, and without ``index`` at the end, which is how an import says it; so a relative
import names its target without a look at other files. Imports of packages that are folders of the same repository (workspaces) are
linked by their manifests. Works on the text of declarations, as for Java, and in each file's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions.arrays import each, let, newlines, rewrite_tokens, sums_before
from code_impact.operators import java
from code_impact.operators.imports import joined_path, package_of_import
from code_impact.session import cut_lineage

_TOKEN = r'//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\'|`(?:[^`\\]++|\\(?s:.))*+`'
_IMPORT = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"\n]+)['"]"""
_CLAUSE = r"""\b(?:import|export)\s+(?:type\s+)?([^'";]*?)\s*from\s*['"]([^'"\n]+)['"]"""
_HEAD = rf"(?:^|[\n\s])(?:export\s+|default\s+|declare\s+|abstract\s+)*(class|interface)\s+([\w$]+)\s*(?:{java._GENERIC}\s*)?([^{{]*)\{{$"
_MEMBER = rf"(?:^|\n)\s*((?:(?:public|private|protected|static|async|get|set|override|abstract|readonly)\s+|\*\s*)*)([\w$#]+)\s*\??\s*(?:{java._GENERIC}\s*)?\(([^)]*)\)\s*(?::\s*([^={{;]+?))?\s*[{{;]$"
_FUNCTION = rf"(?:^|\n)\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:{java._GENERIC}\s*)?\(([^)]*)\)\s*(?::\s*([^{{;]+?))?\s*\{{$"
_ARROW = rf"(?:^|\n)\s*export\s+const\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:{java._GENERIC}\s*)?\(([^)]*)\)\s*(?::\s*([^=]+?))?\s*=>[\s\S]*$"
_NO_MEMBER = ["if", "for", "while", "switch", "catch", "return", "function", "with", "super", "new", "await", "throw", "typeof"]
SUFFIX = r"\.(?:d\.ts|[cm]?[jt]sx?)$"
_ROOT = "name string, main string, module string, types string"


def module_name(path: Column) -> Column:
    """What an import says for a file: its path without suffix and without a last ``index``."""
    return F.regexp_replace(F.regexp_replace(path, SUFFIX, ""), r"(?:^|/)index$", "")


def _without(content: Column, strings: bool) -> Column:
    """Comments blanked, and strings if asked, else the quotes inside them; every newline stays."""
    lines = lambda token: F.regexp_replace(token, r"[^\n]", "")
    unquoted = lambda token: F.concat(F.substring(token, 1, 1), F.regexp_replace(F.substr(token, F.lit(2), F.length(token) - 2), "['\"`]", " "), F.substring(token, -1, 1))
    blank = lambda token: F.when(token.startswith("/"), F.concat(F.lit(" "), lines(token))).otherwise(F.concat(F.lit("''"), lines(token)) if strings else unquoted(token))
    return F.when(content.rlike("[\"'/`]"), rewrite_tokens(content, _TOKEN, blank)).otherwise(content)


def _imports(text: Column) -> Column:
    """(module, line) of all imports, re-exports and requires, in order."""

    def located(found: Column) -> Column:
        gaps, tokens = F.split(text, _IMPORT, -1), F.regexp_extract_all(text, F.lit(_IMPORT), F.lit(0))
        steps = F.zip_with(tokens, F.slice(gaps, 1, F.size(tokens)), lambda t, g: newlines(t) + newlines(g))
        lines = let(sums_before(steps), lambda before: F.zip_with(before, F.slice(gaps, 1, F.size(tokens)), lambda b, g: b + newlines(g) + 1))
        return F.arrays_zip(found.alias("module"), lines.alias("line"))

    return let(F.regexp_extract_all(text, F.lit(_IMPORT), F.lit(1)), located)


def _names(text: Column) -> Column:
    """(module, names) of imports with a clause: the names as the other module has them."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(_CLAUSE), F.lit(1)).alias("clause"), F.regexp_extract_all(text, F.lit(_CLAUSE), F.lit(2)).alias("module"))
    of = lambda clause: F.filter(F.regexp_extract_all(F.regexp_replace(clause, r"\btype\s+(?=[\w$])", ""), F.lit(r"([\w$*]+)(?:\s+as\s+[\w$]+)?"), F.lit(1)), lambda n: n != "*")
    return F.transform(found, lambda f: F.struct(f["module"].alias("module"), of(f["clause"]).alias("names")))


def _parameters(text: Column) -> Column:
    pieces = F.transform(F.regexp_extract_all(text, F.lit(java._PARAMETER), F.lit(0)), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    shape = r"^(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?([\w$]+)\??\s*(?::\s*([^=]+?))?\s*(?:=.*)?$"
    known = F.filter(pieces, lambda p: p.rlike(shape))
    return F.transform(known, lambda p: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, shape, 2), F.lit("")), F.lit("any")).alias("type"), F.regexp_extract(p, shape, 1).alias("name")))


def _function(s: Column, pattern: str) -> Column:
    g = lambda k: F.regexp_extract(s["txt"], pattern, k)
    none = F.array().cast("array<string>")
    return java._method(g(1), F.trim(g(3)), java._last_line(s), _parameters(g(2)), none, F.when(s["step"] == 1, s["end_line"]).otherwise(java._last_line(s)))


def _members(segs: Column, owner: Column) -> Column:
    """Methods of a class that are not private or protected."""
    g = lambda s, k: F.regexp_extract(s["txt"], _MEMBER, k)
    wanted = F.filter(java.members_of(segs, owner), lambda s: (s["step"] >= 0) & (g(s, 2) != "") & ~g(s, 2).isin(_NO_MEMBER) & ~g(s, 2).startswith("#") & ~g(s, 1).rlike("private|protected"))
    none = F.array().cast("array<string>")
    return F.transform(
        wanted,
        lambda s: java._method(g(s, 2), F.trim(g(s, 4)), java._last_line(s), _parameters(g(s, 3)), none, F.when(s["step"] == 1, s["end_line"]).otherwise(java._last_line(s))),
    )


def module_types(files: DataFrame) -> DataFrame:
    """One row per module and per class or interface in it, with the columns of ``java.java_types``."""
    own = files.select("repository", "path", module_name(F.col("path")).alias("_name"), _without(F.col("content"), False).alias("_text"), _without(F.col("content"), True).alias("_code"))
    own = own.select("repository", "path", "_name", _imports(F.col("_text")).alias("_imports"), _names(F.col("_text")).alias("_clauses"), java.segments(F.col("_code")).alias("_segs"))
    segs, name = F.col("_segs"), F.col("_name")
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    none = F.array().cast("array<string>")
    no_fields = F.array().cast("array<struct<type:string,name:string,line:int>>")

    def edge(i: Column) -> Column:
        names = F.flatten(F.transform(F.filter("_clauses", lambda c: c["module"] == i["module"]), lambda c: c["names"]))
        return java._edge(name, module_name(joined_path(folder, i["module"])), "import", i["line"], F.array_distinct(names))

    relative = F.filter("_imports", lambda i: i["module"].startswith("."))
    top = F.filter(segs, lambda s: s["depth"] == 0)
    functions = F.concat(
        F.transform(F.filter(top, lambda s: s["txt"].rlike(_FUNCTION)), lambda s: _function(s, _FUNCTION)),
        F.transform(F.filter(top, lambda s: s["txt"].rlike(_ARROW)), lambda s: _function(s, _ARROW)),
    )
    row = lambda **columns: F.struct(*[c.alias(k) for k, c in columns.items()])
    listed = F.transform("_imports", lambda i: i["module"])
    module = row(
        name=name, kind=F.lit("module"), line=F.lit(1), package=folder, imports=listed, annotations=none, dependencies=none,
        methods=functions, fields=no_fields, edges=F.transform(relative, edge),
    )

    def described(s: Column) -> Column:
        g = lambda k: F.regexp_extract(s["txt"], _HEAD, k)
        rest = F.regexp_replace(g(3), java._GENERIC, "")
        bases = lambda word: F.regexp_extract_all(F.regexp_extract(rest, rf"\b{word}\s+([\w$.,\s]+?)(?:\bimplements\b|$)", 1), F.lit(r"([\w$]+)\s*(?:,|$)"), F.lit(1))
        line = java._last_line(s)
        to = lambda kind: F.transform(bases(kind), lambda b: java._edge(g(2), b, kind, line))
        return row(
            name=g(2), kind=g(1), line=line, package=folder, imports=listed, annotations=none, dependencies=F.concat(bases("extends"), bases("implements")),
            methods=_members(segs, s), fields=no_fields, edges=F.concat(to("extends"), to("implements")),
        )

    classes = F.transform(F.filter(segs, lambda s: (s["step"] == 1) & s["txt"].rlike(_HEAD)), described)
    rows = own.select("repository", "path", F.posexplode(each(F.concat(F.array(module), classes))).alias("pos", "_t"))
    return rows.select("repository", "path", "pos", "_t.*")


def workspace_packages(files: DataFrame) -> DataFrame:
    """(repository, package, folder, entry: module its manifest names, or null) of all manifests with a name below the root or at it."""
    manifests = files.where(F.col("path").rlike(r"(^|/)package\.json$") & F.col("content").isNotNull())
    folder = F.regexp_extract("path", r"^(?:(.*)/)?package\.json$", 1)
    parsed = manifests.select("repository", folder.alias("folder"), F.from_json("content", _ROOT).alias("p"))
    entry = F.coalesce("p.types", "p.module", "p.main")
    named = parsed.where("p.name IS NOT NULL").select("repository", F.col("p.name").alias("package"), "folder", module_name(joined_path(F.col("folder"), entry)).alias("entry"))
    return named.groupBy("repository", "package").agg(F.min_by(F.struct("folder", "entry"), "folder").alias("w")).select("repository", "package", "w.*")


def link_workspaces(types: DataFrame, files: DataFrame) -> DataFrame:
    """Add the edges of imports that name a package of the same repository.

    ``@org/a`` is the module its manifest names, or that of its folder or of ``src`` below, whichever there is first; ``@org/a/b``
    the module ``b`` in the folder or in ``src``. Only imports that are no paths are joined.
    """
    packages = cut_lineage(workspace_packages(files))
    rows = types.where("kind = 'module'").select("repository", "path", "name", F.explode("imports").alias("module"))
    rows = rows.select("*", package_of_import(F.col("module")).alias("package")).where("package IS NOT NULL").distinct()
    meant = rows.join(packages, ["repository", "package"])
    below = F.expr("substr(module, length(package) + 2)")
    at = lambda *parts: joined_path(F.concat_ws("/", *parts), F.lit("."))
    tried = F.when(below == "", F.array("entry", at(F.col("folder")), at(F.col("folder"), F.lit("src")))).otherwise(
        F.array(module_name(at(F.col("folder"), below)), module_name(at(F.col("folder"), F.lit("src"), below)))
    )
    options = meant.select("repository", "path", "name", F.posexplode(tried).alias("place", "dst")).where("dst IS NOT NULL")
    known = types.where("kind = 'module'").select("repository", F.col("name").alias("dst")).distinct()
    found = options.join(known, ["repository", "dst"]).where("name <> dst").select("repository", "path", "name", "dst", "place")
    asked = meant.select("repository", "path", "name", "module", F.posexplode(tried).alias("place", "dst"))
    best = asked.join(found.select("repository", "path", "dst"), ["repository", "path", "dst"], "left_semi")
    best = best.groupBy("repository", "path", "name", "module").agg(F.min_by("dst", "place").alias("dst"))
    edge = java._edge(F.col("name"), F.col("dst"), "import", F.lit(1), F.array("module"))
    # A list is as long as the packages that a module imports.
    added = best.groupBy("repository", "path").agg(F.array_sort(F.collect_list(edge)).alias("_more")).withColumn("pos", F.lit(0))
    joined = types.join(added, ["repository", "path", "pos"], "left")
    return joined.withColumn("edges", F.concat("edges", F.coalesce("_more", F.slice("edges", 1, 0)))).select(types.columns)


class ModuleStrategy:
    """JavaScript and TypeScript files as modules and classes."""

    def extract(self, files: DataFrame) -> DataFrame:
        return module_types(files)

    def link(self, types: DataFrame, files: DataFrame) -> DataFrame:
        return link_workspaces(types, files)

    def breaking_changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        from code_impact.operators import diff

        return diff.breaking_changes(old, new)
