"""Package manifests as a table of files (``project_id``, ``path``, ``content``): one row per declared package.

Every format is read inside the row of its file; only packages leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions.arrays import each

# Categories by fragments of a package name, first match wins.
NPM_CATEGORIES = {
    "testing": ["jest", "mocha", "chai", "cypress", "playwright", "karma"],
    "bundling": ["webpack", "rollup", "parcel", "vite", "esbuild"],
    "framework": ["react", "vue", "angular", "svelte", "express", "fastify"],
    "database": ["mysql", "pg", "mongodb", "redis", "sqlite"],
    "validation": ["joi", "yup", "ajv", "validator"],
    "http": ["axios", "fetch", "superagent", "got"],
    "utility": ["lodash", "ramda", "moment", "dayjs"],
    "cli": ["commander", "yargs", "inquirer"],
    "logging": ["winston", "pino", "debug"],
    "security": ["helmet", "bcrypt", "jsonwebtoken"],
}
PYPI_CATEGORIES = {
    "web-framework": ["django", "flask", "fastapi", "tornado", "pyramid"],
    "testing": ["pytest", "unittest2", "nose", "tox", "coverage"],
    "data-science": ["numpy", "pandas", "scipy", "matplotlib", "sklearn"],
    "machine-learning": ["tensorflow", "pytorch", "keras", "xgboost"],
    "database": ["sqlalchemy", "psycopg2", "pymongo", "redis"],
    "http": ["requests", "httpx", "aiohttp", "urllib3"],
    "async": ["asyncio", "aiofiles", "uvloop", "trio"],
    "cli": ["click", "argparse", "typer", "fire"],
    "serialization": ["pydantic", "marshmallow", "cerberus"],
    "templating": ["jinja2", "mako", "chameleon"],
    "security": ["cryptography", "passlib", "pyjwt"],
    "deployment": ["gunicorn", "uwsgi", "celery", "supervisor"],
}
JAVA_CATEGORIES = {
    "web-framework": ["spring-boot", "spring-web", "jersey", "struts", "wicket"],
    "testing": ["junit", "testng", "mockito", "powermock", "hamcrest"],
    "logging": ["logback", "log4j", "slf4j", "commons-logging"],
    "database": ["hibernate", "mybatis", "jdbc", "h2", "postgresql"],
    "serialization": ["jackson", "gson", "xstream", "protobuf"],
    "http": ["httpclient", "okhttp", "retrofit", "feign"],
    "utility": ["commons-lang", "commons-io", "guava", "apache-commons"],
    "security": ["spring-security", "shiro", "bouncastle"],
    "build": ["maven", "gradle", "ant"],
}
GO_CATEGORIES = {
    "web-framework": ["gin-gonic", "echo", "fiber", "chi", "gorilla/mux"],
    "database": ["gorm", "sqlx", "mongo-driver", "redis", "badger"],
    "testing": ["testify", "gomega", "ginkgo"],
    "logging": ["logrus", "zap", "zerolog"],
    "http": ["resty", "fasthttp"],
    "cli": ["cobra", "cli", "kingpin"],
    "security": ["crypto", "jwt-go", "bcrypt"],
    "serialization": ["json-iterator", "protobuf", "msgpack"],
}
GENERIC_CATEGORIES = {
    "testing": ["test", "junit", "jest"],
    "web-framework": ["express", "fastapi", "spring"],
    "frontend-framework": ["react", "vue", "angular"],
    "database": ["database", "mysql", "postgres"],
    "cloud": ["aws", "azure", "gcp"],
}
# License classes by fragment, first match wins.
LICENSES = {
    "MIT": "permissive", "APACHE-2.0": "permissive", "BSD": "permissive", "LGPL": "weak-copyleft", "GPL": "copyleft",
    "ISC": "permissive", "MOZILLA": "weak-copyleft",
}
# Package managers and languages by the file that shows them, first match wins; signs of a monorepo.
PYTHON_MANAGERS = {"pyproject.toml": "poetry", "Pipfile": "pipenv", "environment.yml": "conda", "requirements.txt": "pip"}
MANIFEST_LANGUAGES = {
    "javascript": ["package.json"], "python": ["requirements.txt", "pyproject.toml"], "java": ["pom.xml", "build.gradle"],
    "go": ["go.mod"], "csharp": [".csproj"],
}
MONOREPO_FILES = ["lerna.json", "nx.json", "rush.json"]
MONOREPO_FOLDERS = ["packages/", "apps/", "libs/"]


def category(name: Column, table: dict[str, list[str]]) -> Column:
    found = F.lit("library")
    for label, fragments in reversed(table.items()):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(name, F.lit(fragment))
        found = F.when(hit, label).otherwise(found)
    return found


def categorise(packages: DataFrame) -> DataFrame:
    """Category of each package by the list of its ecosystem, and by the generic list."""
    name = F.col("name")
    by_ecosystem = (
        F.when(F.col("ecosystem") == "npm", category(name, NPM_CATEGORIES))
        .when(F.col("ecosystem") == "pypi", category(F.lower(name), PYPI_CATEGORIES))
        .when(F.col("ecosystem") == "maven", category(F.lower(name), JAVA_CATEGORIES))
        .when(F.col("ecosystem") == "go", category(name, GO_CATEGORIES))
        .otherwise(F.lit("library"))
    )
    return packages.withColumn("category", by_ecosystem).withColumn("generic_category", category(name, GENERIC_CATEGORIES))


def _rows(files: DataFrame, found: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = files.select("project_id", F.col("path").alias("file_path"), F.explode(each(found)).alias("p"))
    return rows.select("project_id", "file_path", "p.name", "p.version", "p.type", *[f"p.{c}" for c in extra])


def _package(name: Column, version: Column, kind: Column, **extra: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), kind.alias("type"), *[v.alias(k) for k, v in extra.items()])


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


# JavaScript ----------------------------------------------------------------------------------------------------------

_NPM = "name string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"


def npm_packages(files: DataFrame) -> DataFrame:
    kinds = {"dependencies": "dependency", "devDependencies": "devDependency", "peerDependencies": "peerDependency"}
    entries = lambda field, kind: F.transform(
        F.coalesce(F.map_entries(field), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: _package(e["key"], e["value"], F.lit(kind)),
    )
    parsed = files.withColumn("_m", F.from_json("content", _NPM))
    found = F.concat(*[entries(F.col(f"_m.{field}"), kind) for field, kind in kinds.items()])
    return _rows(parsed, found).withColumn("category", category(F.col("name"), GENERIC_CATEGORIES)).withColumn("is_direct", F.lit(True))


_LOCKED = "struct<version:string,resolved:string,integrity:string,dev:boolean,optional:boolean,license:string,dependencies:map<string,string>>"
_LOCK = f"name string, packages map<string,{_LOCKED}>, dependencies map<string,{_LOCKED}>"


def npm_lock(files: DataFrame) -> DataFrame:
    """Resolved packages of lock files, of either layout."""
    parsed = files.withColumn("_l", F.from_json("content", _LOCK))
    rows = parsed.select("project_id", F.col("_l.name").alias("_own"), F.explode(F.coalesce("_l.packages", "_l.dependencies")).alias("at", "p"))
    name = F.when(F.col("at") == "", F.col("_own")).otherwise(F.substring_index("at", "node_modules/", -1))
    rows = rows.withColumn("depth", F.size(F.split("at", "node_modules/")))
    named = rows.withColumn("name", name).where((F.col("name") != "") & ~F.coalesce(F.col("name") == F.col("_own"), F.lit(False)))
    return named.select(
        "project_id", "name", "p.version", "p.integrity", (~F.contains("at", F.lit("node_modules"))).alias("is_direct"),
        F.coalesce("p.dev", F.lit(False)).alias("is_dev"), F.coalesce("p.optional", F.lit(False)).alias("is_optional"),
        F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")).alias("dependencies"), "depth",
    )


def enrich_lock(packages: DataFrame, locked: DataFrame) -> DataFrame:
    """Add what the lock file resolved. Of several copies that nearest to the root counts."""
    known = locked.groupBy("project_id", "name").agg(F.min_by(F.struct("version", "integrity"), F.struct("depth", "version")).alias("l"))
    known = known.select("project_id", "name", F.col("l.version").alias("resolved_version"), F.col("l.integrity").alias("integrity"))
    return packages.join(known, ["project_id", "name"], "left")


# Python --------------------------------------------------------------------------------------------------------------


def pip_packages(files: DataFrame) -> DataFrame:
    """Names, with extras left out, and version constraints of a requirements file."""
    # What a name and a comparison are made of.
    pattern = r"^([a-zA-Z0-9\-_.]+)(?:\s*\[[^\]]*\])?(?:\s*([><=!~]+)\s*(.+))?"
    kept = F.filter(
        _lines(F.col("content")), lambda line: (_trim(line) != "") & ~line.startswith("#") & ~line.startswith("-") & line.rlike(pattern)
    )

    def one(line: Column) -> Column:
        operator, version = F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 3)
        spec = F.when((operator != "") & (version != ""), F.concat(operator, version)).otherwise(F.lit("*"))
        return _package(F.regexp_extract(line, pattern, 1), spec, F.lit("dependency"))

    return _rows(files, F.transform(kept, one))


def _sections(content: Column) -> Column:
    """Array of (title, lines) of a file with ``[title]`` lines. Text before the first title has an empty one."""
    parts = F.split(content, r"(?m)^(?=[ \t]*\[.*\][ \t]*$)", -1)
    title = r"^[ \t]*\[(.*)\][ \t]*(?:\n|$)"
    return F.transform(parts, lambda part: F.struct(F.regexp_extract(part, title, 1).alias("title"), _lines(F.regexp_replace(part, title, "")).alias("lines")))


def _in_sections(content: Column, kinds: dict[str, str], entry) -> Column:
    """Entries of the named sections: ``entry(line, kind)`` per line with an equals sign."""
    wanted = F.filter(_sections(content), lambda s: s["title"].isin(list(kinds)))
    kind_of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.flatten(
        F.transform(wanted, lambda s: F.transform(F.filter(s["lines"], lambda line: F.contains(line, F.lit("="))), lambda line: entry(line, F.element_at(kind_of, s["title"]))))
    )


def pipfile_packages(files: DataFrame) -> DataFrame:
    """The version is what follows the first equals sign, or the ``version`` of an inline table."""
    bare = lambda text: F.replace(_trim(text), F.lit('"'), F.lit(""))
    inline = r'version\s*=\s*"([^"]*)"'

    def part(line: Column, n: int) -> Column:
        if n == 0:
            return bare(F.substring_index(line, "=", 1))
        value = F.regexp_replace(line, r"^[^=]*=", "")
        table = F.regexp_extract(value, inline, 1)
        return F.when(_trim(value).startswith("{"), F.when(table == "", F.lit("*")).otherwise(table)).otherwise(bare(value))

    kinds = {"packages": "dependency", "dev-packages": "devDependency"}
    found = _in_sections(F.col("content"), kinds, lambda line, kind: _package(part(line, 0), part(line, 1), kind))
    return _rows(files, F.filter(found, lambda p: (p["name"] != "") & (p["version"] != "")))


def poetry_packages(files: DataFrame) -> DataFrame:
    """Dependencies, development dependencies and extras; ``python`` is reported as type ``languageVersion``."""
    key = lambda line: _trim(F.substring_index(line, "=", 1))
    value = lambda line: F.replace(_trim(F.regexp_replace(line, r"^[^=]*=", "")), F.lit('"'), F.lit(""))
    live = lambda line: ~_trim(line).startswith("#")
    none = F.lit(None).cast("string")
    kinds = {"tool.poetry.dependencies": "dependency", "tool.poetry.dev-dependencies": "devDependency"}
    content = F.col("content")

    def entry(line: Column, kind: Column) -> Column:
        typed = F.when((key(line) == "python") & (kind == "dependency"), F.lit("languageVersion")).otherwise(kind)
        return _package(F.when(live(line), key(line)), value(line), typed, extra=none)

    def extras(line: Column, _kind: Column) -> Column:
        names = F.transform(F.split(F.regexp_replace(value(line), r"^\[|\]$", ""), ","), _trim)
        return F.transform(
            F.filter(names, lambda n: (n != "") & live(line)), lambda n: _package(n, F.lit("*"), F.lit("optionalDependency"), extra=key(line))
        )

    plain = F.filter(_in_sections(content, kinds, entry), lambda p: p["name"].isNotNull())
    optional = F.flatten(_in_sections(content, {"tool.poetry.extras": "optionalDependency"}, extras))
    return _rows(files, F.concat(plain, optional), ("extra",))


# Java, Go, .NET ------------------------------------------------------------------------------------------------------


def maven_packages(files: DataFrame) -> DataFrame:
    content = F.col("content")
    block = F.regexp_extract(content, r"<properties>([\s\S]*?)</properties>", 1)
    prop = r"<([\w.-]+)>([^<]+)</"
    entries = F.arrays_zip(
        F.regexp_extract_all(block, F.lit(prop), F.lit(1)).alias("name"), F.regexp_extract_all(block, F.lit(prop), F.lit(2)).alias("value")
    )
    tag = lambda xml, name: F.nullif(F.regexp_extract(xml, f"<{name}>([^<]+)</{name}>", 1), F.lit(""))

    def one(xml: Column) -> Column:
        raw = tag(xml, "version")
        asked = F.regexp_extract(raw, r"^\$\{(.+)\}$", 1)
        known = F.get(F.filter(entries, lambda e: e["name"] == asked), F.lit(0))["value"]
        version = F.when(raw.isNull(), F.lit("*")).when(asked != "", F.coalesce(known, raw)).otherwise(raw)
        name = F.concat(tag(xml, "groupId"), F.lit(":"), tag(xml, "artifactId"))
        kind = F.when(tag(xml, "scope") == "test", F.lit("testDependency")).otherwise(F.lit("dependency"))
        return _package(name, version, kind, optional=F.coalesce(tag(xml, "optional") == "true", F.lit(False)))

    blocks = F.regexp_extract_all(content, F.lit(r"<dependency>[\s\S]*?</dependency>"), F.lit(0))
    return _rows(files, F.filter(F.transform(blocks, one), lambda p: p["name"].isNotNull()), ("optional",))


def gradle_packages(files: DataFrame) -> DataFrame:
    pattern = r"""(implementation|api|compile|testImplementation|testCompile)\s+['"]([^'"]+)['"]"""
    found = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("scope"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("at")
    )

    def one(m: Column) -> Column:
        parts = F.split(m["at"], ":", -1)
        name = F.when(F.size(parts) >= 2, F.concat(F.get(parts, F.lit(0)), F.lit(":"), F.get(parts, F.lit(1))))
        version = F.coalesce(F.nullif(F.get(parts, F.lit(2)), F.lit("")), F.lit("*"))
        kind = F.when(F.contains(m["scope"], F.lit("test")), F.lit("testDependency")).otherwise(F.lit("dependency"))
        return _package(name, version, kind, scope=m["scope"])

    return _rows(files, F.filter(F.transform(found, one), lambda p: p["name"].isNotNull()), ("scope",))


def go_packages(files: DataFrame) -> DataFrame:
    """Requirements of go.mod, in blocks and on single lines, with the module and language version of the file."""
    content = F.col("content")
    blocks = F.regexp_extract_all(content, F.lit(r"(?m)^\s*require \(\s*$([\s\S]*?)^\s*\)\s*$"), F.lit(1))
    in_blocks = F.flatten(F.transform(blocks, _lines))
    single = F.regexp_extract_all(content, F.lit(r"(?m)^\s*require ([^\s(].*)$"), F.lit(1))
    entry = r"^\s*(\S+)\s+(\S+)"
    lines = F.filter(F.concat(in_blocks, single), lambda line: line.rlike(entry) & ~_trim(line).startswith("//"))

    def one(line: Column) -> Column:
        direct = ~F.contains(line, F.lit("// indirect"))
        kind = F.when(direct, F.lit("dependency")).otherwise(F.lit("indirectDependency"))
        return _package(
            F.regexp_extract(line, entry, 1), F.regexp_extract(line, entry, 2), kind, is_direct=direct,
            module=F.regexp_extract(content, r"(?m)^\s*module (\S+)", 1), go_version=F.regexp_extract(content, r"(?m)^\s*go (\S+)", 1),
        )

    return _rows(files, F.transform(lines, one), ("is_direct", "module", "go_version"))


def csproj_packages(files: DataFrame) -> DataFrame:
    tags = F.regexp_extract_all("content", F.lit("<PackageReference[^>]*>"), F.lit(0))
    attribute = lambda xml, name: F.nullif(F.regexp_extract(xml, f'{name}="([^"]+)"', 1), F.lit(""))
    found = F.transform(tags, lambda x: _package(attribute(x, "Include"), F.coalesce(attribute(x, "Version"), F.lit("*")), F.lit("dependency")))
    return _rows(files, F.filter(found, lambda p: p["name"].isNotNull()))


# Projects ------------------------------------------------------------------------------------------------------------


def detect_manager(paths: DataFrame) -> DataFrame:
    """Python package manager and main language of each repository, by the manifests at hand (``repository``, ``path``)."""
    path = F.col("path")
    order = lambda tests: F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)])
    manager = order([path == name for name in PYTHON_MANAGERS])
    language = order(
        [path.rlike("|".join(f.replace(".", r"\.") + ("$" if name == "javascript" else "") for f in files)) for name, files in MANIFEST_LANGUAGES.items()]
    )
    found = paths.groupBy("repository").agg(F.min(manager).alias("m"), F.min(language).alias("l"))
    pick = lambda values, at, default: F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), at), F.lit(default))
    return found.select(
        "repository", pick(PYTHON_MANAGERS.values(), F.col("m"), "pip").alias("manager"),
        pick(MANIFEST_LANGUAGES, F.col("l"), "unknown").alias("language"),
    )


_ROOT = "name string, private boolean, workspaces string"


def monorepos(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Whether each repository is a monorepo: known files or folders at its root, or what its root manifest says."""
    path = F.col("path")
    sign = path.isin(MONOREPO_FILES)
    for folder in MONOREPO_FOLDERS:
        sign = sign | path.startswith(folder)
    seen = paths.groupBy("repository").agg(F.bool_or(sign).alias("_sign"))
    parsed = roots.withColumn("_r", F.from_json("content", _ROOT))
    says = parsed.groupBy("repository").agg(F.bool_or(F.col("_r.workspaces").isNotNull() | F.coalesce("_r.private", F.lit(False))).alias("_says"))
    joined = seen.join(says, "repository", "full")
    return joined.select("repository", (F.coalesce("_sign", F.lit(False)) | F.coalesce("_says", F.lit(False))).alias("is_monorepo"))


def sub_projects(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Folders with a package.json that a workspace pattern of the root manifest covers."""
    parsed = roots.withColumn("_w", F.from_json("content", _ROOT)["workspaces"])
    listed = F.coalesce(F.from_json("_w", "array<string>"), F.from_json("_w", "struct<packages:array<string>>")["packages"])
    escape = lambda glob: F.regexp_replace(F.regexp_replace(glob, r"/$", ""), r"([.+^$(){}|\[\]])", r"\\$1")
    stars = lambda glob: F.replace(F.regexp_replace(F.replace(glob, F.lit("**"), F.lit("\u0001")), r"\*", "[^/]*"), F.lit("\u0001"), F.lit(".*"))
    regexes = F.transform(listed, lambda glob: F.concat(F.lit("^"), stars(escape(glob)), F.lit("$")))
    known = parsed.where(listed.isNotNull()).select("repository", regexes.alias("_regexes"))
    folders = paths.where(F.col("path").endswith("/package.json")).select("repository", F.regexp_extract("path", "^(.*)/package[.]json$", 1).alias("folder"))
    covered = F.exists("_regexes", lambda regex: F.rlike(F.col("folder"), regex))
    return folders.join(known, "repository").where(covered).select("repository", "folder").distinct()


# Packages ------------------------------------------------------------------------------------------------------------


def enrich_registry(packages: DataFrame, registry: DataFrame) -> DataFrame:
    return packages.join(registry, "name", "left").withColumn("is_deprecated", F.coalesce("is_deprecated", F.lit(False)))


def license_class(license_name: Column) -> Column:
    found = F.lit("other")
    for pattern, label in reversed(LICENSES.items()):
        found = F.when(F.contains(F.upper(license_name), F.lit(pattern)), label).otherwise(found)
    return F.when(F.coalesce(license_name, F.lit("")) == "", "unknown").otherwise(found)


def breaking_risk(version: Column, deprecated: Column, published: Column, as_of: str) -> Column:
    old = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(published.cast("timestamp")) > 365 * 86400
    return F.when(version.startswith("0.") | deprecated, "high").when(F.coalesce(old, F.lit(False)), "medium").otherwise("low")


def version_numbers(version: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_extract(version, r"[\d.]+", 0), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("bigint"))


def in_range(version: Column, affected: Column) -> Column:
    """Whether a version lies in a range like ``< 6.15.0`` or ``>= 1, < 2``: all parts must hold, shorter numbers end in
    zeros. No range means every version; a part or a version without a number fits nothing."""
    v = version_numbers(version)

    def holds(part: Column) -> Column:
        operator, bound = F.regexp_extract(part, r"^\s*(<=|>=|<|>|=)?", 1), version_numbers(part)
        width = F.greatest(F.size(v), F.size(bound))
        padded = lambda n: F.concat(n, F.array_repeat(F.lit(0).cast("bigint"), width - F.size(n)))
        left, right = padded(v), padded(bound)
        met = F.when(operator == "<", left < right).when(operator == "<=", left <= right).when(operator == ">", left > right).when(operator == ">=", left >= right).otherwise(left == right)
        return (F.size(v) > 0) & (F.size(bound) > 0) & met

    return F.coalesce(F.when(affected.isNull(), F.lit(True)).otherwise(F.forall(F.split(affected, ","), holds)), F.lit(False))


def package_security(packages: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Vulnerabilities of each package and its risk. Each distinct name and version is looked up once."""
    versions = packages.select("name", "version").distinct()
    known = vulnerabilities.select(F.col("package").alias("name"), "severity", "affected")
    hits = versions.join(known, "name").where(in_range(F.col("version"), F.col("affected")))
    counted = hits.groupBy("name", "version").agg(
        F.count(F.lit(1)).alias("vulnerabilities"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    joined = packages.join(counted, ["name", "version"], "left").na.fill(0, ["vulnerabilities", "critical", "high"])
    risk = F.when(F.col("critical") > 0, "high").when(F.col("high") > 0, "medium").when(F.col("vulnerabilities") > 0, "low").otherwise("none")
    return joined.withColumn("security_risk", risk)


def security_summary(secured: DataFrame) -> DataFrame:
    return secured.groupBy("project_id").agg(
        F.count_if(F.col("vulnerabilities") > 0).alias("vulnerable_packages"),
        F.sum("vulnerabilities").alias("total_vulnerabilities"), F.sum("critical").alias("critical_count"),
    )


def package_tags(columns: list[Column], flags: dict[str, Column]) -> Column:
    named = [F.nullif(c, F.lit("")) for c in columns]
    return F.array_compact(F.array(*named, *[F.when(F.coalesce(flag, F.lit(False)), F.lit(tag)) for tag, flag in flags.items()]))


def package_id() -> Column:
    return F.md5(F.concat_ws("-", "name", "version", "type"))


def search_document(parts: list[Column]) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def metadata(packages: DataFrame, repository: Column) -> DataFrame:
    """Metadata record of each package with its defaults."""
    text = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return packages.select(
        package_id().alias("id"), "name", "version", "type", text(F.col("category"), "unknown").alias("category"), "language",
        text(F.col("license"), "unknown").alias("license"), repository.alias("repository"), "file_path",
        F.coalesce("is_direct", F.lit(True)).alias("is_direct"), F.coalesce("is_deprecated", F.lit(False)).alias("is_deprecated"),
        (F.coalesce("vulnerabilities", F.lit(0)) > 0).alias("has_vulnerabilities"), F.coalesce("vulnerabilities", F.lit(0)).alias("vulnerability_count"),
        F.coalesce("download_count", F.lit(0)).alias("download_count"),
    )
