"""Queries over extracted Java declarations. The SQL uses the columns the sources are generated from."""

from pyspark.sql import functions as F

from code_impact.operators import java
from code_impact.plans.registry import query

REPO = "'org/repo' || (p_partkey % 5)"
PATH = "'src/main/java/com/example/p' || (p_size % 7) || '/C' || p_partkey || '.java'"
SVC = "'src/' || CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'main' END || '/S' || p_partkey || '.java'"


@query("java_packages", f"SELECT {REPO} AS repository, {PATH} AS path, 'com.example.p' || (p_size % 7) AS package FROM part")
def java_packages(t):
    return java.java_packages(t["code_files"])


@query(
    "java_imports",
    f"""SELECT {REPO} AS repository, {PATH} AS path, 'java.util.List' AS import FROM part
    UNION ALL SELECT {REPO}, {PATH}, 'com.example.base.C' || (p_partkey % 50) FROM part
    UNION ALL SELECT {REPO}, {SVC}, 'org.lib.U' || (p_partkey % 9) || '.*' FROM part""",
)
def java_imports(t):
    both = t["code_files"].unionByName(t["service_files"])
    return java.java_imports(both).select("repository", "path", "import")


@query(
    "java_classes",
    f"""SELECT {REPO} AS repository, {PATH} AS path, 'C' || p_partkey AS name, 'class' AS kind, 'com.example.p' || (p_size % 7) AS package FROM part
    UNION ALL SELECT {REPO}, {SVC}, 'S' || p_partkey, 'class', 'com.example.svc' FROM part
    UNION ALL SELECT {REPO}, {SVC}, 'N' || p_partkey, 'class', 'com.example.svc' FROM part
    UNION ALL SELECT {REPO}, {SVC}, 'P' || p_partkey, 'interface', 'com.example.svc' FROM part""",
)
def java_classes(t):
    both = t["code_files"].unionByName(t["service_files"])
    return java.classes(java.java_types(both)).select("repository", "path", "name", "kind", "package")


@query(
    "java_public_methods",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS class, 'C' || p_partkey || '(C' || ((p_partkey * 7 + 3) % 97) || ' dep)' AS signature, 7 AS line FROM part
    UNION ALL SELECT {REPO}, 'C' || p_partkey, 'void m' || p_size || '(Long id)', 8 FROM part""",
)
def java_public_methods(t):
    return java.methods(java.java_types(t["code_files"])).select("repository", "class", "signature", "line")


@query(
    "java_parameters",
    f"""SELECT {REPO} AS repository, 'S' || p_partkey AS class, 'get' || p_size AS method, 0 AS parameter_no, 'Map<String, D' || (p_partkey % 13) || '>' AS type, 'in' AS name FROM part
    UNION ALL SELECT {REPO}, 'P' || p_partkey, 'p' || p_size, 0, 'String', 'a' FROM part
    UNION ALL SELECT {REPO}, 'P' || p_partkey, 'p' || p_size, 1, 'int', 'b' FROM part
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'setCache', 0, 'Map<String, List<D' || (p_partkey % 13) || '>>', 'cache' FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'setDep', 0, 'D' || (p_partkey % 13), 'dep' FROM part WHERE p_partkey % 2 = 0""",
)
def java_parameters(t):
    rows = java.methods(java.java_types(t["service_files"]))
    return rows.select("repository", "class", F.col("name").alias("method"), F.posexplode("parameters").alias("parameter_no", "p")).select(
        "repository", "class", "method", "parameter_no", "p.type", "p.name"
    )


@query(
    "java_direct_dependencies",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS class, 'C' || (p_partkey % 50) AS dependency FROM part
    UNION ALL SELECT {REPO}, 'C' || p_partkey, 'I' || p_size FROM part
    UNION ALL SELECT {REPO}, 'N' || p_partkey, 'I' || p_size FROM part
    UNION ALL SELECT {REPO}, 'N' || p_partkey, 'D' || (p_partkey % 13) FROM part""",
)
def java_direct_dependencies(t):
    types = java.java_types(t["code_files"].unionByName(t["service_files"]))
    return types.select("repository", F.col("name").alias("class"), F.explode("dependencies").alias("dependency"))


@query(
    "edges_field_injection",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS src, 'C' || ((p_partkey * 7 + 3) % 97) AS dst, 5 AS line, 'Field at line 5' AS usage FROM part
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'D' || (p_partkey % 13), 7, 'Field at line 7' FROM part
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'E' || (p_partkey % 5), 14, 'Field at line 14' FROM part
    UNION ALL SELECT {REPO}, 'N' || p_partkey, 'E' || (p_partkey % 5), 14, 'Field at line 14' FROM part""",
)
def edges_field_injection(t):
    rows = java.edges(java.java_types(t["code_files"].unionByName(t["service_files"])))
    return rows.where(F.col("type") == "field_injection").select("repository", "src", "dst", "line", F.array_join("usage", ";").alias("usage"))


@query(
    "edges_inheritance",
    f"""SELECT {REPO} AS repository, 'C' || p_partkey AS src, 'C' || (p_partkey % 50) AS dst, 'extends' AS type, 4 AS line FROM part
    UNION ALL SELECT {REPO}, 'C' || p_partkey, 'I' || p_size, 'implements', 4 FROM part
    UNION ALL SELECT {REPO}, 'N' || p_partkey, 'I' || p_size, 'implements', 13 FROM part
    UNION ALL SELECT {REPO}, 'N' || p_partkey, 'D' || (p_partkey % 13), 'implements', 13 FROM part""",
)
def edges_inheritance(t):
    rows = java.edges(java.java_types(t["code_files"].unionByName(t["service_files"])))
    return rows.where(F.col("type").isin("extends", "implements")).select("repository", "src", "dst", "type", "line")


@query(
    "java_annotations",
    f"""SELECT {REPO} AS repository, 'S' || p_partkey AS class, NULL::VARCHAR AS method, '@Service' AS annotation FROM part
    UNION ALL SELECT {REPO}, 'S' || p_partkey, NULL, CASE WHEN p_partkey % 2 = 0 THEN '@Data' ELSE '@Deprecated' END FROM part
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'get' || p_size, '@GetMapping' FROM part""",
)
def java_annotations(t):
    types = java.java_types(t["service_files"])
    on_class = F.transform("annotations", lambda a: F.struct(F.lit(None).cast("string").alias("method"), a.alias("annotation")))
    on_methods = F.flatten(
        F.transform("methods", lambda m: F.transform(m["annotations"], lambda a: F.struct(m["name"].alias("method"), a.alias("annotation"))))
    )
    rows = types.select("repository", F.col("name").alias("class"), F.explode(F.concat(on_class, on_methods)).alias("a"))
    return rows.select("repository", "class", "a.method", "a.annotation")


@query(
    "java_generated_accessors",
    f"""WITH e AS (SELECT * FROM part WHERE p_partkey % 2 = 0)
    SELECT {REPO} AS repository, 'S' || p_partkey AS class, 'Map<String, List<D' || (p_partkey % 13) || '>> getCache()' AS signature, 6 AS line FROM e
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'void setCache(Map<String, List<D' || (p_partkey % 13) || '>> cache)', 6 FROM e
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'D' || (p_partkey % 13) || ' getDep()', 7 FROM e
    UNION ALL SELECT {REPO}, 'S' || p_partkey, 'void setDep(D' || (p_partkey % 13) || ' dep)', 7 FROM e""",
)
def java_generated_accessors(t):
    rows = java.methods(java.java_types(t["service_files"]))
    return rows.where("generated").select("repository", "class", "signature", "line")


@query(
    "java_endpoints",
    f"""SELECT {REPO} AS repository, 'S' || p_partkey AS class, 'get' || p_size AS method,
    'String get' || p_size || '(Map<String, D' || (p_partkey % 13) || '> in)' AS signature, 8 AS line FROM part""",
)
def java_endpoints(t):
    rows = java.methods(java.java_types(t["service_files"]))
    endpoint = F.exists("annotations", lambda a: a.isin(java.ENDPOINT_ANNOTATIONS))
    return rows.where(endpoint).select("repository", "class", F.col("name").alias("method"), "signature", "line")


@query(
    "code_fragments",
    f"""SELECT {REPO} AS repository, {SVC} AS file_path, 'S' || p_partkey AS class_name, 'get' || p_size AS function_name, 4 AS lines_of_code,
    'get' || p_size || ' @GetMapping("/x/{{id}}") String get' || p_size || '(@Path("id") Map<String, D' || (p_partkey % 13) || '> in, int... more) {{ return "}} class Fake {{"; }}' AS document,
    p_partkey % 4 = 0 AS is_test_file, true AS has_comments FROM part
    UNION ALL SELECT {REPO}, {SVC}, 'P' || p_partkey, 'p' || p_size, 3,
    'p' || p_size || ' void p' || p_size || '( String a, final int b);', p_partkey % 4 = 0, false FROM part""",
)
def code_fragments(t):
    rows = java.fragments(t["service_files"])
    return rows.select(
        "repository", "file_path", "class_name", "function_name", "lines_of_code", "document", "is_test_file", "has_comments"
    )
