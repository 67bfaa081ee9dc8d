"""Schemas of the stored index tables."""

PARAMETERS = "array<struct<type:string,name:string>>"
METHOD = (
    f"name string, signature string, line int, return_type string, parameters {PARAMETERS}, annotations array<string>, end_line int, generated boolean"
)

INDEX_TABLES = {
    "files": "path string, language string, size bigint, last_modified timestamp, content_hash string, classes array<string>, repository string",
    "classes": "name string, path string, package string, kind string, dependencies array<string>, repository string",
    "methods": f"class string, method_no int, {METHOD}, repository string",
    "edges": "src string, dst string, type string, file string, line int, usage array<string>, repository string",
    "languages": "language string, files bigint, repository string",
}
