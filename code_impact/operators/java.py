"""Java declarations from a table of source files.

The whole extraction is a narrow map: every file is cut into segments (text up to ``;``, ``{`` or ``}``) inside its own
row with native array expressions, so source text is never shuffled. One output row per class or interface carries its
methods and edges; ``classes``, ``methods`` and ``edges`` are projections of it.

Works on the text of declarations, not on a syntax tree: comments and string literals are blanked first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.functions.arrays import each, let, newlines, rewrite_tokens

# Types that make no dependency edge.
STANDARD_TYPES = [
    "String", "Integer", "Long", "Double", "Float", "Boolean", "List", "Map", "Set", "Collection", "ArrayList", "HashMap",
    "HashSet", "Optional", "Stream", "Date", "LocalDate", "BigDecimal", "UUID", "Object",
]

# Annotations that make a method reachable from outside, and those that generate accessors.
ENDPOINT_ANNOTATIONS = [
    "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@RequestMapping", "@RestController", "@Controller",
]
ACCESSOR_ANNOTATIONS = ["@Data", "@Getter", "@Setter"]

_LITERAL_OR_COMMENT = r'//[^\n]*|/\*(?s:.*?)\*/|"""(?s:.*?)"""|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)++\''


def _nested(opening: str, closing: str, levels: int = 16) -> str:
    """A bracketed piece with brackets inside, ``levels`` deep."""
    other = rf"[^{opening}{closing}]++"
    found = rf"\{opening}(?:{other})*+\{closing}"
    for _ in range(levels - 1):
        found = rf"\{opening}(?:{other}|{found})*+\{closing}"
    return found


_ANNOTATION = rf"@(?!interface\b)[\w.]+(?:\s*{_nested('(', ')')})?"
_MODIFIER = r"(?:public|protected|private|abstract|static|final|strictfp|sealed|non-sealed|default|synchronized|native|transient|volatile)\s+"
_GENERIC = _nested("<", ">")
_TYPE = rf"[\w.]+(?:\s*{_GENERIC})?(?:\.\w+)*(?:\s*\[\s*\])*"
_TYPE_HEADER = rf"^\s*(?:{_MODIFIER})*(class|interface|enum|record)\s+(\w+)"
_ANONYMOUS = rf"\bnew\s+[\w.]+(?:\s*{_GENERIC})?\s*\([^{{]*\)\s*\{{$"
_METHOD = rf"^\s*((?:{_MODIFIER})*)(?:{_GENERIC}\s*)?(?:({_TYPE})\s+)?(\w+)\s*\(([^)]*)\)[^(=]*[;{{]$"
_FIELD = rf"^\s*(?:{_MODIFIER})*({_TYPE})\s+(\w+)\s*(?:\[\s*\]\s*)*(?:[=,][\s\S]*)?[;{{]$"
_PARAMETER = rf"(?:[^,<>]|{_GENERIC})+"
_NOT_A_TYPE = ["return", "throw", "new", "package", "import", "else", "case", "goto", "assert", "class", "interface", "enum", "record"]


# What the pattern class \\s stands for.
_SPACE = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACE))


def without_generics(pattern: str) -> str:
    """The pattern for texts without ``<``, in which no type arguments can be: it finds the same there, at a fraction of the cost."""
    for optional in (rf"(?:\s*{_GENERIC})?", rf"(?:\s*{_GENERIC}\s*)?", rf"(?:{_GENERIC}\s*)?", rf"(?:{_GENERIC})?"):
        pattern = pattern.replace(optional, "")
    return pattern.replace(rf"(?:[^,<>]|{_GENERIC})+", "[^,<>]+")


def by_generics(text: Column, pattern: str, found: Callable[[str], Column]) -> Column:
    """``found`` for the pattern, or for its short form where the text has no type arguments."""
    return F.when(F.contains(text, F.lit("<")), found(pattern)).otherwise(found(without_generics(pattern)))


def extracted(text: Column, pattern: str, group: int) -> Column:
    return by_generics(text, pattern, lambda p: F.regexp_extract(text, p, group))


def clean_source(content: Column) -> Column:
    """Blank comments and literals, and braces inside annotations; every newline stays."""
    keep_lines = lambda token: F.regexp_replace(token, r"[^\n]", "")
    literal = lambda token: F.when(
        token.startswith("/"), F.concat(F.lit(" "), keep_lines(token))
    ).otherwise(F.concat(F.lit('""'), keep_lines(token)))
    blanked = F.when(content.rlike("[\"'/]"), rewrite_tokens(content, _LITERAL_OR_COMMENT, literal)).otherwise(content)
    without_braces = lambda token: F.regexp_replace(token, "[{};]", " ")
    return let(
        blanked,
        lambda text: F.when(F.contains(text, F.lit("@")), rewrite_tokens(text, _ANNOTATION, without_braces)).otherwise(text),
    )


def segments(cleaned: Column) -> Column:
    """Array of (i, txt, step, depth, line, end, end_line): text up to a delimiter, nesting before it, line of its first
    character; where it opens a block, the segment that closes the block (the largest number if none does) and its last line.
    """

    return F.arrow_udf(_locating(), SEGMENTS)(F.regexp_extract_all(cleaned, F.lit(r"[^;{}]*[;{}]"), F.lit(0)))


_SEGMENT = pa.struct([("i", pa.int32()), ("txt", pa.string()), *[(c, pa.int32()) for c in ("step", "depth", "line", "end", "end_line")]])
SEGMENTS = "array<struct<i:int,txt:string,step:int,depth:int,line:int,end:int,end_line:int>>"


def _locating() -> Callable[[pa.Array], pa.Array]:
    """The segments of the files of a batch, all at once: running sums for nesting and lines, and one sort for the ends, as on one level
    of nesting openings and closings take turns. A nested function goes to Python workers by value, which need not find this package."""

    def located(texts: pa.Array) -> pa.Array:
        txt = texts.flatten().cast(pa.string())
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        file = np.repeat(np.arange(len(sizes)), sizes)
        number = lambda values: values.cast(pa.int64()).to_numpy(zero_copy_only=False)
        step = number(pc.ends_with(txt, "{")) - number(pc.ends_with(txt, "}"))
        lines = number(pc.count_substring(txt, "\n"))
        inner = number(pc.count_substring(pc.ascii_ltrim(txt, _SPACE), "\n"))

        def before(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[:-1] - sums[offsets[file]]

        i, depth, line = np.arange(len(file)) - offsets[file], before(step), before(lines) + lines - inner + 1
        aside = 2**31 - 1
        level = np.where(step == 1, depth, depth - 1)
        turns = np.lexsort((i, level, file))
        turns = turns[step[turns] != 0]
        this, after = turns[:-1], turns[1:]
        paired = (step[this] == 1) & (step[after] == -1) & (level[this] == level[after]) & (file[this] == file[after])
        end, end_line = np.full(len(file), aside), np.zeros(len(file), np.int64)
        end[this[paired]], end_line[this[paired]] = i[after[paired]], (line + inner)[after[paired]]
        whole = lambda values, mask=None: pa.array(values.astype(np.int32), mask=mask)
        columns = [whole(i), txt, whole(step), whole(depth), whole(line), whole(end), whole(end_line, end == aside)]
        rows = pa.StructArray.from_arrays(columns, fields=list(_SEGMENT))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=pc.is_null(texts))

    return located


def _last_line(segment: Column) -> Column:
    return segment["line"] + newlines(_trimmed(segment["txt"]))


def _plain(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, _ANNOTATION, "")).otherwise(text)


def annotations_of(text: Column) -> Column:
    """Names of the annotations among the leading modifiers."""
    head = F.regexp_extract(text, rf"^\s*(?:(?:{_ANNOTATION}|{_MODIFIER})\s*)*", 0)
    found = F.transform(F.regexp_extract_all(head, F.lit(_ANNOTATION), F.lit(0)), lambda a: F.regexp_extract(a, r"^@[\w.]+", 0))
    return F.when(F.contains(text, F.lit("@")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def _has_any(annotations: Column, names: list[str]) -> Column:
    def hit(text: Column) -> Column:
        found = F.lit(False)
        for name in names:
            found = found | F.contains(text, F.lit(name))
        return found

    return F.exists(annotations, hit)


def _types(segs: Column) -> Column:
    """Type declarations and anonymous bodies with the segment that closes each."""

    def describe(s: Column) -> Column:
        return let(_plain(s["txt"]), lambda plain: describe_plain(s, plain))

    def describe_plain(s: Column, plain: Column) -> Column:
        anonymous = F.contains(plain, F.lit("new")) & by_generics(plain, _ANONYMOUS, plain.rlike)
        return let(
            F.regexp_extract(plain, _TYPE_HEADER, 1),
            lambda kind: F.struct(
                s["i"].alias("i"),
                s["depth"].alias("depth"),
                s["line"].alias("line"),
                s["txt"].alias("txt"),
                F.when(kind != "", kind).when(anonymous, F.lit("anonymous")).alias("kind"),
                F.when(kind != "", F.regexp_extract(plain, _TYPE_HEADER, 2)).otherwise(F.lit("")).alias("name"),
                s["end"].alias("end"),
            ),
        )

    opened = F.transform(F.filter(segs, lambda s: s["step"] == 1), describe)
    return F.filter(opened, lambda t: t["kind"].isNotNull())


def members_of(segs: Column, owner: Column) -> Column:
    """Direct members of a type: a slice of the segments, so that types that follow one another are each read once."""
    own = F.slice(segs, owner["i"] + 2, F.greatest(F.lit(0), F.least(owner["end"], F.size(segs)) - owner["i"] - 1))
    return F.filter(own, lambda s: s["depth"] == owner["depth"] + 1)


def is_custom_type(name: Column) -> Column:
    first = F.substring(name, 1, 1)
    return ~name.isin(STANDARD_TYPES) & (F.length(name) > 0) & (first == F.upper(first))


def _parameters(text: Column) -> Column:
    bare = lambda p: F.when(F.startswith(p, F.lit("final")), F.regexp_replace(p, r"^(?:final\s+)+", "")).otherwise(p)
    found = let(text, lambda t: by_generics(t, _PARAMETER, lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))))
    pieces = F.transform(found, lambda p: let(F.trim(p, F.lit(_SPACE)), bare))
    named = r"^([\s\S]*\S)\s+(\w+)(?:\s*\[\s*\])*$"
    formal = F.filter(pieces, lambda p: p.rlike(named) & ~F.contains(p, F.lit("...")))
    return F.transform(
        formal, lambda p: F.struct(F.regexp_extract(p, named, 1).alias("type"), F.regexp_extract(p, named, 2).alias("name"))
    )


def _signature(returns: Column, name: Column, parameters: Column) -> Column:
    args = F.array_join(F.transform(parameters, lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", ")
    return F.concat(F.when(returns != "", F.concat(returns, F.lit(" "))).otherwise(F.lit("")), name, F.lit("("), args, F.lit(")"))


def _method(name, returns, line, parameters, annotations, end, generated: bool = False) -> Column:
    return F.struct(
        name.alias("name"),
        _signature(returns, name, parameters).alias("signature"),
        line.alias("line"),
        returns.alias("return_type"),
        parameters.alias("parameters"),
        annotations.alias("annotations"),
        end.alias("end_line"),
        F.lit(generated).alias("generated"),
    )


def _member_methods(owner: Column, members: Column) -> Column:
    """Public methods and constructors among the direct members."""

    def describe(s: Column) -> Column:
        return let(_plain(s["txt"]), lambda plain: describe_plain(s, plain))

    def describe_plain(s: Column, plain: Column) -> Column:
        group = lambda k: extracted(plain, _METHOD, k)
        found = F.struct(
            group(1).alias("modifiers"),
            group(2).alias("returns"),
            group(3).alias("name"),
            annotations_of(s["txt"]).alias("annotations"),
        )
        return let(
            found,
            lambda m: F.when(
                (m["name"] != "")
                & ((m["returns"] != "") | (m["name"] == owner["name"]))
                & ~m["returns"].isin(_NOT_A_TYPE)
                & (
                    (owner["kind"] == "interface")
                    | F.contains(m["modifiers"], F.lit("public"))
                    | ((m["returns"] == "") & (m["modifiers"] == "") & (F.size(m["annotations"]) == 0))
                    | _has_any(m["annotations"], ENDPOINT_ANNOTATIONS)
                ),
                let(
                    _parameters(group(4)),
                    lambda parameters: _method(
                        m["name"], m["returns"], s["line"], parameters, m["annotations"],
                        F.when(s["step"] == 1, s["end_line"]).otherwise(_last_line(s)),
                    ),
                ),
            ),
        )

    candidates = F.filter(members, lambda s: (s["step"] >= 0) & F.contains(s["txt"], F.lit("(")))
    return F.array_compact(F.transform(candidates, describe))


def _fields(members: Column) -> Column:
    """Fields among the direct members: raw type, first name, line."""
    described = F.transform(
        F.filter(members, lambda s: s["step"] >= 0),
        lambda s: let(
            _plain(s["txt"]),
            lambda plain: let(
                extracted(plain, _FIELD, 2),
                lambda name: F.struct(
                    F.when(name != "", extracted(plain, _FIELD, 1)).otherwise(F.lit("")).alias("type"), name.alias("name"), s["line"].alias("line")
                ),
            ),
        ),
    )
    return F.filter(described, lambda f: (f["name"] != "") & ~f["type"].isin(_NOT_A_TYPE))


def _accessors(fields: Column) -> Column:
    none = F.array().cast("array<struct<type:string,name:string>>")
    empty = F.array().cast("array<string>")

    def pair(f: Column) -> Column:
        suffix = F.concat(F.upper(F.substring(f["name"], 1, 1)), F.substr(f["name"], F.lit(2)))
        setter = F.array(F.struct(f["type"].alias("type"), f["name"].alias("name")))
        return F.array(
            _method(F.concat(F.lit("get"), suffix), f["type"], f["line"], none, empty, f["line"], generated=True),
            _method(F.concat(F.lit("set"), suffix), F.lit("void"), f["line"], setter, empty, f["line"], generated=True),
        )

    return F.flatten(F.transform(fields, pair))


_SUPER = rf"\bclass\s+\w+\s*(?:{_GENERIC})?\s*extends\s+([\w.]+)"
_INTERFACES = rf"\bclass\s+\w+\s*(?:{_GENERIC})?\s*(?:extends\s+[\w.]+(?:\s*{_GENERIC})?\s*)?implements\s+([\s\S]*?)(?:\bpermits\b[\s\S]*)?\{{$"


def _edge(src, dst, kind: str, line, usage=None) -> Column:
    return F.struct(
        src.alias("src"),
        dst.alias("dst"),
        F.lit(kind).alias("type"),
        line.alias("line"),
        (usage if usage is not None else F.lit(None).cast("array<string>")).alias("usage"),
    )


def _line_of(header: Column, line: Column, upto: Column) -> Column:
    """Line inside a header: its first line plus the newlines before an offset (0-based)."""
    return line + newlines(F.substring(_trimmed(header), F.lit(1), upto))


def _inheritance(t: Column) -> Column:
    return let(_trimmed(t["txt"]), lambda trimmed: let(_plain(trimmed), lambda plain: _inheritance_of(t, trimmed, plain)))


def _inheritance_of(t: Column, trimmed: Column, plain: Column) -> Column:
    keyword = lambda word: F.length(F.regexp_extract(trimmed, rf"^([\s\S]*?)\b{word}\b", 1))
    none = F.array().cast("array<struct<src:string,dst:string,type:string,line:int,usage:array<string>>>")
    edge = lambda base: F.when(base != "", F.array(_edge(t["name"], base, "extends", _line_of(t["txt"], t["line"], keyword("extends"))))).otherwise(none)
    extends = F.when(F.contains(plain, F.lit("extends")), let(extracted(plain, _SUPER, 1), edge)).otherwise(none)

    def implements(text: Column) -> Column:
        names = F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))
        first = _line_of(t["txt"], t["line"], keyword("implements"))
        gaps = F.split(F.regexp_extract(trimmed, r"\bimplements\b([\s\S]*)$", 1), r"\w+", -1)
        passed = lambda k: F.aggregate(F.slice(gaps, 1, k + 1), F.lit(0), lambda acc, gap: acc + newlines(gap))
        return F.transform(names, lambda name, k: _edge(t["name"], name, "implements", first + passed(k)))

    listed = lambda clause: F.when(clause != "", implements(clause)).otherwise(none)
    implemented = F.when(F.contains(plain, F.lit("implements")), let(extracted(plain, _INTERFACES, 1), listed)).otherwise(none)
    return F.concat(extends, implemented)


def java_types(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per class or interface: (repository, path, pos, name, kind, package, imports, annotations, dependencies,
    methods, fields, edges). ``pos`` is the order in the file; edges are fields first, then extends, then implements.
    ``keep`` names further input columns to carry."""
    cut, generated, declared, final = _columns(id(SparkContext._gateway))
    keys = ["repository", "path", *keep]
    cleaned = files.select(*keys, cut["_clean"])
    segmented = cleaned.select(*keys, cut["package"], cut["imports"], cut["_segs"])
    typed = segmented.select("*", cut["_types"])
    # The generator is a barrier: segments and types are computed once per file, not once per class. Its input is an
    # expression, so no size filter is inferred and pushed down, which would repeat the parsing.
    rows = typed.select(*keys, "package", "imports", "_segs", "_types", generated)
    return rows.select(*keys, "package", "imports", "pos", *declared).select(*keys, "pos", "name", "kind", "line", "package", *final)


@lru_cache(maxsize=2)
def _columns(_gateway: int) -> tuple:
    """The expressions of ``java_types``. They are thousands of nodes, so they are built once per JVM."""
    cut = {
        "_clean": clean_source(F.col("content")).alias("_clean"),
        "package": F.regexp_extract("_clean", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"),
        "imports": _import_list(F.col("_clean")).alias("imports"),
        "_segs": segments(F.col("_clean")).alias("_segs"),
        "_types": _types(F.col("_segs")).alias("_types"),
    }
    wanted = F.filter("_types", lambda u: u["kind"].isin("class", "interface"))
    t = F.col("_t")
    inside = lambda owner: members_of(F.col("_segs"), owner)
    # Fields of types inside; those of the type itself are read once, for ``fields``.
    with_fields = F.filter("_types", lambda u: (u["i"] > t["i"]) & (u["end"] <= t["end"]) & (u["kind"] != "interface"))
    nested_fields = F.flatten(F.transform(with_fields, lambda u: _fields(inside(u))))
    own_fields = F.filter(inside(t), lambda _s: t["kind"] == "class")
    declared = [
        t["name"].alias("name"),
        t["kind"].alias("kind"),
        t["line"].alias("line"),
        annotations_of(t["txt"]).alias("annotations"),
        _member_methods(t, inside(t)).alias("_methods"),
        _fields(own_fields).alias("fields"),
        nested_fields.alias("_nested"),
        _inheritance(t).alias("_inheritance"),
    ]
    field_edges = F.transform(
        F.array_sort(F.concat("fields", "_nested"), lambda a, b: a["line"] - b["line"]),
        lambda f: let(
            F.coalesce(F.nullif(F.regexp_extract(f["type"], "^([A-Z][a-zA-Z0-9]*)", 1), F.lit("")), f["type"]),
            lambda name: _edge(
                F.col("name"), name, "field_injection", f["line"], F.array(F.concat(F.lit("Field at line "), f["line"].cast("string")))
            ),
        ),
    )
    with_accessors = F.concat("_methods", _accessors(F.col("fields")))
    final = [
        F.col("imports"),
        F.col("annotations"),
        F.transform("_inheritance", lambda e: e["dst"]).alias("dependencies"),
        F.when(_has_any(F.col("annotations"), ACCESSOR_ANNOTATIONS), with_accessors).otherwise(F.col("_methods")).alias("methods"),
        F.col("fields"),
        F.concat(F.filter(field_edges, lambda e: is_custom_type(e["dst"])), F.col("_inheritance")).alias("edges"),
    ]
    return cut, F.posexplode(wanted).alias("pos", "_t"), declared, final


def _import_list(cleaned: Column) -> Column:
    found = F.regexp_extract_all(cleaned, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([^;]+);"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def java_packages(files: DataFrame) -> DataFrame:
    cleaned = clean_source(F.col("content"))
    return files.select("repository", "path", F.regexp_extract(cleaned, r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"))


def java_imports(files: DataFrame) -> DataFrame:
    found = files.select("repository", "path", _import_list(clean_source(F.col("content"))).alias("_imports"))
    return found.select("repository", "path", F.posexplode(each(F.col("_imports"))).alias("pos", "import"))


def classes(types: DataFrame) -> DataFrame:
    return types.select("repository", "path", "pos", "name", "kind", "package", "annotations", "dependencies")


def methods(types: DataFrame) -> DataFrame:
    rows = types.select("repository", "path", F.col("name").alias("class"), F.posexplode(each(F.col("methods"))).alias("method_no", "m"))
    return rows.select("repository", "path", "class", "method_no", "m.*")


def edges(types: DataFrame) -> DataFrame:
    rows = types.select("repository", F.col("path").alias("file"), "pos", F.posexplode(each(F.col("edges"))).alias("edge_no", "e"))
    return rows.select("repository", "file", "pos", "edge_no", "e.*")


def fragments(files: DataFrame) -> DataFrame:
    """Searchable text of each method: comments stripped, white space collapsed, the method name in front.

    Generated accessors have no text of their own and are left out.
    """
    found = java_types(files, keep=("content",))
    written = F.filter("methods", lambda m: ~m["generated"])
    body = lambda lines, m: F.array_join(F.slice(lines, m["line"], m["end_line"] - m["line"] + 1), "\n")
    pieces = let(
        F.split("content", "\n", -1), lambda lines: F.transform(written, lambda m: F.struct(m.alias("m"), body(lines, m).alias("code")))
    )
    # Cut the text before exploding, so that no row carries more of the file than its method.
    rows = found.select("repository", "path", F.col("name").alias("class_name"), F.explode(each(pieces)).alias("p"))
    code = rows.select("repository", "path", "class_name", "p.m", "p.code")
    stripped = F.regexp_replace(F.regexp_replace(F.col("code"), r"/\*[\s\S]*?\*/", ""), r"(?m)//.*$", "")
    normal = F.trim(F.regexp_replace(stripped, r"(?U)\s+", " "))
    return code.select(
        "repository", F.col("path").alias("file_path"), "class_name", F.col("m.name").alias("function_name"),
        F.col("m.line").alias("start_line"), F.col("m.end_line").alias("end_line"), "code",
        F.trim(F.concat_ws(" ", "m.name", normal)).alias("document"),
        (F.col("m.end_line") - F.col("m.line") + 1).alias("lines_of_code"),
        (F.contains("path", F.lit("test")) | F.contains("path", F.lit("spec"))).alias("is_test_file"),
        F.col("code").rlike(r"//|/\*").alias("has_comments"),
    )
