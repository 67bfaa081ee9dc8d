"""Call sites of Java methods: who calls which method of which class, and how many sites a breaking change hits.

A call's receiver is typed by what is in scope of it: variables declared before it in the body, then parameters, fields of its
class and of the classes around it, fields of superclasses, or the class it names. The method is then looked for in that
type and, where it is not declared there, in its superclasses and interfaces, nearest first. Overloads share a name and are
not told apart. Calls on the result of a call, and on fields of other objects, have no type and are left out; so are calls of
types that the repository does not declare.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from code_impact.operators import java
from code_impact.session import cut_lineage

# Names and chains are possessive, as what follows a name or a blank is neither; a name is looked for by its first character.
_NAME = r"[A-Za-z_$][\w$]*+"
_MORE = rf"(?:\s*+\.\s*+{_NAME})*+"
_START = r"[A-Za-z_$](?<![\w$.][\s\S])"
_NOT_MADE = r"(?<!\bnew\s{1,9}[\s\S])"
_CALL = rf"{_START}[\w$]*+{_MORE}\s*+\("
_NEW = rf"new(?<=\bnew)\s++({_NAME}{_MORE})\s*+(?:{java._GENERIC}\s*)?\("
_ANY = rf"{_NEW}|{_START}{_NOT_MADE}[\w$]*+{_MORE}\s*+\("
_TYPED = rf"[(;{{}}]\s*(?:final\s+)?([A-Z][\w.]*(?:\s*{java._GENERIC})?(?:\s*\[\s*\])*(?:\s*\|\s*[A-Z][\w.]*)*)\s+({_NAME})\s*(?=[=:;)])"
_MATCHED = rf"\binstanceof\s+(?:final\s+)?([A-Z][\w.]*(?:\s*{java._GENERIC})?)\s+({_NAME})"
_INFERRED = rf"\bvar\s+({_NAME})\s*=\s*new\s+([A-Z][\w.]*)"
_NO_CALL = ["if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "else", "case", "do", "try", "new", "super", "this", "yield"]
_BODY = "struct<class:string,above:array<string>,methods:array<string>,calls:array<struct<method:string,line:int,name:string,made:boolean,type:string,variable:string,inherited:boolean>>>"


def _bare(type_: Column) -> Column:
    """Simple name of a type without package, type arguments and brackets."""
    return F.regexp_extract(type_, r"^(?:[\w$]+\s*\.\s*)*([\w$]+)", 1)


def _reading() -> Callable[[pa.Array], pa.Array]:
    """The types of each source file of a batch, with their calls. A nested function goes to Python workers by value, which need not find
    this package, so all it uses is built in here. Names and blanks are ASCII as in the patterns of ``java``, ends of words are not.

    Calls and variables are looked for in a whole file at once, as neither reaches over a ``;`` or a brace; heads of types and members
    are read one by one.
    """

    def compiled(pattern: str) -> re.Pattern:
        return re.compile(pattern.replace(r"\b", r"(?u:\b)"), re.ASCII)

    def both(pattern: str) -> tuple[re.Pattern, re.Pattern]:
        """The patterns for texts without and with type arguments."""
        return compiled(java.without_generics(pattern)), compiled(pattern)

    # Type arguments end before a delimiter. Python looks back over one width at a time.
    not_made = "".join(_NOT_MADE.replace("{1,9}", f"{{{k}}}") for k in range(1, 10))
    whole_file = lambda pattern: compiled(pattern.replace("[^<>]", "[^<>;{}]").replace(_NOT_MADE, not_made))
    call, call_or_new, typed, matched, inferred = (whole_file(p) for p in (_CALL, _ANY, _TYPED, _MATCHED, _INFERRED))
    listed = both(rf"\binterface\s+\w+\s*(?:{java._GENERIC})?\s*extends\s+([\s\S]*?)(?:\bpermits\b[\s\S]*)?\{{$")
    a_type, header, field, head = both(java._TYPE), compiled(java._TYPE_HEADER), both(java._FIELD), both(java._METHOD)
    annotation, parameter = compiled(java._ANNOTATION), both(java._PARAMETER)
    literal = compiled(java._LITERAL_OR_COMMENT.replace(r"\\.", r"\\[^\n\r\x85\u2028\u2029]"))
    named = compiled(r"^([\s\S]*\S)\s+(\w+)(?:\s*\[\s*\])*$")
    final, bare, visible = compiled(r"^(?:final\s+)+"), compiled(r"^(?:[\w$]+\s*\.\s*)*([\w$]+)"), compiled(r"\S")
    delimiter, in_annotation = compiled(r"[;{}]"), str.maketrans("{};", "   ")
    space, not_a_type, no_call = java._SPACE, frozenset(java._NOT_A_TYPE), frozenset(_NO_CALL)
    rows_type = pa.list_(
        pa.struct(
            [
                ("class", pa.string()),
                ("above", pa.list_(pa.string())),
                ("methods", pa.list_(pa.string())),
                (
                    "calls",
                    pa.list_(
                        pa.struct(
                            [
                                ("method", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("made", pa.bool_()), ("type", pa.string()),
                                ("variable", pa.string()), ("inherited", pa.bool_()),
                            ]
                        )
                    ),
                ),
            ]
        )
    )

    def cleaned(text: str) -> str:
        """``java.clean_source``."""
        if "/" in text or '"' in text or "'" in text:
            text = literal.sub(lambda t: (" " if t.group()[0] == "/" else '""') + "\n" * t.group().count("\n"), text)
        return annotation.sub(lambda t: t.group().translate(in_annotation), text) if "@" in text else text

    def bare_of(type_: str) -> str:
        found = bare.match(type_)
        return found.group(1) if found else ""

    def plain_of(text: str) -> str:
        return annotation.sub("", text) if "@" in text else text

    def parameters_of(text: str) -> dict[str, str]:
        """Types by name, of equal names the first."""
        found: dict[str, str] = {}
        for piece in parameter["<" in text].findall(text):
            piece = piece.strip(space)
            if piece.startswith("final"):
                piece = final.sub("", piece)
            pair = named.match(piece)
            if pair and "..." not in piece:
                found.setdefault(pair.group(2), bare_of(pair.group(1)))
        return found

    def fields_of(plains: list[str]) -> dict[str, str]:
        found: dict[str, str] = {}
        for plain in plains:
            pair = field["<" in plain].match(plain)
            if pair and pair.group(1) not in not_a_type:
                found.setdefault(pair.group(2), bare_of(pair.group(1)))
        return found

    def tokens_of(text: str) -> list[tuple[int, str, str, bool]]:
        """Calls: (position, path, name, whether an object is made)."""
        found = []
        new = "new" in text
        for token in (call_or_new if new else call).finditer(text):
            if new and (made := token.group(1)):
                path, called, is_made = "", bare_of(made), True
            else:
                path, _, called = token.group()[:-1].rpartition(".")
                called, path, is_made = called.strip(space), "".join(path.split()), False
            if called not in no_call:
                found.append((token.start(), path, called, is_made))
        return found

    def variables_of(text: str) -> list[tuple[int, int, str, str]]:
        """Variables: (position of the name, order among those of a segment, name, type). A text begins with a delimiter."""
        found = [(v.start(2), 0, v.group(2), v.group(1)) for v in typed.finditer(text)]
        if "instanceof" in text:
            found += [(v.start(2), 1, v.group(2), v.group(1)) for v in matched.finditer(text)]
        if "var" in text and "new" in text:
            found += [(v.start(1), 2, v.group(1), v.group(2)) for v in inferred.finditer(text)]
        return found

    def read_file(text: str, put: Callable) -> int:
        """Hands each type of a file to ``put`` and returns their number."""
        # Positions count from a delimiter in front of the file. Segment i ends at delimiter i + 1.
        text = ";" + cleaned(text)
        cuts = [d.start() for d in delimiter.finditer(text)]
        size = len(cuts) - 1
        segment = lambda i: text[cuts[i] + 1 : cuts[i + 1] + 1]
        # Blocks as they open and close: where the block of a segment ends, and for types their direct members.
        ends, blocks, types = [size] * size, [], {}
        for i in range(size):
            last = text[cuts[i + 1]]
            if last == "}":
                if blocks:
                    ends[blocks.pop()[0]] = i
                continue
            if blocks and (members := blocks[-1][1]) is not None:
                members.append(i)
            if last == "{":
                members, plain = None, plain_of(segment(i))
                if found := header.match(plain):
                    members = []
                    types[i] = (found.group(2), plain, members)
                blocks.append((i, members))
        if not types:
            return 0
        inner = list(types)
        tokens, variables = tokens_of(text), sorted((bisect_left(cuts, v[0]) - 1, v[1], v[0], v[2], v[3]) for v in variables_of(text))
        token_places, variable_places = [bisect_left(cuts, t[0]) - 1 for t in tokens], [v[0] for v in variables]
        at, line, lines = 0, 1, []
        for token in tokens:
            line += text.count("\n", at, token[0])
            at = token[0]
            lines.append(line)

        def parts(i: int) -> list[tuple[int, int]]:
            """First and last segments of the block that a segment opens, without the types declared in it."""
            found, first, last, k = [], i + 1, min(ends[i], size - 1), bisect_right(inner, i)
            while k < len(inner) and inner[k] <= last:
                found.append((first, inner[k] - 1))
                first = ends[inner[k]] + 1
                k = bisect_left(inner, first, k + 1)
            return [*found, (first, last)]

        def read_member(m: int, of_value: bool) -> tuple[list, dict]:
            """Calls (segment, line, path, name, made), and places and types of variables by name."""
            calls, declares = [], []
            if of_value:
                # What a field is set to.
                before, _, after = segment(m).partition("=")
                value = ";" + visible.sub("_", before) + "=" + after
                if "(" in after:
                    first = 1 + text.count("\n", 0, cuts[m])
                    calls += [(m, first + value.count("\n", 0, t[0]), *t[1:]) for t in tokens_of(value)]
                declares += sorted((m, v[1], v[0], v[2], v[3]) for v in variables_of(value))
            if text[cuts[m + 1]] == "{":
                seen, declared = -1, None
                for first, last in parts(m):
                    for k in range(bisect_left(token_places, first), bisect_right(token_places, last)):
                        place = token_places[k]
                        if place != seen:
                            # A block's head that declares a method, in a class without a name, calls nothing.
                            seen, declared = place, None
                            if text[cuts[place + 1]] == "{":
                                txt = segment(place)
                                of = head["<" in txt].match(txt)
                                if of and of.group(2) and of.group(2) not in not_a_type:
                                    declared = of.group(3)
                        if tokens[k][2] != declared:
                            calls.append((place, lines[k], *tokens[k][1:]))
                    if first <= last:
                        declares += variables[bisect_left(variable_places, first) : bisect_right(variable_places, last)]
            found: dict[str, tuple[list, list]] = {}
            for place, _order, _at, variable, type_ in declares if calls else ():
                places, named_types = found.setdefault(variable, ([], []))
                places.append(place)
                named_types.append(bare_of(type_))
            return calls, found

        around: list[tuple[int, dict]] = []
        for i, (owner, plain, members) in types.items():
            while around and around[-1][0] < i:
                around.pop()
            plains = [plain_of(segment(m)) for m in members]
            around.append((ends[i], fields_of(plains)))
            extends = listed["<" in plain].search(plain) if "interface" in plain else None
            above = [bare_of(t) for t in a_type["<" in extends.group(1)].findall(extends.group(1))] if extends else []
            methods, out = [], []
            for m, plain in zip(members, plains, strict=True):
                if m in types:
                    continue
                method, parameters = None, ""
                if "(" in plain and (of := head["<" in plain].match(plain)):
                    returns, word, parameters = of.group(2) or "", of.group(3), of.group(4)
                    if (returns or word == owner) and returns not in not_a_type:
                        method = word
                        methods.append(word)
                calls, known = read_member(m, method is None and "=" in segment(m))
                scope = parameters_of(parameters) if calls and parameters else {}
                for place, on, path, called, made in calls:
                    type_ = variable = None
                    if made:
                        type_ = called
                    elif path in ("", "this", "super"):
                        type_ = owner
                    else:
                        first, _, last = path.rpartition(".")
                        upper = "A" <= last[0] <= "Z"
                        if first and first != "this":
                            if not upper:
                                continue
                            type_ = last
                        else:
                            if not first:
                                places, named_types = known.get(last, ((), ()))
                                before = bisect_right(places, place)
                                type_ = named_types[before - 1] if before else scope.get(last)
                            if type_ is None:
                                type_ = next((fields[last] for _end, fields in reversed(around) if last in fields), last if upper and not first else None)
                            variable = last if type_ is None else None
                    out.append((method, on, called, made, type_, variable, path == "super"))
            put(owner, above, methods, out)
        return len(types)

    def read(texts: pa.Array) -> pa.Array:
        per_file, owners, above, methods, calls = [0], [], [], [], []
        above_ends, method_ends, call_ends = [0], [0], [0]

        def put(owner: str, up: list, own: list, out: list) -> None:
            owners.append(owner)
            above.extend(up)
            methods.extend(own)
            calls.extend(out)
            above_ends.append(len(above))
            method_ends.append(len(methods))
            call_ends.append(len(calls))

        for text in texts.cast(pa.binary()).to_pylist():
            per_file.append(per_file[-1] + (0 if text is None else read_file(text.decode("utf-8", "replace"), put)))
        number = lambda values: pa.array(values, pa.int32())
        call_type = rows_type.value_type.field("calls").type.value_type
        columns = [pa.array(c, f.type) for c, f in zip(zip(*calls, strict=True) if calls else [[]] * call_type.num_fields, call_type, strict=True)]
        parts = [
            pa.array(owners, pa.string()),
            pa.ListArray.from_arrays(number(above_ends), pa.array(above, pa.string())),
            pa.ListArray.from_arrays(number(method_ends), pa.array(methods, pa.string())),
            pa.ListArray.from_arrays(number(call_ends), pa.StructArray.from_arrays(columns, fields=list(call_type))),
        ]
        return pa.ListArray.from_arrays(number(per_file), pa.StructArray.from_arrays(parts, fields=list(rows_type.value_type)))

    return read


def _bodies(files: DataFrame) -> DataFrame:
    """(repository, file, class, above, methods, calls): one row per type. ``above`` are the interfaces an interface extends, which the
    index has no edges for; ``methods`` the names of its methods. A call has the method it stands in, null in an initialiser, and the
    type of its receiver, or ``variable`` where only a field of a superclass can have that name; calls with neither are left out.
    """
    read = F.arrow_udf(_reading(), f"array<{_BODY}>")("content")
    return files.select("repository", F.col("path").alias("file"), F.explode(read).alias("t")).select("repository", "file", "t.*")


def nearest(asked: DataFrame, members: DataFrame, parents: DataFrame) -> DataFrame:
    """For asked (repository, name, member) the nearest type that has the member: (repository, name, member, owner, value).

    ``members`` has (repository, name, member, value), ``parents`` (repository, name, parent, place). A type that lacks the member hands
    the question to its parents; of types equally near the first by ``place`` and name counts. A question is followed once for each type
    it comes to, however many types hand it on, and not at all if no type of the repository has the member; then answers go back down
    from type to type. Rounds are as many as the hierarchy is deep, and a cycle of parents ends where it began.
    """
    key = ["repository", "at", "member"]
    of = members.select("repository", F.col("name").alias("at"), "member", "value")
    up = parents.select("repository", F.col("name").alias("at"), "parent", "place")
    together = lambda tables: reduce(DataFrame.unionByName, tables)
    first = asked.select("repository", F.col("name").alias("at"), "member").distinct()
    first = first.join(members.select("repository", "member").distinct(), ["repository", "member"], "left_semi")
    states, links = [cut_lineage(first.select(*key, F.lit(True).alias("asked")))], []
    while not states[-1].isEmpty():
        links.append(cut_lineage(states[-1].join(of, key, "left_anti").join(up, ["repository", "at"])))
        above = links[-1].select("repository", F.col("parent").alias("at"), "member").distinct()
        states.append(cut_lineage(above.join(together(states), key, "left_anti").withColumn("asked", F.lit(False))))

    own = together(states).join(of, key).dropDuplicates(key)
    solved = [cut_lineage(own.select(*key, "asked", F.col("at").alias("owner"), "value", F.lit(None).cast(up.schema["place"].dataType).alias("place")))]
    while links and not solved[-1].isEmpty():
        # The place that counts is that of the step to the owner.
        of_parent = solved[-1].select("repository", F.col("at").alias("parent"), "member", "owner", "value", F.col("place").alias("_place"))
        handed = together(links).join(of_parent, ["repository", "parent", "member"]).withColumn("place", F.coalesce("_place", "place"))
        best = F.min_by(F.struct("owner", "value", "place"), F.struct("place", "owner")).alias("w")
        new = handed.join(together(solved), key, "left_anti").groupBy(*key, "asked").agg(best)
        solved.append(cut_lineage(new.select(*key, "asked", "w.*")))
    return together(solved).where("asked").select("repository", F.col("at").alias("name"), "member", "owner", "value")


def call_sites(files: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(repository, file, class, method, line, name, declared_in): one row per call of a method that the repository declares.

    ``class`` and ``method`` are those of the caller, the method null in an initialiser. ``name`` is the method called, the
    class for a constructor. A type stands for all types of its name in the repository, as in the index. Source text stays in its row;
    only calls are joined. Pass ``types`` when the extraction is already stored.
    """
    java_files = files.where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    types = cut_lineage(java.java_types(java_files)) if types is None else types
    bodies = cut_lineage(_bodies(java_files))
    calls = bodies.select("repository", "file", "class", F.explode("calls").alias("c")).select("repository", "file", "class", "c.*")

    classes = bodies.select("repository", "class").distinct()
    own = bodies.select("repository", F.col("class").alias("name"), F.explode("methods").alias("member"))
    public = java.methods(types).select("repository", F.col("class").alias("name"), F.col("name").alias("member"))
    methods = cut_lineage(own.unionByName(public).distinct().withColumn("value", F.lit(True)))
    up = java.edges(types).where(F.col("type").isin("extends", "implements"))
    place = F.min(F.when(F.col("type") == "extends", -1).otherwise(F.col("edge_no")))
    parents = up.groupBy("repository", F.col("src").alias("name"), F.col("dst").alias("parent")).agg(place.alias("place"))
    more = bodies.select("repository", F.col("class").alias("name"), F.posexplode("above").alias("place", "parent"))
    parents = cut_lineage(parents.unionByName(more).groupBy("repository", "name", "parent").agg(F.min("place").alias("place")))

    fields = types.select("repository", "name", F.explode("fields").alias("f")).select("repository", "name", F.col("f.name").alias("member"), _bare(F.col("f.type")).alias("value"))
    fields = fields.groupBy("repository", "name", "member").agg(F.min("value").alias("value"))
    unknown = calls.where("variable IS NOT NULL").select("repository", F.col("class").alias("name"), F.col("variable").alias("member"))
    inherited = nearest(unknown, fields, parents).select("repository", F.col("name").alias("class"), F.col("member").alias("variable"), F.col("value").alias("field_type"))
    of_field = calls.where("variable IS NOT NULL").join(inherited, ["repository", "class", "variable"]).withColumn("type", F.col("field_type")).select(calls.columns)
    typed = calls.where("type IS NOT NULL").unionByName(cut_lineage(of_field.where("type IS NOT NULL")))

    # A call on super begins at the parents.
    above = typed.where("inherited").select("repository", F.col("class").alias("name"), F.col("name").alias("member")).distinct()
    above = above.join(parents, ["repository", "name"]).select("repository", F.col("name").alias("class"), "member", F.col("parent").alias("name"), "place")
    plain = typed.where("NOT made AND NOT inherited").select("repository", F.col("type").alias("name"), F.col("name").alias("member"))
    homes = cut_lineage(nearest(plain.unionByName(above.select("repository", "name", "member")), methods, parents))
    at = lambda type_, owner: homes.select("repository", F.col("name").alias(type_), F.col("member").alias("name"), F.col("owner").alias(owner))
    of_super = above.join(homes.select("repository", "name", "member", "owner"), ["repository", "name", "member"]).groupBy("repository", "class", "member").agg(F.min_by("owner", F.struct("place", "name")).alias("owner"))

    columns = ["repository", "file", "class", "method", "line", "name", "declared_in"]
    made = typed.where("made").join(classes.withColumnRenamed("class", "type"), ["repository", "type"], "left_semi").withColumn("declared_in", F.col("type"))
    called = typed.where("NOT made AND NOT inherited").join(at("type", "declared_in"), ["repository", "type", "name"])
    on_super = typed.where("inherited").join(of_super.select("repository", "class", F.col("member").alias("name"), F.col("owner").alias("declared_in")), ["repository", "class", "name"])
    return made.select(columns).unionByName(called.select(columns)).unionByName(on_super.select(columns))


def call_edges(sites: DataFrame) -> DataFrame:
    """Edges of type method_call: (repository, src, dst, type, file, line: the first, usage: the methods called, in order of name)."""
    grouped = sites.groupBy("repository", F.col("class").alias("src"), F.col("declared_in").alias("dst"))
    first = F.min(F.struct("file", "line"))
    # One entry per method of the class called.
    found = grouped.agg(first.alias("f"), F.sort_array(F.collect_set("name")).alias("usage"), F.count(F.lit(1)).alias("calls"))
    return found.select("repository", "src", "dst", F.lit("method_call").alias("type"), "f.file", "f.line", "usage", "calls")


def breaking_call_sites(breaking: DataFrame, sites: DataFrame) -> DataFrame:
    """Each breaking change with the number of call sites, calling classes and files it hits in other classes.

    A removed class is hit by calls of all its methods and constructors, a method by calls of its name.
    """
    # Only what changed is counted, and sites of one caller are added up once for both counts.
    changed = breaking.select("repository", F.col("class").alias("declared_in")).distinct()
    others = sites.where(F.col("class") != F.col("declared_in")).join(changed, ["repository", "declared_in"], "left_semi")
    others = others.groupBy("repository", "declared_in", "name", "class", "file").agg(F.count(F.lit(1)).alias("n"))
    counts = [F.sum("n").alias("call_sites"), F.count_distinct("class").alias("calling_classes"), F.count_distinct("file").alias("calling_files")]
    # Constructors have the name of their class, which no method change is keyed by unless it is theirs.
    of_method = others.groupBy("repository", F.col("declared_in").alias("class"), F.col("name").alias("method")).agg(*counts)
    of_class = others.groupBy("repository", F.col("declared_in").alias("class")).agg(*counts).withColumn("method", F.lit(None).cast("string"))
    every = of_method.unionByName(of_class).withColumnsRenamed({c: f"_{c}" for c in ("repository", "class", "method")})
    same = (F.col("repository") == F.col("_repository")) & (F.col("class") == F.col("_class")) & F.col("method").eqNullSafe(F.col("_method"))
    return breaking.join(every, same, "left").drop("_repository", "_class", "_method").na.fill(0, ["call_sites", "calling_classes", "calling_files"])
