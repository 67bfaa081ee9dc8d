"""Counts and tables whose work must follow the input, on rows made here."""

import random
import re
import time

from pyspark.sql import functions as F

from __spark_entry__ import queries
from code_impact.operators import calls, java, patch, review
from code_impact.session import cut_lineage
from code_impact.sources.tables import Inputs


def _index(spark, classes, edges):
    """An index of classes (name, path) and edges (src, dst) of one repository."""
    listed = spark.createDataFrame([("r", n, p) for n, p in classes], "repository string, name string, path string")
    return {
        "classes": listed,
        "files": listed.groupBy("repository", "path").agg(F.collect_list("name").alias("classes")),
        "edges": spark.createDataFrame([("r", s, d) for s, d in edges], "repository string, src string, dst string"),
    }


def test_analysis_counts_are_those_of_the_lists(spark):
    dice = random.Random(5)
    # Two classes a file at times, names in two files, users the index has no class of.
    classes = [(f"C{i}", f"f{i // 2 if i < 20 else i}.java") for i in range(60)] + [("C3", "other.java")]
    edges = [(f"C{dice.randrange(80)}", f"C{dice.randrange(12)}") for _ in range(150)] + [(f"C{i}", "C1") for i in range(70)]
    changes = [("r", n % 40, f"f{dice.randrange(30)}.java", "-public void gone() {") for n in range(150)]
    changes += [("r", 41, "pom.xml", None), ("r", None, "f1.java", None), (None, 42, "f1.java", None), ("s", 43, "f1.java", None), ("r", 1, None, None)]
    changes = spark.createDataFrame(changes, "repository string, pr_number long, filename string, patch string").withColumn("file_no", F.lit(1))
    index = _index(spark, classes, edges)
    found = {(r.repository, r.pr_number): (r.affected_files, r.affected_classes) for r in patch.analyze(changes, index).collect()}
    files, named = ({tuple(r)[:2]: r["count"] for r in rows.groupBy("repository", "pr_number").count().collect()} for rows in (patch.affected_files(changes, index), patch.affected_classes(changes, index)))
    known = {k: (files.get(k, 0), named.get(k, 0)) if k[0] == "r" and k[1] is not None else (0, 0) for k in found}
    assert found == known and len(found) == 44
    assert max(n for n, _ in found.values()) > 40


def test_names_in_patches_are_those_of_its_lines(spark):
    text = "@@ -1 +1 @@\n--- public no() {\n-  public A  b (x\n+  public c(\n-protected d()\n+ protected\n-public {\n\n- (public e f\t(\r\n+public\n-public (g("
    rows = spark.createDataFrame([(text,), (None,), ("",)], "patch string")
    p = F.col("patch")
    found = [tuple(r) for r in rows.select(patch.removed_methods(p), patch.modified_methods(p), patch._all_names(p, patch._REMOVED_NAME)).collect()]
    assert found == [(["b", "f"], ["b", "d", "f"], ["b", "f", "public"]), ([], [], []), ([], [], [])]
    plan = rows.select(patch.removed_methods(p))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan and "lambda" not in plan


def test_analysis_of_a_hub_makes_no_pairs(spark):
    """20,000 pull requests change a file with 20,000 users: 400 million pairs."""
    n = 20_000
    users = spark.range(n).select(F.lit("r").alias("repository"), F.concat(F.lit("U"), "id").alias("name"), F.concat("id", F.lit(".java")).alias("path"))
    classes = users.unionByName(spark.createDataFrame([("r", "Hub", "hub.java")], users.schema))
    index = {
        "classes": classes,
        "files": classes.select("repository", "path", F.array("name").alias("classes")),
        "edges": users.select("repository", F.col("name").alias("src"), F.lit("Hub").alias("dst")),
    }
    changes = spark.range(n).select(F.lit("r").alias("repository"), F.col("id").alias("pr_number"), F.lit(1).alias("file_no"), F.lit("hub.java").alias("filename"), F.lit("").alias("patch"))
    start = time.perf_counter()
    rows = patch.analyze(changes, index).groupBy("affected_files", "affected_classes").count().collect()
    assert [tuple(r) for r in rows] == [(n + 1, n + 1, n)]
    assert time.perf_counter() - start < 60


def _named_by_hand(changes, files):
    """Per pull request the paths that hold the lower-cased name of a changed file, other than that file."""
    found = {}
    for repository, number, filename in changes:
        hits = found.setdefault((repository, number), set())
        name = re.sub(r"[.](java|js)", "", (filename or "").split("/")[-1], count=1).lower()
        if repository is not None and number is not None and name:
            hits |= {path for r, path in files if r == repository and name in path and path != filename}
    return found


def test_second_analysis_counts_the_files_that_names_find(spark):
    dice = random.Random(8)
    words = ["a", "ab", "abc", "Abcd", "abcd", "b", "é", "éa", "C1", "c1", "index"]
    path = lambda: "/".join(dice.choice(words) for _ in range(dice.randrange(3))) + "/" + dice.choice(words) + dice.choice([".java", ".js"])
    files = [(dice.choice("rs"), path()) for _ in range(120)] + [("r", "index.js"), ("r", ""), ("t", "x.java"), (None, "a.js")]
    known = [(r, f) for r, f in files if r != "t"]
    changes = [(*known[dice.randrange(120)][:1], n % 70, known[dice.randrange(120)][1]) for n in range(250)]
    changes += [("r", 90, "index.js"), ("r", 91, None), ("r", 92, "a/"), (None, 93, "a.js"), ("r", None, "a.js"), ("t", 94, "lib/x.java"), ("r", 1, "index.js"), ("r", 95, "no/Index.js")]
    by_hand = _named_by_hand(changes, files)
    rows = spark.createDataFrame(changes, "repository string, pr_number long, filename string")
    listed = spark.createDataFrame(files * 2, "repository string, path string")
    whole = {k: set() for k in by_hand}
    for r in patch.affected_files_v2(rows, listed).collect():
        assert r.path not in whole[r.repository, r.pr_number]
        whole[r.repository, r.pr_number].add(r.path)
    assert {k: v for k, v in whole.items() if k[1] is not None} == {k: v for k, v in by_hand.items() if k[1] is not None}
    sums = patch.affected_counts_v2(rows, listed).groupBy("repository", "pr_number").agg(F.sum("affected_files").alias("n")).collect()
    assert {(r.repository, r.pr_number): r.n for r in sums if r.n} == {k: len(v) for k, v in by_hand.items() if v}
    # Files whose own name stands in their path, with and without another file that finds them.
    assert len(by_hand["r", 90]) < len(by_hand["r", 95])


def test_second_analysis_counts_findings_as_its_lists_do(spark):
    gone, moved, pom = "-  public void a(int x) {", "-  public void b() {\n+  public void b(int x) {", "+<artifactId>n</artifactId>\n-<artifactId>o</artifactId>\n+  compile 'g:a:1'"
    changes = [("r", 1, 1, "A.java", "removed", gone), ("r", 1, 2, "A.java", "modified", moved), ("r", 1, 3, "pom.xml", "modified", pom), ("r", 2, 1, "No.java", "removed", gone)]
    changes += [("r", 2, 2, "A.java", "removed", ""), ("r", 3, 1, "A.java", "removed", None), (None, 4, 1, "pom.xml", "modified", pom), ("r", 5, 1, "pom.xml", "modified", None), ("r", 6, 1, None, "modified", gone)]
    changes = spark.createDataFrame(changes, "repository string, pr_number long, file_no int, filename string, status string, patch string")
    files = spark.createDataFrame([("r", "A.java"), ("r", "A.java"), ("r", "lib/a/b.java")], "repository string, path string")
    found = {r.pr_number: (r.critical, r.high, r.affected_files, r.added, r.removed, r.risk_level) for r in patch.analyze_v2(changes, {"files": files}).collect()}
    count = lambda df: {r.pr_number: r["count"] for r in df.where("repository IS NOT NULL").groupBy("pr_number").count().collect()}
    broken = patch.breaking_changes_v2(changes, files)
    lists = [broken.where("severity = 'critical'"), broken.where("severity = 'high'"), patch.affected_files_v2(changes, files), patch.manifest_added(changes), patch.manifest_removed(changes)]
    counts = [count(df) for df in lists]
    assert {n: row[:5] for n, row in found.items()} == {n: tuple(c.get(n, 0) for c in counts) for n in range(1, 7)}
    # Each removed line that says public, the class of the removed file, and the signature that changed.
    assert found[1] == (3, 1, 1, 2, 1, "critical") and found[4] == (0, 0, 0, 0, 0, "low")


def test_second_analysis_makes_no_pairs(spark):
    """20,000 pull requests change a file whose name stands in 20,000 paths: 400 million pairs."""
    n = 20_000
    files = spark.range(n).select(F.lit("r").alias("repository"), F.concat(F.lit("src/hub/F"), "id", F.lit(".java")).alias("path"))
    changes = spark.range(n).select(F.lit("r").alias("repository"), F.col("id").alias("pr_number"), F.lit("Hub.java").alias("filename"), F.lit("modified").alias("status"), F.lit("").alias("patch"))
    start = time.perf_counter()
    rows = patch.analyze_v2(changes, {"files": files}).groupBy("affected_files", "risk_level").count().collect()
    assert [tuple(r) for r in rows] == [(n, "high", n)]
    assert time.perf_counter() - start < 60


def test_places_of_paths_stay_in_the_tasks_that_read_them(spark):
    """Paths of one repository are cut where they are read, not in one task a repository."""
    names = spark.createDataFrame([("r", "hub"), ("r", "x")], "repository string, name string")
    files = spark.range(0, 5000, 1, 8).select(F.lit("r").alias("repository"), F.concat(F.lit("src/hub/F"), "id").alias("path"))
    plan = patch._paths_with(names, files)._jdf.queryExecution().executedPlan().toString()
    places = plan[plan.index("Generate explode") :]
    assert "Exchange hashpartitioning" not in places and "lambda" not in plan


def test_small_files_of_large_rows_are_not_sent_through_the_driver(spark):
    """300,000 paths take 2 MB on disk and 30 MB as rows; the incremental refresh joins such tables."""
    Inputs(spark, "/nowhere")
    rows = spark.range(300_000).select(F.lit("org/repository").alias("repository"), F.concat(F.lit("src/main/java/com/example/"), F.lpad("id", 8, "0")).alias("path"))
    stored = cut_lineage(rows)
    joined = stored.withColumn("n", F.lit(1)).join(stored.select("repository", "path"), ["repository", "path"], "left_anti")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_class_lists_need_no_paths(spark):
    index = _index(spark, [("Hub", "hub.java"), ("U", "u.java")], [("U", "Hub"), ("Gone", "Hub")])
    changes = spark.createDataFrame([("r", 1, 1, "hub.java", None), ("r", 1, 2, "hub.java", None)], "repository string, pr_number int, file_no int, filename string, patch string")
    listed = patch.affected_classes(changes, index)
    assert sorted(r["class"] for r in listed.collect()) == ["Gone", "Hub", "U"]
    assert sorted(r["path"] for r in patch.affected_files(changes, index).collect()) == ["hub.java", "u.java"]
    # No join with the table of classes, and no path beside a class.
    assert listed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def _segments_by_hand(text):
    depth, line, open_, found = 0, 1, [], []
    for i, txt in enumerate(re.findall(r"[^;{}]*[;{}]", text)):
        first = line + re.match(r"[ \t\n\x0b\f\r]*", txt)[0].count("\n")
        found.append([i, txt, (txt[-1] == "{") - (txt[-1] == "}"), depth, first, 2**31 - 1, None])
        line += txt.count("\n")
        if txt[-1] == "{":
            open_.append(i)
        elif txt[-1] == "}" and open_:
            found[open_.pop()][5:] = [i, line]
        depth += found[-1][2]
    return found


def test_segments_are_found_for_a_batch_at_once(spark):
    dice = random.Random(2)
    texts = ["".join(dice.choice(["{", "}", ";", "\n", " \t", "a b", "\r\né"]) for _ in range(dice.randrange(60))) for _ in range(400)]
    texts = [t for t in texts if min(s[3] + s[2] for s in _segments_by_hand(t) or [[0] * 4]) >= 0] + ["", "{" * 300 + "}" * 300, "{};" * 5000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "c string").coalesce(1).select("c", java.segments(F.col("c")).alias("s"))
    found = {r.c: r.s if r.s is None else [list(s) for s in r.s] for r in rows.collect()}
    assert found.pop(None) is None and found == {t: _segments_by_hand(t) for t in texts}
    # No expression is interpreted once per segment.
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_without_type_arguments_find_the_same(spark):
    names = ["_METHOD", "_FIELD", "_ANONYMOUS", "_SUPER", "_INTERFACES", "_PARAMETER"]
    patterns = {n: getattr(java, n) for n in names} | {n: getattr(calls, n) for n in ("_ANY", "_NEW", "_TYPED", "_MATCHED")}
    assert all(java._GENERIC not in java.without_generics(p) and len(java.without_generics(p)) < len(p) / 2 for p in patterns.values())
    parts = ["class A", " extends B", " implements C, D", "public ", "static ", "int ", "Foo ", "x", " = ", "new ", "Bar", "(", ")", "a.b", ", ", " instanceof ", "[]", ";", "{", "\n", ">"]
    dice = random.Random(4)
    texts = spark.createDataFrame([("".join(dice.choice(parts) for _ in range(dice.randrange(1, 12))) + dice.choice(";{"),) for _ in range(5000)], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    same = texts.select(*[(found(p) == found(java.without_generics(p))).alias(n) for n, p in patterns.items()], *[(F.size(found(p)) > 0).alias(f"{n}_hit") for n, p in patterns.items()])
    counts = same.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in same.columns]).first().asDict()
    assert all(counts[n] == 5000 for n in patterns) and all(counts[f"{n}_hit"] > 0 for n in ("_METHOD", "_FIELD", "_PARAMETER", "_ANY", "_SUPER"))


def test_queries_without_row_numbers_sort_no_changes(spark, folder):
    """The change table is neither sorted nor written for queries that read no numbers and no patches."""
    found = queries()
    for name in ("group_changes_by_dir", "pr_totals", "oversize_prs", "review_comments", "first_dependents", "pr_affected_files_v2", "pr_affected_classes_v2"):
        plan = found[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"l_extendedprice#\d+ ASC", plan) and "artifactId" not in plan and "l_partkey" in plan, name


def test_second_analysis_sorts_no_changes(spark, folder, monkeypatch):
    asked = []
    monkeypatch.setattr(Inputs, "stored", lambda self, label, make, was=Inputs.stored: (asked.append(label), was(self, label, make))[1])
    assert queries()["pr_risk_v2"](spark, folder).count() > 0
    assert not {"file_changes", "layered_changes"} & set(asked)


def test_prompts_read_each_page_once(spark):
    """Pages are cut, numbered and collected in one shuffle of the changes; templates are not parsed for each row."""
    schema = "repository string, pr_number long, file_no int, filename string, status string, additions long, deletions long, patch string"
    pom = "+<artifactId>n</artifactId>\n-<artifactId>o</artifactId>"
    rows = [("r", 1, i, f"f{i:03}.java", "modified", 1, 2, f"-public void m{i}() {{") for i in range(2, 120)] + [("r", 1, 1, "skip.bin", "added", 7, 7, "+ protected p ()")]
    rows += [("r", 2, 1, "pom.xml", "modified", 1, 1, pom), ("r", 2, 2, "a.md", "modified", 3, 4, None), ("r", 3, 1, "b.bin", "added", 1, 1, None), (None, 4, 1, "c.md", "added", 1, 1, ""), ("r", 5, 1, None, "added", 1, 1, None)]
    changes = spark.createDataFrame(rows, schema).repartition(4)
    index = _index(spark, [("A", "f002.java"), ("B", "f002.java"), ("Z", "f101.java"), ("U", "u.java")], [("U", "A")])
    pages = review._pages(changes)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    prs = changes.select("repository", "pr_number").distinct().withColumn("title", F.lit("t")).withColumn("author", F.lit(None).cast("string"))
    prompts = review.review_prompts(prs, changes, patch.analyze(changes, index).drop("summary"), index)
    assert "format_string" not in prompts._jdf.queryExecution().optimizedPlan().toString().replace("was removed", "").split("Aggregate")[0]
    found = {r.pr_number: r for r in prompts.collect()}
    assert sorted(found) == [1, 2]
    names = sorted({f"m{i}" for i in range(2, 101)} | {"p"})
    assert f"- Archivos modificados: 99\n- Líneas agregadas: 99\n- Líneas eliminadas: 198" in found[1].head and "- Autor: null\n" in found[1].head
    assert f"- Métodos afectados: {', '.join(names)}\n\n**Breaking" in found[1].impact and "Breaking changes detectados: 3" in found[1].impact
    assert found[1].impact.endswith("**\n- method-removed (high): Public method 'm2' was removed from A\n- method-removed (high): Public method 'm2' was removed from B")
    assert re.findall(r"f\d+", found[1].files_section) == [f"f{i:03}" for i in range(2, 12)]
    assert found[2].impact.endswith("- Métodos afectados: ninguno\n\n**Nuevas Dependencias:** n\n\n**Dependencias Eliminadas:** o")
    assert found[2].files_section == "\n\n**Archivos modificados:**\n\n- **a.md** (modified)\n  - +3 -4\n  \n"


def test_names_on_open_lines_are_found_in_one_pass(spark):
    text = "public a (\n protected b\t(x(\r\nc(\n+ public d\n(\n-é public éf(a(\npublic (g(\n\npublic a()"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "patch string")
    found = rows.select(patch.methods_on_lines(F.col("patch")).alias("m"))
    assert [r.m for r in found.collect()] == [["a", "b", "f", "public"], [], []]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
