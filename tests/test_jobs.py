"""Sources, store, patches, reviews and vectors on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from code_impact.operators import events, index, patch, review, vectors
from code_impact.operators.index import build_index, index_stats
from code_impact.sources.code_files import scan_code_files
from code_impact.sources.store import IndexStore, stage_artifacts

CHANGE = "repository string, pr_number long, file_no int, filename string, status string, additions long, deletions long, patch string"


@pytest.fixture()
def files(spark):
    rows = [("org/a", "A.java", "class A { public void go(int x) { } }"), ("org/a", "B.java", "class B extends A { }"), ("org/b", "C.java", "class C { }")]
    return spark.createDataFrame(rows, "repository string, path string, content string")


def test_scan(spark, tmp_path):
    made = {
        "src/A.java": b"class A { }", "node_modules/x/i.js": b"x", "src/build/B.java": b"class B { }", "bad.py": b"\xff\xfeok", "e.txt": b"",
        "a/__init__.py": b"1", "a/b/c/_b.ts": b"2", ".eslintrc.js": b"3", "a/__tests__/c.ts": b"4", ".github/d.py": b"5", "a/b/c/d/Empty.java": b"",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for root in (str(tmp_path), tmp_path.as_uri() + "/"):
        found = {r["path"]: r for r in scan_code_files(spark, root, "org/x").collect()}
        assert set(found) == {name for name in made if "node_modules" not in name and "build" not in name}
        assert found["bad.py"]["content"].endswith("ok") and "\ufffd" in found["bad.py"]["content"]
        assert found["src/A.java"]["size"] == 11 and found["e.txt"]["content"] == ""
    assert {r["path"] for r in scan_code_files(spark, str(tmp_path), "org/x", "*.py").collect()} == {"bad.py", "a/__init__.py", ".github/d.py"}


def test_store(spark, tmp_path, files):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.load() is None
    store.save(build_index(files), "2024-01-01")
    store.save(build_index(files.where("repository = 'org/a'")), "2024-03-01")
    assert {r["repository"] for r in store.list().collect()} == {"org/a", "org/b"}
    assert store.require("org/a")["classes"].count() == 2
    with pytest.raises(LookupError):
        store.require("org/none")
    asked = spark.createDataFrame([("org/a",), ("org/none",)], "repository string")
    assert {(r["repository"], r["found"]) for r in store.exists(asked).collect()} == {("org/a", True), ("org/none", False)}
    assert store.load(snapshot_date="2024-03-01")["files"].count() == 2
    store.compact_history(str(tmp_path / "kept"), "2024-03-10")
    kept = spark.read.parquet(str(tmp_path / "kept" / "files")).select("repository", "snapshot_date").distinct().collect()
    assert {(r["repository"], str(r["snapshot_date"])) for r in kept} == {("org/a", "2024-03-01"), ("org/b", "2024-01-01")}
    # A second save with less leaves nothing of the first.
    store.save(build_index(files.where("path = 'A.java'")))
    assert [store.require("org/a")[p].count() for p in ("files", "classes", "edges")] == [1, 1, 0]
    assert store.require("org/b")["classes"].count() == 1
    store.delete("org/b")
    assert {r["repository"] for r in store.list().collect()} == {"org/a"}


def test_stage_artifacts(spark, tmp_path):
    jobs = spark.createDataFrame([("org/a", 7, "j1")], "repository string, pr_number long, job_id string")
    row = stage_artifacts(jobs, str(tmp_path / "art")).first()
    assert row["index_key"] == "org/a/7/j1/dependency-index.json"


def test_analysis(spark, files):
    index = build_index(files)
    patch_text = "@@ -1,2 +1,1 @@\n-    public void go(int x) {\n ctx\n--- public void no() {"
    rows = [
        ("org/a", 1, 1, "A.java", "modified", 1, 1, patch_text),
        ("org/a", 2, 1, "README.md", "modified", 1, 1, None),
        ("org/none", 3, 1, "A.java", "removed", 1, 1, patch_text),
    ]
    changes = spark.createDataFrame(rows, CHANGE)
    found = {r["pr_number"]: r for r in patch.analyze(changes, index).collect()}
    assert (found[1]["breaking_changes"], found[1]["affected_files"], found[1]["affected_classes"], found[1]["risk_level"]) == (1, 2, 2, "medium")
    assert found[1]["summary"] == "1 potential breaking changes detected. 2 files potentially affected. 2 classes impacted. Risk level: medium"
    assert found[2]["summary"] == "Risk level: low"
    assert found[3]["summary"] == "No dependency index available for analysis"
    names = [r["method_name"] for r in patch.breaking_changes(changes, index).collect()]
    assert names == ["go"]


def test_diff_lines_of_two_hunks(spark):
    text = "@@ -1,2 +5,3 @@ head\n a\n-b\n+c\n@@ -20,1 +30,5 @@\n+d\n e\n f\n\\ No newline at end of file\n"
    changes = spark.createDataFrame([("r", 1, 1, "x", "modified", 0, 0, text), ("r", 1, 2, "y", "modified", 0, 0, None)], CHANGE)
    found = {r["diff_line"]: r["file_line"] for r in patch.diff_line_map(changes).collect()}
    assert found[1] == 5 and found[2] is None and found[3] == 6
    assert found[4] == 33


def test_review_with_prose_and_missing_lines(spark):
    text = 'Sure:\n```json\n{"summary":"","issues":[{"type":"bug","severity":"high","file":"a","description":"d"}],"suggestions":[{"type":"best-practice","file":"a","line":2,"description":"x","code":"y"}]}\n```\nbye'
    reviews = review.parse_reviews(spark.createDataFrame([(1, text), (2, "```json\n{bad\n```")], "job_id long, response string"))
    jobs = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "job_id long, valid_files long")
    found = {r["job_id"]: r for r in review.review_results(jobs, reviews).collect()}
    assert (found[1]["summary"], found[1]["score"], found[1]["risk_level"]) == (review.DONE, 92, "medium")
    assert found[2]["summary"] == review.UNREADABLE
    assert (found[3]["summary"], found[3]["score"]) == (review.NOTHING_TO_REVIEW, 100)
    comments = review.review_comments(review.review_results(jobs, reviews)).where("job_id = 1").collect()
    assert [c["kind"] for c in comments] == ["summary", "suggestion"]
    assert comments[1]["body"] == "**💡 BEST PRACTICE**\n\nx\n\n```\ny\n```"


def test_own_errors_keep_their_code(spark):
    rows = [("NotFoundError", "timeout", None), ("GitHubAPIError", "x", 418), ("OddException", "x", None), ("HttpError", "x", 500)]
    found = events.classify_errors(spark.createDataFrame(rows, "name string, message string, http_status int")).collect()
    assert [(r["code"], r["status"]) for r in found] == [("NOT_FOUND_ERROR", 404), ("GITHUB_API_ERROR", 418), ("AWS_ERROR", 502), ("GITHUB_API_ERROR", 502)]


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(3)
    data, asked = rng.normal(size=(400, 8)), rng.normal(size=(9, 8))
    collection = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    found = vectors.top_k(collection, queries, 5, block=4).collect()
    scores = (data / np.linalg.norm(data, axis=1, keepdims=True)) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T
    expected = {(q, int(v)) for q in range(9) for v in np.argsort(-scores[:, q])[:5]}
    assert {(r["query_id"], r["vec_id"]) for r in found} == expected


def test_odd_inputs(spark):
    from code_impact.functions.text import redact
    from code_impact.operators import imports, manifests
    from pyspark.sql import functions as F

    hidden = spark.sql("SELECT map('apiToken', array('s'), 'ok', array('v')) AS m, map('password', named_struct('a', 1), 'x', named_struct('a', 2)) AS p")
    row = hidden.select(*[redact(F.col(f.name), f.dataType).alias(f.name) for f in hidden.schema]).first()
    assert row["m"] == {"apiToken": None, "ok": ["v"]} and row["p"]["password"] is None and row["p"]["x"]["a"] == 2
    cases = [("2.5.0", ">= 1.0.0, < 2.0.0", False), ("1.5", ">= 1.0.0, < 2.0.0", True), ("1.0", "= 1.0.0", True), ("1.0.0", "<= 1.0", True), ("x", "< 1", False), ("3", None, True)]
    ranges = spark.createDataFrame([c[:2] for c in cases], "v string, r string").select(manifests.in_range(F.col("v"), F.col("r")).alias("in"))
    assert [r["in"] for r in ranges.collect()] == [c[2] for c in cases]
    lock = '{"packages": {"node_modules/a": {"version": "4.10.0"}, "node_modules/b/node_modules/a": {"version": "4.9.0"}}}'
    locked = manifests.npm_lock(spark.createDataFrame([(1, "p", lock)], "project_id int, path string, content string"))
    packages = spark.createDataFrame([(1, "a")], "project_id int, name string")
    assert manifests.enrich_lock(packages, locked).first()["resolved_version"] == "4.10.0"
    pip = manifests.pip_packages(spark.createDataFrame([(1, "p", "a[x,y]>=2\nb ~= 1.4")], "project_id int, path string, content string"))
    assert {(r["name"], r["version"]) for r in pip.collect()} == {("a", ">=2"), ("b", "~=1.4")}
    pipfile = manifests.pipfile_packages(spark.createDataFrame([(1, "p", '[packages]\na = "==1.2"\nb = {version = "*", extras = ["x"]}')], "project_id int, path string, content string"))
    assert {(r["name"], r["version"]) for r in pipfile.collect()} == {("a", "==1.2"), ("b", "*")}
    py = imports.py_imports(spark.createDataFrame([(1, "p", "import a.b as c, d, e\nimport f # g")], "project_id int, path string, source string"))
    assert {r["module"] for r in py.collect()} == {"a", "d", "e", "f"}
    collection = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in vectors.top_k(collection, asked, 3).collect()] == [(7, 1)]


def test_incremental_index(spark):
    """Only files whose content differs from the stored hash are read again; a hash that is missing counts as different."""
    schema = "repository string, path string, content string"
    old = [("r", f"{n}.java", f"public class {n} {{ }}") for n in "ABCD"]
    new = [old[0], ("r", "B.java", "public class B2 { }"), old[3], ("r", "E.java", "public class E { }"), ("r", "x.md", "text")]
    before, after = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    files = index.build_index(before)["files"].withColumn("content_hash", F.when(F.col("path") != "D.java", F.col("content_hash")))
    changes = {(r["path"], r["change"]) for r in index.file_changes_since(files, after).collect()}
    assert changes == {("B.java", "changed"), ("C.java", "deleted"), ("D.java", "changed"), ("E.java", "added")}
    found = index.incremental_types(index.extract_types(before), files, after)
    assert {(r["path"], r["name"]) for r in found.collect()} == {("A.java", "A"), ("B.java", "B2"), ("D.java", "D"), ("E.java", "E")}
