"""Cycles as one node, indexes kept up by a delta, folders listed level by level, lists of large pull requests."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from code_impact.operators import cycles, graph, index, java, maintain, review
from code_impact.session import scratch_path
from code_impact.sources.code_files import scan_code_files

FILES = "repository string, path string, content string"


def links_of(seed, nodes=60, n=90):
    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)}
    return sorted({("a", f"n{u}", f"n{v}") for u, v in pairs} | {("b", f"n{k}", f"n{(k + 1) % 12}") for k in range(12)} | {("c", "x", "x"), ("c", "x", "y")})


def reach(links):
    following = {}
    for r, used, user in links:
        following.setdefault((r, used), set()).add((r, user))
    found = {}
    for start in {(r, n) for r, a, b in links for n in (a, b)}:
        seen, front = set(), [start]
        while front:
            fresh = following.get(front.pop(), set()) - seen
            seen |= fresh
            front += fresh
        found[start] = seen
    return found


@pytest.mark.parametrize("most_links", [0, 1_000_000])
def test_strong_components(spark, most_links):
    links = links_of(3)
    ways = reach(links)
    df = spark.createDataFrame(links, "repository string, used string, user string")
    rows = cycles.strong_components(df, most_links).collect()
    assert {(r.repository, r.node) for r in rows} == set(ways) and len(rows) == len(ways)
    for r in rows:
        node = (r.repository, r.node)
        mutual = {o for o in ways[node] if node in ways[o]} | {node}
        assert r.component == min(n for _, n in mutual)
        assert r.cyclic == (node in ways[node])


def test_components_of_a_long_chain():
    n = 50_000
    chain = np.arange(n - 1)
    assert len(set(cycles.components_of(n, chain, chain + 1).tolist())) == n
    assert set(cycles.components_of(n, np.append(chain, n - 1), np.append(chain + 1, 0)).tolist()) == {0}
    assert cycles.components_of(0, np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_reached_is_the_closure(spark):
    links = links_of(5)
    df = spark.createDataFrame(links, "repository string, used string, user string")
    ways = reach(links)
    starts = spark.createDataFrame([("a", "n1"), ("a", "n7"), ("a", "n7"), ("b", "n3"), ("c", "x"), ("c", "y"), ("a", "nobody"), ("z", "n1")], "repository string, start string")
    found = [tuple(r) for r in graph.reached(df, starts).collect()]
    expected = {(r, s, n) for r, s in {tuple(x) for x in starts.collect()} for _, n in ways.get((r, s), ())}
    assert len(found) == len(set(found)) and set(found) == expected == {tuple(r) for r in graph.closure(df, starts).collect()}


def test_best_dependents_on_cycles(spark):
    names = ["src/service/", "src/test/", "src/model/", "lib/"]
    links = sorted({("r", names[a % 4] + str(a), names[b % 4] + str(b)) for _, a, b in [(0, int(u[1:]), int(v[1:])) for r, u, v in links_of(9) if r == "a"]})
    df = spark.createDataFrame(links, "repository string, used string, user string")
    rows = graph.best_dependents(df, 4).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault((r.repository, r.start), []).append(r.path)
    weight = lambda p: 2.0 if "service" in p else 0.3 if "test" in p else 1.5 if "model" in p else 1.0
    for start, others in reach(links).items():
        best = sorted((n for _, n in others), key=lambda p: (-weight(p), p))[:4]
        assert found.get(start, []) == best


def source(k, base, fields=()):
    body = "".join(f"  private T{f} f{f};\n" for f in fields)
    return f"package p;\npublic class T{k} extends T{base} {{\n{body}  public void m{k}() {{ }}\n}}"


def versions(seed):
    """Files of four versions in a row: some added, changed, deleted, moved, and classes that two files declare."""
    rng = random.Random(seed)
    files = {f"T{k}.java": source(k, rng.randrange(25), rng.sample(range(25), rng.randrange(3))) for k in range(20)}
    yield dict(files)
    for step in range(2):
        for path in rng.sample(sorted(files), 3):
            del files[path]
        for path in rng.sample(sorted(files), 3):
            k = int(path.split("T")[-1].split(".")[0])
            files[path] = source(k, rng.randrange(25), rng.sample(range(25), rng.randrange(4)))
        for k in rng.sample(range(25), 3):
            files[f"{'zz/' if step else ''}T{k}.java"] = source(k, rng.randrange(25), [rng.randrange(25)])
        yield dict(files)
    yield {}


def test_upkeep_equals_a_rebuild(spark):
    states = [spark.createDataFrame([("r", p, c) for p, c in v.items()] + [("s", "A.java", "class A { B b; }")], FILES) for v in versions(6)]
    types = index.extract_types(states[0])
    built = index.build_index(states[0], types)
    support = maintain.link_support(built)
    links = lambda i: i["edges"].select("repository", F.col("dst").alias("used"), F.col("src").alias("user"))
    starts = lambda i: i["edges"].where("type = 'extends'").select("repository", F.col("dst").alias("start")).distinct()
    pairs = graph.reached(links(built), starts(built))
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for new_files in states[1:]:
        old = built
        built, types, changed = maintain.refresh_index(old, types, new_files)
        whole = index.build_index(new_files)
        for part in whole:
            assert rows(built[part]) == rows(whole[part]), part
        before = {tuple(r) for r in support.select("user", "used").collect()}
        support, delta = maintain.refresh_links(support, old, built)
        assert rows(support) == rows(maintain.link_support(whole))
        after = {tuple(r) for r in support.select("user", "used").collect()}
        assert {(r.user, r.used, r.sign) for r in delta.collect()} == {(*x, 1) for x in after - before} | {(*x, -1) for x in before - after}
        pairs = maintain.refresh_closure(pairs, starts(built), links(old), links(built))
        assert rows(pairs) == rows(graph.closure(links(whole), starts(whole)))


def test_closure_upkeep_on_cycles(spark):
    schema = "repository string, used string, user string"
    old, new = links_of(11, 30, 50), links_of(12, 30, 50)
    new = sorted(set(new[:30]) | set(old[10:]))
    starts = spark.createDataFrame([("a", f"n{k}") for k in range(30)] + [("b", "n0")], "repository string, start string")
    some = starts.where("start < 'n2'")
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    for before, after in ((starts, starts), (some, starts), (starts, some)):
        found = maintain.refresh_closure(graph.reached(a, before), after, a, b)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.closure(b, after).collect()))


def test_scan_finds_every_file(spark):
    root = scratch_path(spark, "tree")
    tree = {"a.java": "class A { }", ".hidden": "h", "_under/x.java": "", "d/" * 7 + "deep.java": "class D { }", "node_modules/z.js": "no", "sub/bad.java": "\udcff", "sub/.git/config": "no", "big/" + "n" * 100 + ".txt": "n"}
    tree |= {f"flat/f{k}.java": "class F { }" for k in range(300)}
    for path, text in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "wb") as file:
            file.write(text.encode(errors="surrogateescape"))
    os.makedirs(f"{root}/empty/folder")
    rows = {r.path: r for r in scan_code_files(spark, root, "r").collect()}
    expected = {p for p in tree if "node_modules" not in p and ".git" not in p}
    assert set(rows) == expected
    assert rows["sub/bad.java"].content == "�" and rows["_under/x.java"].content == ""
    assert scan_code_files(spark, root, "r", "*.hid*").count() == 1
    assert scan_code_files(spark, f"{root}/empty", "r").count() == 0


def test_hand_written_accessors_are_fragments(spark):
    text = "@Data\npublic class P {\n  private String name;\n  public String getLabel() { return name; }\n  public void setLabel(String s) { }\n}"
    files = spark.createDataFrame([("r", "P.java", text)], FILES)
    assert sorted(r.function_name for r in java.fragments(files).collect()) == ["getLabel", "setLabel"]
    methods = java.methods(java.java_types(files)).collect()
    assert {(m.name, m.generated) for m in methods} == {("getLabel", False), ("setLabel", False), ("getName", True), ("setName", True)}


def test_prompt_items_of_a_large_pull_request(spark):
    patch = lambda k: f"@@ -1,2 +1,1 @@\n-    public void gone{k}() {{\n }}"
    rows = [("r", 1, k, f"T{k}.java", "modified", 1, 1, patch(k)) for k in range(300)] + [("r", 1, 300, "pom.xml", "modified", 1, 1, "-<artifactId>old</artifactId>\n+<artifactId>new</artifactId>")]
    changes = spark.createDataFrame(rows, "repository string, pr_number long, file_no int, filename string, status string, additions long, deletions long, patch string")
    files = spark.createDataFrame([("r", f"T{k}.java", f"class T{k} {{ public void gone{k}() {{ }} }}") for k in range(300)], FILES)
    found = review.prompt_items(changes, index.build_index(files)).collect()
    counts = {s: len({r.text for r in found if r.section == s}) for s in ("method", "breaking", "added", "removed")}
    assert counts == {"method": 300, "breaking": 300, "added": 1, "removed": 1}
    assert {r.file_no for r in found if r.section == "breaking"} == set(range(300))
