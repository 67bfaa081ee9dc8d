"""Extraction from hand-written sources, traps included."""

import pytest

from code_impact.operators import diff, graph, index, java

SCHEMA = "repository string, path string, content string"

SHOP = {
    "OrderService.java": """package com.shop;

import java.util.List;

public class OrderService {
    private final OrderStore store;
    private final Notifier notifier;

    public OrderService(OrderStore store, Notifier notifier) {
        this.store = store;
        this.notifier = notifier;
    }

    public Order place(String item, Double price) {
        Order order = new Order(item, price);
        if (price > 0) { notifier.send(new OrderPlaced(order)); }
        return order;
    }

    public List<Order> all() { return store.all(); }
}""",
    "OrderStore.java": "package com.shop;\npublic interface OrderStore {\n    void put(Order o);\n    List<Order> all();\n}",
    "Notifier.java": "package com.shop;\npublic interface Notifier { void send(Object event); }",
    "Order.java": "package com.shop;\npublic class Order {\n    private String item;\n    private Double price;\n"
    "    public Order(String item, Double price) { }\n    public String getItem() { return item; }\n}",
    "OrderPlaced.java": "package com.shop;\npublic class OrderPlaced {\n    private final Order order;\n"
    "    public OrderPlaced(Order order) { this.order = order; }\n    public Order getOrder() { return order; }\n}",
}

TRAPS = """package com.example; // class Comment {
import java.util.List;
import static a.b.C.*;
/* class Block { } */
@Data
@Table(name = "x{", uniq = {@U("a;")})
public class Outer<T extends Foo>
    extends Base<T>
    implements Runnable,
       Comparable<Other> {
    private final Map<String, List<Foo>> m = new HashMap<>();
    protected Foo foo = new Foo(1), bar;
    int[] a = {1, 2};
    Outer() { Foo local; if (x) { y(); } }
    @GetMapping("/a/{id}")
    Foo get(@Path("id") final Map<String, List<Foo>> id, int b[], String... rest) throws IOException, X {
        return null; }
    public <R> R
       gen(R r) { String s = "} public void fake() {"; char c = '{'; return r; }
    public abstract void abs();
    void hidden() {}
    static { Foo z; }
    interface Inner { void x(int a); default int y() { return 1; } Foo CONST = null; }
    static class Nested { private Dep dep; public Nested(Dep d) {} private Nested() {} }
    enum E { A, B; private EnumDep ed; }
    Runnable r = new Runnable() { Anon an; public void run() {} };
}
"""


def frame(spark, sources, repository="r"):
    return spark.createDataFrame([(repository, path, text) for path, text in sources.items()], SCHEMA)


@pytest.fixture(scope="module")
def outer(spark):
    rows = java.java_types(frame(spark, {"Outer.java": TRAPS, "Empty.java": "", "Only.java": "// class X { }"})).collect()
    return {row["name"]: row for row in rows}


def test_classes_and_headers(outer):
    assert set(outer) == {"Outer", "Inner", "Nested"}
    assert outer["Outer"]["package"] == "com.example"
    assert outer["Outer"]["imports"] == ["java.util.List", "a.b.C.*"]
    assert outer["Outer"]["annotations"] == ["@Data", "@Table"]
    assert outer["Outer"]["dependencies"] == ["Base", "Runnable", "Comparable", "Other"]
    assert outer["Inner"]["kind"] == "interface"


def test_methods(outer):
    declared = [(m["line"], m["signature"]) for m in outer["Outer"]["methods"]][:4]
    assert declared == [
        (14, "Outer()"),
        (15, "Foo get(Map<String, List<Foo>> id, int b)"),
        (18, "R gen(R r)"),
        (20, "void abs()"),
    ]
    assert [m["signature"] for m in outer["Inner"]["methods"]] == ["void x(int a)", "int y()"]
    assert [m["signature"] for m in outer["Nested"]["methods"]] == ["Nested(Dep d)"]
    generated = [m["signature"] for m in outer["Outer"]["methods"]][4:6]
    assert generated == ["Map<String, List<Foo>> getM()", "void setM(Map<String, List<Foo>> m)"]


def test_edges(outer):
    found = [(e["type"], e["dst"], e["line"]) for e in outer["Outer"]["edges"]]
    assert found == [
        ("field_injection", "Foo", 12),
        ("field_injection", "Dep", 24),
        ("field_injection", "EnumDep", 25),
        ("field_injection", "Runnable", 26),
        ("field_injection", "Anon", 26),
        ("extends", "Base", 7),
        ("implements", "Runnable", 9),
        ("implements", "Comparable", 10),
        ("implements", "Other", 10),
    ]


def test_project_index_and_impact(spark):
    files = frame(spark, SHOP)
    built = index.build_index(files)
    stats = index.index_stats(built).first()
    assert (stats["total_files"], stats["total_classes"], stats["total_dependencies"], stats["languages"]) == (5, 5, 3, "java")
    methods = {(r["class"], r["signature"]) for r in built["methods"].collect()}
    assert ("OrderService", "Order place(String item, Double price)") in methods
    assert ("OrderService", "OrderService(OrderStore store, Notifier notifier)") in methods
    impact = {r["name"]: r for r in graph.analyze_impact(built["edges"], built["classes"], built["classes"]).collect()}
    assert tuple(impact["OrderService"])[2:] == (0, 0, 0)
    assert tuple(impact["OrderStore"])[2:] == (1, 1, 1)
    assert tuple(impact["Order"])[2:] == (1, 1, 1)


def test_impact_on_a_cycle(spark):
    sources = {"A.java": "class A extends B { }", "B.java": "class B extends A { }"}
    built = index.build_index(frame(spark, sources))
    impact = {r["name"]: r for r in graph.analyze_impact(built["edges"], built["classes"], built["classes"]).collect()}
    assert tuple(impact["A"])[2:] == (1, 2, 2)
    reached = graph.transitive_dependents(built["edges"], built["classes"]).collect()
    assert {(r["start"], r["affected"]) for r in reached} == {(a, b) for a in "AB" for b in "AB"}


def test_last_file_wins(spark):
    sources = {"a/X.java": "class X extends Old { }", "b/X.java": "class X extends New { }"}
    built = index.build_index(frame(spark, sources))
    assert [(r["path"], r["dependencies"]) for r in built["classes"].collect()] == [("b/X.java", ["New"])]
    by_package = index.merge_classes(index.extract_types(frame(spark, sources)), key=("package", "name"))
    assert by_package.count() == 1


def test_unreadable_file_is_reported_and_skipped(spark):
    files = spark.createDataFrame([("r", "A.java", None), ("r", "B.java", "class B { }")], SCHEMA)
    assert [r["path"] for r in index.extract_errors(files).collect()] == ["A.java"]
    assert [r["name"] for r in index.extract_types(files).collect()] == ["B"]


def test_version_diff(spark):
    old = {"U.java": "class U {\n public User find(Long id) { }\n public void drop(Long id) { }\n public List<User> all() { }\n}"}
    new = {
        "U.java": "class U {\n public Optional<User> find(Long id) { }\n // public void drop(Long id) { ... }\n public List<User> all() { }\n public User create(Dto d) { }\n}"
    }
    a, b = java.java_types(frame(spark, old)), java.java_types(frame(spark, new))
    found = {(r["type"], r["method"], r["severity"]) for r in diff.breaking_changes(a, b).collect()}
    assert found == {("signature_changed", "find", "major"), ("method_removed", "drop", "major")}
    assert {r["method"] for r in diff.new_methods(a, b).collect()} == {"find", "create"}


def test_large_file(spark):
    body = "".join(f"    public void m{i}(int a) {{ if (a > 0) {{ b(); }} }}\n" for i in range(3000))
    types = java.java_types(frame(spark, {"Big.java": f"class Big {{\n{body}}}\n"}))
    row = types.first()
    assert len(row["methods"]) == 3000
    assert (row["methods"][2999]["name"], row["methods"][2999]["line"]) == ("m2999", 3001)
