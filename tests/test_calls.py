"""Call sites in hand-written Java, traps included."""

import time

import pytest

from code_impact.operators import calls, diff, java

SCHEMA = "repository string, path string, content string"

CART = """package shop;
public class Cart extends Basket implements Priced {
    private final Store<Item> store;
    private Map<String, List<Item>> items = Items.load(new Loader("x.run()"));
    protected Runnable later = () -> { store.flush(); };
    public Cart(Store<Item> store) { this.store = store; store.open(); }
    @Audited("store.open()")
    public Item add(final Item item, int... counts) {
        // store.close();
        String s = "store.close()"; /* item.price(); */
        if (item.valid() && check(item)) { Item copy = item.copy(); copy.price(); }
        for (Item other : items.values()) { other.price(); }
        try (Lock lock = store.lock()) { lock.release(); } catch (StoreError | BadItem e) { e.report(); }
        Object o = item; if (o instanceof Gift g) { g.wrap(); }
        var made = new Gift(item); made.wrap();
        store.find(item).price();
        shop.util.Maths.round(1); Maths.round(2);
        return super.add(
            item.price());
    }
    boolean check(Item i) { return total() > 0 && this.store.has(i); }
    void shadow(Gift store) { store.wrap(); }
    void rounds() { new Thread(new Runnable() { public void run() { store.flush(); } }).start(); tax(); log.note(); }
    static class Line { Item item; void show() { item.price(); helper.show(); } }
}"""
OTHERS = """package shop;
class Basket extends Holder { Item add(Item i, Item j) { return j; } protected Log log; int total() { return 0; } }
class Holder extends Basket { void note() {} }
interface Priced extends Taxed { }
interface Taxed { default int tax() { return 1; } }
class Store<T> { void open() {} void close() {} void flush() {} boolean has(T t) { return true; } T find(T t) { return t; } Lock lock() { return null; } }
class Item { boolean valid() { return true; } Item copy() { return this; } int price() { return 1; } }
class Gift extends Item { Gift(Item i) { } void wrap() {} }
class Lock { void release() {} }
class StoreError { void report() {} }
class Maths { static int round(int i) { return i; } }
class Items { static Map load(Loader l) { return null; } }
class Loader { }
class Log extends Holder { }
"""


def found(spark, files):
    df = spark.createDataFrame([("r", p, c) for p, c in files.items()], SCHEMA)
    return calls.call_sites(df)


def test_receivers_and_superclasses(spark):
    rows = found(spark, {"Cart.java": CART, "Others.java": OTHERS}).where("file = 'Cart.java'").collect()
    seen = sorted((r["class"], r.method or "", r.line, r.name, r.declared_in) for r in rows)
    assert seen == sorted(
        [
            ("Cart", "", 4, "load", "Items"),
            ("Cart", "", 4, "Loader", "Loader"),
            ("Cart", "", 5, "flush", "Store"),
            ("Cart", "Cart", 6, "open", "Store"),
            ("Cart", "add", 11, "valid", "Item"),
            ("Cart", "add", 11, "check", "Cart"),
            ("Cart", "add", 11, "copy", "Item"),
            ("Cart", "add", 11, "price", "Item"),
            ("Cart", "add", 12, "price", "Item"),
            ("Cart", "add", 13, "lock", "Store"),
            ("Cart", "add", 13, "release", "Lock"),
            ("Cart", "add", 13, "report", "StoreError"),
            ("Cart", "add", 14, "wrap", "Gift"),
            ("Cart", "add", 15, "Gift", "Gift"),
            ("Cart", "add", 15, "wrap", "Gift"),
            ("Cart", "add", 16, "find", "Store"),
            ("Cart", "add", 17, "round", "Maths"),
            ("Cart", "add", 17, "round", "Maths"),
            ("Cart", "add", 18, "add", "Basket"),
            ("Cart", "add", 19, "price", "Item"),
            ("Cart", "check", 21, "total", "Basket"),
            ("Cart", "check", 21, "has", "Store"),
            ("Cart", "shadow", 22, "wrap", "Gift"),
            ("Cart", "rounds", 23, "flush", "Store"),
            ("Cart", "rounds", 23, "tax", "Taxed"),
            # ``log`` is a field of the superclass, ``note`` a method of a superclass of its type, in a cycle of superclasses.
            ("Cart", "rounds", 23, "note", "Holder"),
            ("Line", "show", 24, "price", "Item"),
        ]
    )


def test_call_edges_and_breaking_changes(spark):
    old = spark.createDataFrame([("r", "Cart.java", CART), ("r", "Others.java", OTHERS), ("s", "Cart.java", CART)], SCHEMA)
    sites = calls.call_sites(old)
    # A repository that declares none of the types has only calls inside its own classes.
    assert {(r["class"], r.name) for r in sites.where("repository = 's'").collect()} == {("Cart", "check")}
    edges = {(r.src, r.dst): r for r in calls.call_edges(sites.where("repository = 'r'")).collect()}
    store = edges["Cart", "Store"]
    assert (store.type, store.line, store.usage, store.calls) == ("method_call", 5, ["find", "flush", "has", "lock", "open"], 6)
    changed = OTHERS.replace("int price()", "double price(int x)").replace("public", "").replace("class Lock {", "class Latch {")
    opened = lambda text: text.replace("; }", "; }").replace("class Item {", "class Item { public int price() { return 1; }")
    before = java.java_types(spark.createDataFrame([("r", "Others.java", opened(OTHERS))], SCHEMA))
    after = java.java_types(spark.createDataFrame([("r", "Others.java", changed)], SCHEMA))
    breaking = diff.breaking_changes(before, after)
    hit = {(r.type, r["class"], r.method): (r.call_sites, r.calling_classes, r.calling_files) for r in calls.breaking_call_sites(breaking, sites).collect()}
    assert hit["class_removed", "Lock", None] == (1, 1, 1)
    assert hit["method_removed", "Item", "price"] == (4, 2, 1)


def test_files_without_calls(spark):
    files = {"A.java": "class A { }", "B.java": "", "C.java": "class C { void m() {", "D.java": "}}}} class D { void m() { m(); } }", "e.py": "x()", "P.java": "package a.b;"}
    df = spark.createDataFrame([("r", p, c) for p, c in files.items()] + [("r", "N.java", None)], SCHEMA)
    assert [(r["class"], r.method, r.name) for r in calls.call_sites(df).collect()] == [("D", "m", "m")]
    assert calls.call_sites(df.limit(0)).count() == 0


@pytest.mark.parametrize("methods", [4000])
def test_large_files_take_linear_time(spark, methods):
    body = "\n".join(f"    public int m{k}(int a) {{ if (a > {k}) {{ return m{max(k - 1, 0)}(a); }} return {k}; }}" for k in range(methods))
    df = spark.createDataFrame([("r", "Big.java", f"public class Big {{\n{body}\n}}")], SCHEMA)
    java.java_types(df.limit(0)).collect()
    start = time.time()
    row = java.java_types(df).collect()[0]
    took = time.time() - start
    assert len(row.methods) == methods and row.methods[17].end_line == 19
    assert took < 10, took
    assert calls.call_sites(df).count() == methods


def test_questions_are_followed_once_for_each_type(spark, monkeypatch):
    rows = []
    cut = calls.cut_lineage

    def counted(df):
        done = cut(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(calls, "cut_lineage", counted)
    n = 8
    asked = spark.createDataFrame([("r", f"T{k}", m) for k in range(n) for m in ("m", "none")], "repository string, name string, member string")
    members = spark.createDataFrame([("r", "T0", "m", True)], "repository string, name string, member string, value boolean")
    parents = spark.createDataFrame([("r", f"T{k}", f"T{k - 1}", -1) for k in range(1, n)], "repository string, name string, parent string, place int")
    found = calls.nearest(asked, members, parents)
    assert sorted((r.name, r.member, r.owner, r.value) for r in found.collect()) == [(f"T{k}", "m", "T0", True) for k in range(n)]
    # A question of its own for each pair of a type and one above it would be n * n / 2 rows for each member.
    assert sum(rows) <= 4 * n, rows


def test_nearest_of_several_parents_and_cycles(spark):
    up = {"A": ["C", "B"], "B": ["D"], "C": ["E", "F"], "D": ["A", "G"], "E": ["A"], "F": ["F"], "H": ["I"], "I": ["H"], None: ["G"]}
    has = {"G": ["x", "y"], "E": ["y"], "F": ["y", "z"], "A": ["w"], "I": [None]}
    types, names = ["A", "B", "C", "D", "E", "F", "G", "H", "I", None], ["w", "x", "y", "z", "none", None]
    asked = spark.createDataFrame([("r", t, m) for t in types for m in names] * 2, "repository string, name string, member string")
    members = spark.createDataFrame([("r", t, m, f"{t}{m}") for t, ms in has.items() for m in ms], "repository string, name string, member string, value string")
    parents = spark.createDataFrame([("r", t, p, k) for t, ps in up.items() for k, p in enumerate(ps)], "repository string, name string, parent string, place int")
    expect = []
    for t in types:
        for m in names:
            level, seen = {(0, t)}, {t}
            while level and m and t:
                if owners := [(place, at) for place, at in level if m in has.get(at, [])]:
                    expect.append((t, m, min(owners)[1], f"{min(owners)[1]}{m}"))
                    break
                level = {(min(k for _, o in level for k, p in enumerate(up.get(o, [])) if p == at), at) for at in {p for _, o in level for p in up.get(o, [])} - seen}
                seen |= {at for _, at in level}
    assert sorted(map(tuple, calls.nearest(asked, members, parents).select("name", "member", "owner", "value").collect())) == sorted(expect)


def test_bodies_are_read_once_and_survive_odd_text(spark):
    text = "class A { B b; void m() { b.go(); /* café */ new B().go(); b . go ( \n b.go()); } }\r\nclass B { void go() { } } // end"
    df = spark.createDataFrame([("r", "A.java", text.encode() + b"\xff"), ("r", "N.java", None)], "repository string, path string, content binary")
    files = df.select("repository", "path", calls.F.col("content").cast("string").alias("content"))
    assert sorted((r["class"], r.method, r.line, r.name, r.declared_in) for r in calls.call_sites(files).collect()) == sorted(
        [("A", "m", 1, "go", "B"), ("A", "m", 1, "B", "B"), ("A", "m", 1, "go", "B"), ("A", "m", 2, "go", "B")]
    )
    plan = calls._bodies(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_only_sites_of_changed_classes_are_counted(spark):
    sites = spark.createDataFrame(
        [("r", f, c, "m", k, n, d) for k, (f, c, n, d) in enumerate([("a", "A", "x", "B"), ("a", "A", "x", "B"), ("b", "A", "y", "B"), (None, "C", "x", "B"), ("b", "B", "x", "B"), ("a", "A", "z", "D")])],
        "repository string, file string, class string, method string, line int, name string, declared_in string",
    )
    breaking = spark.createDataFrame(
        [("r", "method_removed", "B", "x"), ("r", "class_removed", "B", None), ("r", "method_removed", "B", "q"), ("s", "class_removed", "D", None), ("r", "class_removed", None, None)],
        "repository string, type string, class string, method string",
    )
    hit = calls.breaking_call_sites(breaking, sites)
    seen = {(r.repository, r["class"], r.method): (r.call_sites, r.calling_classes, r.calling_files) for r in hit.collect()}
    assert seen == {("r", "B", "x"): (3, 2, 1), ("r", "B", None): (4, 2, 2), ("r", "B", "q"): (0, 0, 0), ("s", "D", None): (0, 0, 0), ("r", None, None): (0, 0, 0)}
    assert "LeftSemi" in hit._jdf.queryExecution().optimizedPlan().toString()
