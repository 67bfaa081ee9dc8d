"""JavaScript and TypeScript through the index, on hand-written sources."""

from code_impact.operators import diff, graph, index, modules, patch
from code_impact.operators.strategies import EVERY

SCHEMA = "repository string, path string, content string"

SERVICE = """// import { no } from './comment';
import fs from 'fs';
import { Cart as Basket, type Item } from "../model/cart";
import * as util from './util';
import './side-effect';
export { round } from "./maths";
const lazy = await import('./lazy');
const old = require("./old.js");
const text = "import { x } from './string'";
/* export class Ghost { } */
export default abstract class Service<T extends Item> extends Base<T> implements Runs, Stops<T> {
  private readonly store: Store;
  #hidden = 1;
  constructor(private store: Store, public name: string = "a {") { super(); }
  public async find(id: number, ...rest: string[]): Promise<Map<string, Item>> {
    if (id > 0) { return this.load(id); }
    for (const x of rest) { call(x); }
  }
  static of<K>(value?: K): Service<K> { return null; }
  private load(id: number) { }
  protected stop(): void { }
  #secret() { }
  get size(): number { return 1; }
}
export interface Runs { run(x: string): void; stop(): boolean; }
export async function start(service: Service<Item>, n = 2): Promise<void> { helper(); }
function helper() { }
export const twice = (n: number): number => n * 2;
"""
TREE = {
    "src/app/service.ts": SERVICE,
    "src/app/util/index.js": "module.exports = { a: 1 };",
    "src/app/maths.ts": "export function round(n) { return n; }",
    "src/app/old.js": "",
    "src/model/cart.tsx": "import { start } from '@org/core';\nexport class Cart { total() { return 1; } }\nexport interface Item { }",
    "packages/core/package.json": '{"name": "@org/core", "main": "lib/main.js"}',
    "packages/core/lib/main.ts": "export function begin() { }",
    "packages/tools/package.json": '{"name": "@org/tools"}',
    "packages/tools/src/index.ts": "import x from '@org/core/lib/main'; import y from '@org/tools/src/deep'; import z from 'lodash';",
    "packages/tools/src/deep.ts": "import { t } from '@org/tools'; import q from '@org/nothing';",
    "A.java": "class A extends B { }",
}


def files(spark, tree=TREE):
    return spark.createDataFrame([("r", p, c) for p, c in tree.items()], SCHEMA)


def test_declarations(spark):
    rows = {r["name"]: r for r in modules.module_types(files(spark, {"src/app/service.ts": SERVICE})).collect()}
    assert set(rows) == {"src/app/service", "Service", "Runs"}
    module, service = rows["src/app/service"], rows["Service"]
    assert module.imports == ["fs", "../model/cart", "./util", "./side-effect", "./maths", "./lazy", "./old.js"]
    assert [(e.dst, e.line, e.usage) for e in module.edges] == [
        ("src/model/cart", 3, ["Cart", "Item"]), ("src/app/util", 4, []), ("src/app/side-effect", 5, []), ("src/app/maths", 6, ["round"]),
        ("src/app/lazy", 7, []), ("src/app/old", 8, []),
    ]
    assert [(m.name, m.signature) for m in module.methods] == [("start", "Promise<void> start(Service<Item> service, any n)"), ("twice", "number twice(number n)")]
    assert (service.kind, service.line, service.dependencies) == ("class", 11, ["Base", "Runs", "Stops"])
    assert [(e.type, e.dst) for e in service.edges] == [("extends", "Base"), ("implements", "Runs"), ("implements", "Stops")]
    assert [m.name for m in service.methods] == ["constructor", "find", "of", "size"]
    find = service.methods[1]
    assert (find.return_type, find.line, find.end_line) == ("Promise<Map<string, Item>>", 15, 18)
    assert [(p.type, p.name) for p in find.parameters] == [("number", "id"), ("string[]", "rest")]
    assert [m.signature for m in rows["Runs"].methods] == ["void run(string x)", "boolean stop()"]


def test_index_with_java_and_workspaces(spark):
    built = index.build_index(files(spark), strategies=EVERY)
    assert {r.path for r in built["files"].collect()} == {p for p in TREE if not p.endswith(".json")}
    links = {(r.user, r.used) for r in graph.file_links(built).collect()}
    assert links == {
        ("src/app/service.ts", "src/model/cart.tsx"), ("src/app/service.ts", "src/app/util/index.js"), ("src/app/service.ts", "src/app/maths.ts"),
        ("src/app/service.ts", "src/app/old.js"), ("src/model/cart.tsx", "packages/core/lib/main.ts"),
        ("packages/tools/src/index.ts", "packages/core/lib/main.ts"), ("packages/tools/src/index.ts", "packages/tools/src/deep.ts"),
        ("packages/tools/src/deep.ts", "packages/tools/src/index.ts"),
        # ``Service implements Runs`` in one file.
        ("src/app/service.ts", "src/app/service.ts"),
    }
    changes = spark.createDataFrame([("r", 1, 1, "packages/core/lib/main.ts", "modified", 1, 1, "")], "repository string, pr_number long, file_no int, filename string, status string, additions long, deletions long, patch string")
    row = patch.analyze(changes, built).first()
    # The module itself, and the two modules that import it.
    assert (row.affected_files, row.affected_classes) == (3, 3)
    assert {r.path for r in patch.affected_files(changes, built).collect()} == {"packages/core/lib/main.ts", "src/model/cart.tsx", "packages/tools/src/index.ts"}


def test_versions_of_modules(spark):
    old = modules.module_types(files(spark))
    new = modules.module_types(files(spark, TREE | {"src/app/maths.ts": "export function ceil(n) { return n; }", "src/model/cart.tsx": "export class Cart { total(tax: number) { return 1; } }"}))
    found = {(r.type, r["class"], r.method) for r in diff.breaking_changes(old, new).collect()}
    assert found == {("method_removed", "src/app/maths", "round"), ("signature_changed", "Cart", "total"), ("class_removed", "Item", None)}


def test_odd_files(spark):
    odd = {"a.ts": "", "b.js": "}}} export class { }", "c.ts": "import './c'", "index.js": "export function root() { }", "d/index.d.ts": "export declare class D { run(): void; }", "e.js": "`${a} // ` + '\\'' ; export function e() { }"}
    rows = modules.module_types(files(spark, odd)).collect()
    assert {r["name"] for r in rows} == {"a", "b", "c", "", "d", "D", "e"}
    assert {m.name for r in rows for m in r.methods} == {"root", "run", "e"}
    assert modules.module_types(files(spark).limit(0)).count() == 0
