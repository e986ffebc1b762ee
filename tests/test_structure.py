"""Structure of source files: fixtures per language, and Python files against the parser of the language."""

import ast

import pytest

from tessera.operators import structure as S

TS = """import { A } from './a';
export class Shop<T> extends Base<T> implements Open, Shut {
  // class Fake {}
  private items: Map<string, T> = new Map();
  constructor(private a: A) { super(); }
  @Get('x') async list(q: string): Promise<T[]> {
    const s = `class Not { ${q} }`;
    if (q) { this.find(q); }
    return this.a.rows(q);
  }
  abstract size(): number;
}
export interface Open { open(): void }
type Kind = 'a' | 'b';
export const run = async (x: { y: number }): Promise<void> => { go(x); };
const plain = 3, re = /[/"]class X{/;
function* gen() { helper(); }
export { gen };
"""
GO = """package a

type Store struct {
	N int
}

type Reader interface {
	Read() int
}

func (s *Store) Get(k string) (int, error) {
	for i := range s.rows {
		use(i)
	}
	return s.load(k), nil
}

func Open[T any](x T) *Store { return build(x) }
"""
JAVA = """package a;
public class Shop extends Base implements Open, Shut {
  private final int n = count(1);
  public Shop(int n) { this.n = n; }
  @Override public List<Row> rows(int a) throws Bad { return find(a).stream().map(r -> r.x()).toList(); }
  abstract int size();
  static class Inner { void f() {} }
}
interface Open { void open(); }
"""
PY = '''class Shop(base.Store, Open):
    """class Fake: pass"""
    @cached(limit=3)
    def rows(self, a=(1,
        2)):
        x = [f(v) for v in a]
        return self.find(a) + other.call(x)

    async def _late(self):
        def inner():
            deep()
        return inner()

def top(): return Shop()
'''


def names(found):
    return [(s[0], s[2], s[4], s[5]) for s in found.symbols]


def test_typescript():
    found = S.scan("a.ts", TS)
    assert names(found) == [("class", "Shop", 2, 12), ("constructor", "Shop.constructor", 5, 5), ("method", "Shop.list", 6, 10), ("method", "Shop.size", 11, 11), ("interface", "Open", 13, 13), ("method", "Open.open", 13, 13), ("type", "Kind", 14, 14), ("const", "run", 15, 15), ("function", "gen", 17, 17)]
    assert {s[2]: s[3] for s in found.symbols if s[0] in ("class", "type", "const", "function")} == {"Shop": True, "Kind": False, "run": True, "gen": True}
    assert set(found.bases) == {("Shop", "Base", "extends"), ("Shop", "Open", "implements"), ("Shop", "Shut", "implements")}
    assert {(c[0], c[2]) for c in found.calls} >= {("Shop.list", "Shop.find"), ("Shop.list", "a.rows"), ("run", "go"), ("gen", "helper")}


def test_go():
    found = S.scan("a.go", GO)
    assert names(found) == [("class", "Store", 3, 5), ("interface", "Reader", 7, 9), ("method", "Store.Get", 11, 16), ("function", "Open", 18, 18)]
    assert {(c[0], c[1]) for c in found.calls} == {("Store.Get", "use"), ("Store.Get", "load"), ("Open", "build")}


def test_java():
    found = S.scan("a.java", JAVA)
    assert [n[:2] for n in names(found)] == [("class", "Shop"), ("constructor", "Shop.Shop"), ("method", "Shop.rows"), ("method", "Shop.size"), ("class", "Inner"), ("method", "Inner.f"), ("interface", "Open"), ("method", "Open.open")]
    assert set(found.bases) == {("Shop", "Base", "extends"), ("Shop", "Open", "implements"), ("Shop", "Shut", "implements")}


def test_python():
    found = S.scan("a.py", PY)
    assert names(found) == [("class", "Shop", 1, 12), ("method", "Shop.rows", 4, 7), ("method", "Shop._late", 9, 12), ("function", "top", 14, 14)]
    assert {(c[0], c[2]) for c in found.calls} == {("Shop.rows", "f"), ("Shop.rows", "Shop.find"), ("Shop.rows", "other.call"), ("inner", "deep"), ("Shop._late", "inner"), ("top", "Shop")}
    assert found.bases == [("Shop", "Store", "extends"), ("Shop", "Open", "extends")]


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("a.kt", "class Shop(val n: Int) : Base(n), Open {\n  fun rows(a: Int): Int = 1\n  private fun find() { go() }\n}\nfun top() { run() }\n", {("class", "Shop"), ("method", "Shop.rows"), ("method", "Shop.find"), ("function", "top")}),
        ("a.rs", "pub struct Shop { n: i32 }\nimpl Open for Shop {\n    fn rows(&self) -> i32 { self.find() }\n}\npub fn top() { run() }\n", {("class", "Shop"), ("method", "Shop.rows"), ("function", "top")}),
        ("a.php", "<?php\nclass Shop extends Base {\n  public function rows($a) { return $this->find($a); }\n}\nfunction top() {}\n", {("class", "Shop"), ("method", "Shop.rows"), ("function", "top")}),
        ("a.vue", "<template><b/></template>\n<script>\nexport function top() { go(); }\n</script>\n", {("function", "top")}),
    ],
)
def test_other_languages(path, text, want):
    assert {(s[0], s[2]) for s in S.scan(path, text).symbols} == want


def test_damage_and_emptiness():
    for path in ("a.ts", "a.go", "a.java", "a.py", "a.kt", "a.txt", "noext", ""):
        for text in ("", "}}}} ) class", "class A { f( { ", "\0", '"""', "`${", "def f(:\n (", "func (", "class", "function", "type X =", "export const a ="):
            S.scan(path, text)


def test_python_files_against_the_parser(spark, root):
    from tessera.sources.files import file_texts

    files = file_texts(spark, root).where("file_path LIKE '%.py'").toPandas()
    checked = 0
    for path, text in zip(files["file_path"], files["text"], strict=True):
        text = text.replace("\r\n", "\n").removeprefix("﻿")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            continue
        want, called = set(), set()
        functions = (ast.FunctionDef, ast.AsyncFunctionDef)

        def walk(node, function, owner, called=called):
            for child in ast.iter_child_nodes(node):
                inner, cls = function, owner
                if child in getattr(node, "decorator_list", ()):
                    continue
                if isinstance(child, functions):
                    inner = f"{owner}.{child.name}" if isinstance(node, ast.ClassDef) else child.name
                if isinstance(child, ast.ClassDef):
                    cls = child.name
                if isinstance(child, ast.Call) and function:
                    called.add((function, child.func.id if isinstance(child.func, ast.Name) else getattr(child.func, "attr", "")))
                walk(child, inner, cls)

        walk(tree, None, None)
        for node in tree.body:
            if isinstance(node, ast.ClassDef):
                want.add(("class", node.name, node.lineno, node.end_lineno))
                want |= {("method", f"{node.name}.{m.name}", m.lineno, m.end_lineno) for m in node.body if isinstance(m, functions)}
            elif isinstance(node, functions):
                want.add(("function", node.name, node.lineno, node.end_lineno))
        found = S.scan(path, text)
        assert set(names(found)) == want, path
        assert {(c[0], c[1]) for c in found.calls} == called, path
        checked += 1
    assert checked > 5


def test_rows_of_dirty_files(spark):
    rows = spark.createDataFrame([("1", "a.py", "def f():\n  g()\n", 1), ("2", None, "x", 1), ("3", "b.ts", None, 1), ("4", "c.md", "class A {}", 1)], "file_id string, file_path string, text string, kind int")
    got = {r["file_id"]: (len(r["symbols"]), len(r["calls"])) for r in S.structure(rows).collect()}
    assert got == {"1": (1, 1), "3": (0, 0)}
    assert S.definitions(S.structure(rows.limit(0))).count() == 0
