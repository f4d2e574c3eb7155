"""Declarations, their bodies and calls, against a compiler's own view of real files and by hand in other languages."""

import ast
import inspect
from collections import Counter

import pytest

from quillstone.operators import code as C


@pytest.mark.parametrize("module", ["argparse", "textwrap", "json.decoder", "dataclasses", "inspect", "tokenize", "typing", "quillstone.operators.fields", "quillstone.operators.code", "enum", "doctest"])
def test_python_files_agree_with_their_syntax_trees(module):
    text = inspect.getsource(__import__(module, fromlist=["x"]))
    want = Counter((n.name, n.lineno, n.end_lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
    found, calls = C.parse(text, "python")
    assert Counter((s.name, s.line, s.end) for s in found) == want
    tree = {(n.lineno, n.func.id) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    got = {(line, name) for line, name, _ in calls}
    missed = {x for x in tree - got if x[1] not in C.NO_CALLS and x[1].isascii()}
    # Calls inside the braces of formatted strings lie in a string.
    assert len(missed) <= 0.05 * len(tree)


FILES = {
    "rust": """use std::fmt;
/* fn not_this() { */
pub struct Point<T> {
    x: T, // }
}
struct Unit;
impl<T: Clone> fmt::Display for Point<T> {
    fn fmt<'a>(&'a self, f: &mut fmt::Formatter) -> fmt::Result {
        let s = "} fn no() {"; let c = '{'; let raw = r#"}" {"#;
        helper(s);
        write!(f, "{}", '\\'')
    }
}
trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { label() }
}
pub async fn helper(
    s: &str,
) { inner(s) }
""",
    "javascript": """// class No {
export class Box extends Base {
  open() { return `}${this.lid({a: 1})}`; }
}
function outer({a, b} = {}) {
  function inner() { return "}" + '}' ; }
  return inner(a);
}
""",
    "go": """package x
type Shape interface {
	Area() float64
}
type Sq struct { side float64 }
func (s Sq) Area() float64 {
	x := `} func no() {`
	return mul(s.side, '}')
}
func mul(a, b rune) float64 { return 0 }
""",
    "java": """public class A {
    String s = \"\"\"
        class No { \" }
        \"\"\";
    void run() { if (ok()) { go("}"); } }
    private class B { int x; }
}
""",
}
WANT = {
    "rust": {("struct", "Point", 3, 5, None), ("struct", "Unit", 6, 6, None), ("function", "fmt", 8, 12, "Point"), ("trait", "Shape", 14, 17, None), ("function", "area", 15, 15, "Shape"), ("function", "name", 16, 16, "Shape"), ("function", "helper", 18, 20, None)},
    "javascript": {("class", "Box", 2, 4, None), ("function", "outer", 5, 8, None), ("function", "inner", 6, 6, None)},
    "go": {("interface", "Shape", 2, 4, None), ("struct", "Sq", 5, 5, None), ("function", "Area", 6, 9, None), ("function", "mul", 10, 10, None)},
    "java": {("class", "A", 1, 7, None), ("class", "B", 6, 6, "A")},
}


def test_other_languages(spark):
    rows = [(lang, lang, text) for lang, text in FILES.items()] + [("none", "cobol", "class X {"), ("null", "rust", None), ("open", "rust", "fn a() {\n  b();\n"), ("crlf", "python", "class P:\r\n    def q(self):\r\n        r()\r\n\r\ndef r(): pass\r\n")]
    df = spark.createDataFrame(rows, "k string, l string, c string")
    found = C.symbols(df, "k", "c", "l").collect()
    for lang, want in WANT.items():
        assert {(x.kind, x.name, x.line, x.end_line, x.parent) for x in found if x.k == lang} == want, lang
    assert {(x.name, x.line, x.end_line) for x in found if x.k in ("none", "null", "open")} == {("a", 1, 2)}
    assert {(x.qualified, x.line, x.end_line) for x in found if x.k == "crlf"} == {("P", 1, 3), ("P.q", 2, 3), ("r", 5, 5)}
    edges = {(x.k, x.from_symbol, x.to_symbol) for x in C.call_edges(df, "k", "c", "l").collect()}
    assert edges == {("rust", "fmt", "helper"), ("javascript", "outer", "inner"), ("go", "Area", "mul"), ("crlf", "q", "r")}
