"""Definitions, calls and imports of ten languages."""

import pytest

from graphloom.sources import frontends as f
from graphloom.sources import tree

SOURCES = {
    "typescript": '''import Def, { a as b, type C } from "./m";
// not code: function ghost() {}
/** Adds. */
export async function add(x: number, y = f(1)): Promise<number> { function inner() {} return this.help(x).go(); }
let s = "class Ghost {"
@Dec({a: 1})
export class Foo<T> extends Bar implements Baz {
  /** Doc. */
  @Log() public async run(a: string): Promise<void> { b(); Def.make(`x ${y()}`); }
  get size() { return 1 }
}
const z = () => { add(1) }
function last() { return z }
''',
    "java": '''package a.b;
import com.x.Foo; import static com.x.Util.help; import com.y.*;
/** A thing. */
@Entity(name = "a")
public class Thing extends Base<T> implements A, B {
  private int n = 3; static { go(); }
  public Thing(int n) { this.n = n; }
  /* doc */
  @Override public List<String> run(Map<String, Integer> m, int k) throws X { if (k > 0) { help(m); } Foo.of(k).map(x -> y(x)); return new Foo(); }
  abstract void later();
  enum Kind { A, B }
}
''',
    "go": '''package m
import (
  "fmt"
  al "x/y"
)
// Point is.
type Point struct { X int }
type Shape interface { Area() float64 }
var k = 3
// Move moves.
func (p *Point) Move(dx, dy int) (err error) { fmt.Println(p); al.Do(); return }
func main() { Move(1) }
func gen[T any](x T) interface{} { return x }
''',
    "rust": '''use std::{fmt, io::{self, Read as R}}; use a::b as c;
/// A point.
#[derive(Debug)]
pub struct P { x: i32 }
pub struct U(i32);
trait T { fn sig(&self); fn with(&self) { self.sig(); } }
impl<'a> T for P { fn sig(&self) { let c = 'x'; P::new(1).go(); } }
/// Makes.
pub async fn make(a: &str) -> Result<P, E> { go::<i32>(a) }
''',
    "csharp": '''using System.Linq; using J = Newtonsoft.Json;
namespace A.B {
/// Does.
[Serializable]
public class K : Base, IFace { public K(int a) : base(a) { }
 public int Size => Count();
 public async Task<int> Run(string s) { var x = @"a""b{"; return await Do(s); } int Quick(int a) => a + Other(a); interface I { void M(); } }
}
''',
    "php": '''<?php
namespace A; use B\\C as D; use E\\{F, G as H};
/** Top. */
function top($a, $b = 1) { return D::make($a); }
class Q extends R implements S { /** m */ public static function run(int $x): string { $this->go($x); return "{"; } abstract function z(); }
''',
    "ruby": '''# Top.
class A < B
  # Runs.
  def run(a, b = 1)
    if a then go(b) end
    [1].each do |x|
      show(x)
    end
    x.help(1)
  end
  def self.make; build(1); end
  def short(x) = twice(x)
end
def top
  A.make(2)
end
''',
    "c": '''#include <a.h>
#define X(a) \\
  { a
struct S { int a; };
/* adds */
static int add(int a, int b) { return mul(a, b); }
int later(int a);
int arr[] = {1, 2};
''',
    "cpp": '''namespace n {
class W : public V, private Z { public: W(int a) : x(a) {} int get() const { return x; } private: int x; };
int W::set(int v) { x = v; return helper(v); }
template <typename T> T id(T t) { return t; }
}
''',
}
NODES = {
    "typescript": ["function add", "class Foo", "method Foo.run", "method Foo.size", "function last"],
    "java": ["class Thing", "method Thing.Thing", "method Thing.run", "method Thing.later", "class Kind"],
    "go": ["class Point", "class Shape", "method Point.Move", "function main", "function gen"],
    "rust": ["class P", "class U", "class T", "method T.with", "method P.sig", "function make"],
    "csharp": ["class K", "method K.K", "method K.Run", "method K.Quick", "class I", "method I.M"],
    "php": ["function top", "class Q", "method Q.run", "method Q.z"],
    "ruby": ["class A", "method A.run", "method A.make", "method A.short", "function top"],
    "c": ["class S", "function add"],
    "cpp": ["class W", "method W.W", "method W.get", "method W.set", "function id"],
}
CALLS = {
    "typescript": {("add", "this", "help"), ("add", "help", "go"), ("Foo.run", None, "b"), ("Foo.run", "Def", "make")},
    "java": {("Thing.run", None, "help"), ("Thing.run", "Foo", "of"), ("Thing.run", "of", "map"), ("Thing.run", None, "y")},
    "go": {("Point.Move", "fmt", "Println"), ("Point.Move", "al", "Do"), ("main", None, "Move")},
    "rust": {("T.with", "self", "sig"), ("P.sig", "P", "new"), ("P.sig", "new", "go"), ("make", None, "go")},
    "csharp": {("K.Run", None, "Do"), ("K.Quick", None, "Other")},
    "php": {("top", "D", "make"), ("Q.run", "this", "go")},
    "ruby": {("A.run", None, "go"), ("A.run", None, "show"), ("A.run", "x", "help"), ("A.make", None, "build"), ("A.short", None, "twice"), ("top", "A", "make")},
    "c": {("add", None, "mul")},
    "cpp": {("W.set", None, "helper")},
}
ALIASES = {
    "typescript": {"Def": "Def", "b": "a", "C": "C"}, "java": {"Foo": "Foo", "help": "help"}, "go": {"fmt": "fmt", "al": "y"}, "rust": {"fmt": "fmt", "R": "Read", "c": "b"},
    "csharp": {"Linq": "Linq", "J": "Json"}, "php": {"D": "C", "F": "F", "H": "G"}, "ruby": {}, "c": {}, "cpp": {},
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_definitions_calls_and_imports(language):
    for end in ("\n", "\r\n"):
        text = SOURCES[language].replace("\n", end)
        found = [x for x, _ in f.definitions("p.x", text, language)]
        assert [f"{x['type']} {x['node_id'].split('::', 1)[1]}" for x in found] == NODES[language]
        assert all(1 <= x["start_line"] <= x["end_line"] <= len(text.split("\n")) and len(x["body_hash"]) == 32 for x in found)
        assert {(c[1].split("::", 1)[1], c[2], c[3]) for c in f.calls("p.x", text, language)} == CALLS[language]
        assert f.aliases("p.x", text, language) == ALIASES[language]


def test_what_a_definition_holds():
    def one(language, name):
        return next(x for x, _ in f.definitions("p.x", SOURCES[language], language) if x["name"] == name)

    add = one("typescript", "add")
    assert (add["parameters"], add["return_type"], add["docstring"], add["start_line"]) == (["x: number", "y = f(1)"], "Promise<number>", "Adds.", 4)
    assert one("typescript", "Foo")["decorators"] == ["@Dec({a: 1})"] and one("typescript", "Foo")["bases"] == ["Bar", "Baz"]
    run = one("java", "run")
    assert (run["parameters"], run["return_type"], run["docstring"], run["decorators"]) == (["Map<String, Integer> m", "int k"], "List<String>", "doc", ["@Override"])
    assert one("java", "Thing")["bases"] == ["Base", "A", "B"] and one("csharp", "K")["bases"] == ["Base", "IFace"] and one("cpp", "W")["bases"] == ["V", "Z"] and one("ruby", "A")["bases"] == ["B"]
    assert (one("go", "Move")["docstring"], one("rust", "P")["decorators"], one("rust", "make")["return_type"]) == ("Move moves.", ["#[derive(Debug)]"], "Result<P, E>")
    assert (one("csharp", "K")["docstring"], one("php", "top")["docstring"], one("ruby", "run")["docstring"], one("c", "add")["docstring"]) == ("Does.", "Top.", "Runs.", "adds")
    assert one("ruby", "run")["parameters"] == ["a", "b = 1"] and (one("ruby", "run")["start_line"], one("ruby", "run")["end_line"]) == (4, 10)


@pytest.mark.parametrize("language", sorted(SOURCES))
@pytest.mark.parametrize("text", ["", "}", "{{{", "((", "end end", "class", "function f(", "/* open", "'", '"""', "class A { void f() {", "x" * 50_000, "{" * 20_000, "def " * 3_000])
def test_broken_texts_are_read(language, text):
    assert isinstance(f.definitions("p.x", text, language), list)
    assert isinstance(list(f.calls("p.x", text, language)), list) and isinstance(f.aliases("p.x", text, language), dict)


def test_tables_hold_all_languages(spark):
    rows = [(f"a/{x}.src", t, x) for x, t in SOURCES.items()] + [("a/p.py", "def g():\n    h()\n", "python"), ("a/bad.py", "def (", "python"), ("n", None, "go"), (None, "x", "go"), ("z", "x", None)]
    files = spark.createDataFrame(rows, "path string, text string, language string")
    nodes = tree.nodes(files)
    assert {r.language for r in nodes.where("error is null").collect()} == {*SOURCES, "python"} and [r.file for r in nodes.where("error is not null").collect()] == ["a/bad.py"]
    assert tree.call_sites(files).count() == sum(map(len, CALLS.values())) + 1 and tree.aliases(files).count() == sum(map(len, ALIASES.values()))
