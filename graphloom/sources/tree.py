"""Source trees as tables: discovery, reading, parsing, and snippets of definitions.

Files are read as bytes in parallel; a file that is no UTF-8 text or can't be parsed gives an error row, never a failure.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import IGNORED, ignore_regex, language_of
from graphloom.sources import frontends

NODE_DDL = (
    "file string, node_id string, name string, type string, language string, decorators array<string>, parameters array<string>, return_type string, docstring string, "
    "comments array<string>, bases array<string>, start_line int, end_line int, body_hash string, node_ord bigint, error string"
)
CALL_DDL = "file string, language string, caller string, receiver string, method string, pos bigint"
ALIAS_DDL = "file string, alias string, original string"


def discover(spark: SparkSession, root: str, extra_ignored: list[str] | None = None) -> DataFrame:
    """The source files under root with their language: path (relative), language, content (bytes), mtime, size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", r"^.*?" + base.replace("\\", "\\\\").replace(".", "\\.") + "/", "")
    rows = files.select(path.alias("path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return kept(rows, extra_ignored).withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull())


def kept(files: DataFrame, extra_ignored: list[str] | None = None) -> DataFrame:
    """The files (path, ...) that no ignore pattern matches."""
    return files.where(~F.col("path").rlike(ignore_regex([*IGNORED, *(extra_ignored or [])])))


def texts(files: DataFrame) -> DataFrame:
    """Files with content as text, line ends made alike, and error where the bytes are no UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.regexp_replace(text, r"\r\n", "\n")).withColumn("error", F.when(text.isNull() & F.col("content").isNotNull(), "not UTF-8")).drop("content")


def _names(nodes: list[ast.expr]) -> list[str]:
    return [ast.unparse(n) for n in nodes]


def _inner(n: ast.stmt) -> list[ast.stmt]:
    """The statements directly inside a compound statement, in order: of all branches, handlers and cases."""
    out: list[ast.stmt] = []
    for child in ast.iter_child_nodes(n):
        if isinstance(child, ast.stmt):
            out.append(child)
        elif isinstance(child, (ast.ExceptHandler, ast.match_case)):
            out += child.body
    return out


def python_nodes(path: str, text: str) -> Iterator[dict]:
    """The definitions of a Python file: functions, classes and methods; functions in functions are not entered."""
    tree = ast.parse(text)
    lines = text.split("\n")
    notes = {i: x.split("#", 1)[1].strip() for i, x in enumerate(lines, 1) if "#" in x and any(k in x for k in ("TODO", "FIXME"))}

    def visit(body: list[ast.stmt], owner: str) -> Iterator[dict]:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(n, ast.ClassDef)
                name = f"{owner}.{n.name}" if owner else n.name
                args = [] if cls else [a.arg for a in (*n.args.posonlyargs, *n.args.args, *([n.args.vararg] if n.args.vararg else []), *n.args.kwonlyargs, *([n.args.kwarg] if n.args.kwarg else []))]
                yield {
                    "file": path, "node_id": f"{path}::{name}", "name": n.name, "type": "class" if cls else "method" if owner else "function", "language": "python",
                    "decorators": _names(n.decorator_list), "parameters": args, "return_type": None if cls or n.returns is None else ast.unparse(n.returns),
                    "docstring": ast.get_docstring(n), "comments": [t for i, t in notes.items() if n.lineno <= i <= n.end_lineno], "bases": _names(n.bases) if cls else [],
                    "start_line": n.lineno, "end_line": n.end_lineno, "body_hash": hashlib.md5("\n".join(lines[n.lineno - 1 : n.end_lineno]).encode()).hexdigest(), "error": None,
                }
                if cls:
                    yield from visit(n.body, name)
            else:
                yield from visit(_inner(n), owner)

    yield from visit(tree.body, "")


def python_calls(path: str, text: str) -> Iterator[tuple[str, str, str | None, str, int]]:
    """The calls in a Python file's functions: file, caller, receiver (the nearest name, or null), method, position."""
    owners: list[str] = []

    def visit(node: ast.AST) -> Iterator[tuple]:
        named = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        if named:
            owners.append(node.name)
        if isinstance(node, ast.Call) and owners:
            f = node.func
            if isinstance(f, ast.Name):
                yield path, f"{path}::{'.'.join(owners)}", None, f.id, node.lineno
            elif isinstance(f, ast.Attribute):
                inner = f.value.func if isinstance(f.value, ast.Call) else f.value
                receiver = inner.id if isinstance(inner, ast.Name) else inner.attr if isinstance(inner, ast.Attribute) else None
                yield path, f"{path}::{'.'.join(owners)}", receiver, f.attr, node.lineno
        for child in ast.iter_child_nodes(node):
            yield from visit(child)
        if named:
            owners.pop()

    yield from visit(ast.parse(text))


def python_aliases(path: str, text: str) -> dict[str, str]:
    """What a Python file imports: the name used in it, and the original; the last import of a name wins."""
    out: dict[str, str] = {}
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                out[a.asname or a.name.split(".")[0]] = a.name if isinstance(node, ast.ImportFrom) else a.name.split(".")[-1] if a.asname else a.name.split(".")[0]
    return out


def nodes(files: DataFrame) -> DataFrame:
    """The definitions of the files of `texts` in all known languages; a file that can't be parsed gives one row with its error."""
    columns = [c.strip().split(" ")[0] for c in NODE_DDL.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[dict] = []
            for path, text, language in zip(part["path"], part["text"], part["language"], strict=True):
                try:
                    found = python_nodes(path, text) if language == "python" else [x for x, _ in frontends.definitions(path, text, language)]
                    rows += [x | {"node_ord": i} for i, x in enumerate(found)]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append(dict.fromkeys(columns) | {"file": path, "language": language, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return _readable(files).mapInPandas(run, NODE_DDL)


def _readable(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(*frontends.RULES) & F.col("path").isNotNull() & F.col("text").isNotNull()).select("path", "text", "language")


def _tabled(files: DataFrame, extract, ddl: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in ddl.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for path, text, language in zip(part["path"], part["text"], part["language"], strict=True):
                try:
                    rows += extract(path, text, language)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue  # nodes() reports the file
            yield pd.DataFrame(rows, columns=columns)

    return _readable(files).mapInPandas(run, ddl)


def call_sites(files: DataFrame) -> DataFrame:
    """The calls in functions of the files of `texts`: file, language, caller, receiver (the nearest name, or null), method, pos (the line)."""

    def extract(path: str, text: str, language: str) -> list[tuple]:
        found = python_calls(path, text) if language == "python" else frontends.calls(path, text, language)
        return [(row[0], language, *row[1:]) for row in found]

    return _tabled(files, extract, CALL_DDL)


def aliases(files: DataFrame) -> DataFrame:
    """What the files of `texts` import: file, alias (the name in the file) and original."""

    def extract(path: str, text: str, language: str) -> list[tuple]:
        found = python_aliases(path, text) if language == "python" else frontends.aliases(path, text, language)
        return [(path, a, o) for a, o in found.items()]

    return _tabled(files, extract, ALIAS_DDL)


def strategy(language: F.Column) -> F.Column:
    """How a language looks for functions: file, package, global, or null without rules."""
    out = F.lit(None).cast("string")
    for name, (how, _, _) in frontends.RULES.items():
        if how:
            out = F.when(language == name, how).otherwise(out)
    return out


def is_dynamic(language: F.Column, caller_name: F.Column) -> F.Column:
    """Whether a caller's calls are dynamic, by its language or by its name."""
    out = language.isin(*frontends.DYNAMIC)
    for name, (_, _, markers) in frontends.RULES.items():
        if markers:
            out = out | ((language == name) & caller_name.isin(*markers))
    return out


def snippet(lines: list[str], start: int, most_bytes: int = 10_240) -> str:
    """The definition that begins at a line (from 1): up to the first line that is indented no further, and most_bytes at most."""
    first = lines[start - 1]
    depth = len(first) - len(first.lstrip())
    out = [first]
    for line in lines[start:]:
        if line.strip() and len(line) - len(line.lstrip()) <= depth and not line.lstrip().startswith((")", "]", "}")):
            break
        out.append(line)
    return "\n".join(out).rstrip()[:most_bytes]
