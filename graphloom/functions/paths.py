"""Column functions on node ids and file paths. A node id is `<path>::<name>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings by language.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c",
}
#: What is never looked at, whatever a project ignores itself.
IGNORED = [".git/", ".claude/", "node_modules/", "__pycache__/", "dist/", "build/", ".tox/", ".mypy_cache/", ".pytest_cache/", "*.pyc", "*.pyo"]
#: Parts of decorators, and folders, by which frameworks mark entry points.
ENTRY_DECORATORS = [
    "app.route", "Controller", "Get", "Post", "Put", "Delete", "Patch", "RequestMapping", "Cron", "EventSubscriber", "On", "Subscribe", "Scheduled",
    "click.command", "click.group", "typer.command", "app.command", "app.callback",
]
ENTRY_FOLDERS = ["routes/", "handlers/", "controllers/", "views/", "endpoints/", "commands/", "cli/"]
#: Parts of names, and folders, by which persistence is found; endings and name parts of schema files.
PERSIST_NAMES = ["save", "create", "insert", "update", "persist", "repository", "dao"]
PERSIST_FOLDERS = ["models", "schema", "migrations", "entities"]
SCHEMA_ENDINGS = [".sql", ".csv"]
SCHEMA_NAMES = ["schema", "model"]


def _slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def region_of(node_id: Column) -> Column:
    """The first part of the path; `_root_` if there is only one."""
    return F.when(F.contains(node_id, F.lit("/")), F.substring_index(node_id, "/", 1)).otherwise("_root_")


def method_of(target: Column) -> Column:
    """What follows the last dot of a call's target."""
    return F.substring_index(target, ".", -1)


def package_of(file: Column) -> Column:
    """The folder of a file; '' at the top."""
    return F.when(F.contains(file, F.lit("/")), F.regexp_extract(file, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")


def language_of(path: Column) -> Column:
    """The language by the path's ending; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def category_of(node_id: Column) -> Column:
    """operational, test, fixture, script or prototype, by the first rule that holds for the path."""
    path = F.lower(_slashes(F.substring_index(node_id, "::", 1)))
    name = F.substring_index(path, "/", -1)
    test_file = (name == "conftest.py") | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))

    def inside(folder: str, top: bool = True) -> Column:
        anywhere = F.contains(path, F.lit(f"/{folder}/"))
        return anywhere | F.startswith(path, F.lit(f"{folder}/")) if top else anywhere

    return (
        F.when(test_file | inside("tests"), "test").when(inside("fixtures", False), "fixture").when(inside("scripts"), "script")
        .when(F.contains(path, F.lit("/prototype")), "prototype").otherwise("operational")
    )


def persistence_reason(name: Column, file: Column) -> Column:
    """Why a node looks as if it stored something; null if it doesn't."""
    low, path = F.lower(name), F.lower(_slashes(file))
    reasons = [F.when(F.contains(low, F.lit(h)), F.lit(f"name contains '{h}'")) for h in PERSIST_NAMES]
    reasons += [F.when(F.contains(path, F.lit(f"/{d}/")) | F.startswith(path, F.lit(f"{d}/")), F.lit(f"file under '{d}/'")) for d in PERSIST_FOLDERS]
    return F.coalesce(*reasons)


def schema_file_reason(path: Column) -> Column:
    """Why a file looks like a declared schema; null if it doesn't."""
    low = F.lower(_slashes(path))
    name = F.substring_index(low, "/", -1)
    reasons = [F.when(F.endswith(low, F.lit(e)), F.lit(f"schema file ({e})")) for e in SCHEMA_ENDINGS]
    reasons += [F.when(F.endswith(low, F.lit(".json")) & F.contains(name, F.lit(h)), F.lit(f"schema-like json (name contains '{h}')")) for h in SCHEMA_NAMES]
    return F.coalesce(*reasons)


def has_entry_decorator(decorators: Column) -> Column:
    def known(d: Column) -> Column:
        hit = F.lit(False)
        for k in ENTRY_DECORATORS:
            hit = hit | F.contains(d, F.lit(k))
        return hit

    return F.coalesce(F.exists(decorators, lambda d: known(F.regexp_replace(d, "^@+", ""))), F.lit(False))


def in_entry_folder(file: Column) -> Column:
    hit = F.lit(False)
    for d in ENTRY_FOLDERS:
        hit = hit | F.contains(_slashes(file), F.lit(d))
    return hit


def is_cli_entry(name: Column, file: Column, out_degree: Column) -> Column:
    return (out_degree > 0) & ((name == "main") | F.endswith(_slashes(file), F.lit("__main__.py")))


def ignore_regex(patterns: list[str]) -> str:
    """One regular expression for ignore patterns: folders end with a slash, * and ? are wild, a leading / ties to the top."""
    parts = []
    for p in patterns:
        p = p.strip()
        if not p or p.startswith(("#", "!")):
            continue
        start = "^" if p.startswith("/") or "/" in p.rstrip("/") else "(?:^|/)"
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c for c in p.strip("/").replace("**/", "*"))
        parts.append(f"{start}{body}" + ("/" if p.endswith("/") else "(?:/|$)"))
    return "|".join(parts) or r"(?!)"
