"""Definitions, calls and imports of source files in languages other than Python, by a scan of their lexical structure.

Comments and strings are blanked first, so that what is left can be read by its brackets. A scan goes from statement to
statement: a header that opens a class goes in, one that opens a function is taken with its body and left, as functions
inside functions are not entered; any other block is entered too. Ruby is read by its keywords and their `end`.

Defined cases: brackets without a partner close at the text's end; a file of no known language gives nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

#: How a language finds functions (file, package, global), reads imports, and which callers' names mark dynamic calls.
RULES = {
    "python": ("file", "qualified", ("__getattr__", "getattr")),
    "typescript": ("file", "es_module", ("any_typed_call",)),
    "javascript": ("file", "es_module", ()),
    "java": ("package", "namespaced", ("reflection_invoke",)),
    "go": ("package", "module_path", ("reflect_value_call",)),
    "rust": ("package", "module_path", ("dyn_trait_call",)),
    "ruby": ("global", "qualified", ("method_missing", "define_method", "send")),
    "php": ("package", "namespaced", ("__call", "call_user_func")),
    "csharp": ("package", "namespaced", ("dynamic",)),
    "c": (None, None, ()),
    "cpp": (None, None, ()),
}
#: Languages whose every call is dynamic.
DYNAMIC = ("ruby",)

_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)', r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
_STRINGS = {
    "typescript": rf"`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|{_DOUBLE}|{_SINGLE}", "java": rf'"""[\s\S]*?(?:"""|\Z)|{_DOUBLE}|{_CHAR}', "go": rf"`[^`]*(?:`|\Z)|{_DOUBLE}|{_CHAR}",
    "rust": rf'r(?P<h>#*)"[\s\S]*?(?:"(?P=h)|\Z)|"(?:[^"\\]|\\[\s\S])*(?:"|\Z)|{_CHAR}', "csharp": rf'\$*"""[\s\S]*?(?:"""|\Z)|(?:@\$?|\$@)"(?:[^"]|"")*(?:"|\Z)|\$?{_DOUBLE}|{_CHAR}',
    "php": r'"(?:[^"\\]|\\[\s\S])*(?:"|\Z)|' + r"'(?:[^'\\]|\\[\s\S])*(?:'|\Z)", "ruby": f"{_DOUBLE}|{_SINGLE}", "c": f"{_DOUBLE}|{_CHAR}",
}
_STRINGS |= {"javascript": _STRINGS["typescript"], "cpp": r'R"(?P<d>[^(\s]*)\([\s\S]*?(?:\)(?P=d)"|\Z)|' + _STRINGS["c"]}
_COMMENTS = dict.fromkeys(_STRINGS, f"{_LINE}|{_BLOCK}") | {"php": rf"{_LINE}|#(?!\[)[^\n]*|{_BLOCK}", "ruby": r"#[^\n]*|^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z)"}
#: Words before a bracket that call nothing.
_NO_CALL = frozenset("if for while switch catch return throw new function func fn sizeof typeof await yield match elseif elif else do in and or not when unless until case using lock fixed foreach super this self echo defined delete void def class".split()) - {"new"}
_CLASS = {
    "typescript": r"class\s+(?P<name>[\w$]+)", "java": r"(?:class|interface|enum)\s+(?P<name>\w+)", "csharp": r"(?:class|interface|struct|enum)\s+(?P<name>\w+)",
    "go": r"(?:type\s+)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?(?:struct|interface)\b", "rust": r"(?:struct|enum|trait)\s+(?P<name>\w+)", "php": r"(?:class|trait|interface|enum)\s+(?P<name>\w+)",
    "c": r"(?:typedef\s+)?(?:struct|enum)\s+(?P<name>\w+)", "cpp": r"(?:typedef\s+)?(?:class|struct|enum(?:\s+class|\s+struct)?)\s+(?P<name>\w+)",
}
_CLASS["javascript"] = _CLASS["typescript"]
_MODIFIER = r"(?:(?:export|default|declare|public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|synchronized|native|strictfp|readonly|extern|unsafe|inline|constexpr|explicit|friend|pub(?:\s*\([^)]*\))?|const|get|set|new|open)\s+)*"
_FUNCTION = {
    "typescript": (rf"{_MODIFIER}function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(){{}}]*>)?\s*(?=\()", rf"{_MODIFIER}\*?\s*(?P<name>#?[\w$]+)\??\s*(?:<[^(){{}}]*>)?\s*(?=\()"),
    "java": (None, rf"{_MODIFIER}(?:<[^(){{}}]*>\s*)?(?P<type>(?:[\w.]+(?:<[^(){{}};]*>)?(?:\s*\[\s*\])*\??\s+)?)(?P<name>\w+)\s*(?:<[^(){{}}]*>)?\s*(?=\()"),
    "go": (r"func\s*(?:\((?P<owner>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?=\()", None),
    "rust": (rf"{_MODIFIER}fn\s+(?:r#)?(?P<name>\w+)\s*(?:<[^(){{}}]*>)?\s*(?=\()",) * 2, "php": (rf"{_MODIFIER}function\s*&?\s*(?P<name>\w+)\s*(?=\()",) * 2,
    "c": (r"(?P<type>(?:[\w:<>,*&~]+[\s*&]+)*?)(?P<name>~?[\w:]+)\s*(?=\()",) * 2,
}
_FUNCTION |= {"javascript": _FUNCTION["typescript"], "csharp": _FUNCTION["java"], "cpp": _FUNCTION["c"]}
_ATTRIBUTE = {"typescript": r"@[\w.$]+", "javascript": r"@[\w.$]+", "java": r"@(?!interface\b)[\w.]+", "rust": r"#!?(?=\[)", "csharp": r"(?=\[)", "php": r"#(?=\[)"}
#: Languages in which a line's end may end a statement.
_NEWLINES = ("go", "typescript", "javascript")
#: Languages in which a function without a body is a definition, inside a class.
_BODILESS = ("java", "csharp", "php")
_DOC_MARKS = {"typescript": ("/**",), "javascript": ("/**",), "java": ("/*",), "rust": ("///", "//!"), "csharp": ("///",), "php": ("/**",)}


@cache
def _lexer(language: str) -> re.Pattern:
    return re.compile(f"(?P<c>{_COMMENTS[language]})|(?P<s>{_STRINGS[language]})", re.M)


@dataclass
class Text:
    """A file's text with comments blanked (plain), strings too (bare), its comments, and the partners of its brackets."""

    whole: str
    plain: str
    bare: str
    comments: list[tuple[int, int]]
    partner: dict[int, int]


def read(text: str, language: str) -> Text:
    comments, plain, bare, at = [], [], [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    scan = text
    if language in ("c", "cpp"):  # lines for the preprocessor are no statements
        scan = re.sub(r"^[ \t]*#(?:\\\r?\n|[^\n])*", lambda m: blank(m.group()), text, flags=re.M)
    for m in _lexer(language).finditer(scan):
        plain.append(scan[at : m.start()])
        bare.append(scan[at : m.start()])
        empty = blank(m.group())
        if m.group("c") is not None:
            comments.append(m.span())
            plain.append(empty)
        else:
            plain.append(m.group())
        bare.append(empty)
        at = m.end()
    plain.append(scan[at:])
    bare.append(scan[at:])
    scanned = "".join(bare)
    partner, stack, opens, held = {}, [], {")": "(", "]": "[", "}": "{"}, dict.fromkeys("([{", 0)
    for m in re.finditer(r"[()\[\]{}]", scanned):
        c = m.group()
        if c in "([{":
            stack.append((c, m.start()))
            held[c] += 1
        elif held[opens[c]]:
            while stack:
                o, start = stack.pop()
                held[o] -= 1
                partner[start] = m.start()
                if o == opens[c]:
                    partner[m.start()] = start
                    break
    for _, start in stack:
        partner.setdefault(start, len(scanned))
    return Text(text, "".join(plain), scanned, comments, partner)


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and not (c == ">" and text[i - 1 : i] in "-="):
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(text[begin:i])
            begin = i + 1
    return [x for x in (re.sub(r"\s+", " ", p).strip() for p in [*out, text[begin:]]) if x]


def _doc(t: Text, language: str, end: int, start: int) -> str | None:
    """The documentation between the code before (end) and a header (start)."""
    marks = _DOC_MARKS.get(language)
    near = [t.whole[a:b] for a, b in t.comments if end <= a and b <= start]
    near = [c for c in near if marks is None or c.startswith(marks)]
    if not near:
        return None
    kept = near[-1:] if near[-1].startswith("/*") else [c for c in near if not c.startswith("/*")]
    lines = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|//+!?|#+)\s?|\s*\*+/\s*$", "", line) for c in kept for line in c.split("\n")]
    return "\n".join(lines).strip() or None


def _bases(language: str, head: str) -> list[str]:
    """The names a class head inherits from."""
    if language in ("csharp", "cpp"):
        found = head.split(":", 1)[1] if ":" in head.replace("::", "  ") else ""
        found = re.split(r"\bwhere\b", found)[0]
    else:
        found = ",".join(re.findall(r"\b(?:extends|implements)\b((?:(?!\b(?:extends|implements|permits)\b)[^{])*)", head))
    return [n for n in (re.sub(r"<.*|\(.*", "", re.sub(r"\b(?:public|private|protected|virtual)\b", "", p)).strip() for p in _parts(found)) if n]


def brace_nodes(path: str, text: str, language: str) -> Iterator[tuple[dict, tuple[int, int]]]:
    """Definitions of a file in a language of braces, each with the place of its body."""
    t = read(text, language)
    bare, n = t.bare, len(t.bare)
    lines = text.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    cls = re.compile(rf"{_MODIFIER}{_CLASS[language]}")
    outer, inner = (re.compile(p) if p else None for p in _FUNCTION[language])
    holder = re.compile(r"(?:unsafe\s+)?impl\b(?P<of>[^{;]*)") if language == "rust" else None
    attribute = re.compile(_ATTRIBUTE[language]) if language in _ATTRIBUTE else None
    scopes: list[tuple[int, str | None, bool]] = [(n, None, True)]  # where it ends, the class, whether members may stand here
    at, last = 0, 0

    def line_of(p: int) -> int:
        return bisect.bisect_right(starts, p)

    def node(kind: str, name: str, start: int, end: int, begun: int, **more) -> dict:
        a, b = line_of(start), line_of(max(start, end))
        owner = more.pop("owner", None)
        notes = [t.whole[x:y].lstrip("/*# ").strip() for x, y in t.comments if start <= x < end and re.search(r"TODO|FIXME", t.whole[x:y])]
        return {
            "file": path, "node_id": f"{path}::{owner}.{name}" if owner else f"{path}::{name}", "name": name, "type": kind, "language": language, "decorators": [], "parameters": [], "return_type": None,
            "docstring": _doc(t, language, begun, start), "comments": notes, "bases": [], "start_line": a, "end_line": b, "body_hash": hashlib.md5("\n".join(lines[a - 1 : b]).encode("utf-8", "surrogatepass")).hexdigest(), "error": None,
        } | more

    while at < n:
        while scopes[-1][0] <= at and len(scopes) > 1:
            scopes.pop()
        m = re.compile(r"[\s;}]*").match(bare, at)
        if m.end() > at:
            at = m.end()
            continue
        start, begun, marks = at, last, []
        while attribute and (m := attribute.match(bare, at)):
            end = m.end()
            gap = re.compile(r"\s*").match(bare, end).end()
            if bare[gap : gap + 1] in ("(", "[") and (bare[gap] == "(" or gap == end):
                end = min(t.partner.get(gap, gap) + 1, n)
            if end == at:
                break
            marks.append(text[at:end].strip())
            at = re.compile(r"\s*").match(bare, end).end()
        owner, members = scopes[-1][1], scopes[-1][2]
        if holder and (m := holder.match(bare, at)) and bare[m.end() : m.end() + 1] == "{":
            of = re.sub(r"^\s*<[^{]*?>\s+", "", m.group("of"))
            of = re.split(r"\bfor\b", of)[-1]
            scopes.append((t.partner[m.end()], re.sub(r"\bwhere\b.*", "", of, flags=re.S).strip() or "__impl__", True))
            at = last = m.end() + 1
            continue
        if m := cls.match(bare, at):
            stop = re.compile(r"[{;(=]" if language in ("rust", "c", "cpp") else r"[{;]").search(bare, m.end())
            if stop and stop.group() == "{" and (language not in ("c", "cpp") or ")" not in bare[m.end() : stop.start()]):
                end = t.partner[stop.start()]
                yield node("class", m.group("name"), start, end, begun, decorators=marks, bases=_bases(language, text[m.end() : stop.start()])), (stop.start(), stop.start())
                scopes.append((end, m.group("name"), True))
                at = last = stop.start() + 1
                continue
            if stop and language == "rust" and stop.group() in ";(":
                end = t.partner.get(stop.start(), stop.start())
                yield node("class", m.group("name"), start, end, begun, decorators=marks), (end, end)
                at = last = end + 1
                continue
        pattern = inner if owner is not None and inner is not None else outer
        m = pattern.match(bare, at) if pattern and members else None
        if m is None and pattern is inner and outer is not None and members:
            m = outer.match(bare, at)
        if m and m.group("name") not in _NO_CALL and not (language in ("c", "cpp") and not m.group("type").strip() and owner is None and "::" not in m.group("name")):
            opened = m.end()
            closed = t.partner.get(opened, n)
            stop = re.compile(r"[{;]|=>").search(bare, closed + 1)
            between = bare[closed + 1 : stop.start()] if stop else ""
            plain = re.fullmatch(r"[\s\w.,<>\[\]:|&?*()'\-+=>\"$@!/]*", between) is not None and not re.search(r"(?<![=\-])=(?!>)", between)
            if stop and plain and (stop.group() == "{" or (stop.group() == "=>" and language == "csharp") or (stop.group() == ";" and language in _BODILESS and owner is not None)):
                brace = stop.start()
                if stop.group() == "{" and language == "go" and re.search(r"(?:interface|struct)\s*$", between):
                    brace = bare.find("{", t.partner.get(brace, n))
                if stop.group() == "=>":
                    end = bare.find(";", brace)
                    end = n if end < 0 else end
                else:
                    end = t.partner.get(brace, n) if stop.group() == "{" else brace
                given = m.groupdict()
                name = m.group("name").rsplit("::", 1)[-1]
                belongs = owner
                if language == "cpp" and "::" in m.group("name"):
                    belongs = m.group("name").rsplit("::", 2)[-2]
                if language == "go" and given.get("owner"):
                    belongs = re.sub(r"\[.*|[*\s]", "", given["owner"].split()[-1])
                result = re.sub(r"^(?:\s*(?:public|private|protected)\s*:(?!:))+|\btemplate\s*<[^>]*>|\b(?:static|inline|virtual|extern|explicit|constexpr|friend)\b", "", given["type"]).strip() if "type" in given else re.sub(r"^\s*(?::|->)\s*|\bwhere\b.*|\bthrows\b.*", "", between, flags=re.S).strip()
                kind = "method" if belongs is not None else "function"
                yield node(kind, name, start, end, begun, owner=belongs, decorators=marks, parameters=_parts(t.plain[opened + 1 : closed]), return_type=re.sub(r"\s+", " ", result) or None), (brace, end)
                at = last = end + 1
                continue
        ends = r"\n" if language in _NEWLINES else ""
        stop = re.compile(rf"[;{{}}(\[{ends}]").search(bare, at)
        if not stop:
            break
        if stop.group() in "([":
            at = min(t.partner.get(stop.start(), n), n) + 1
            follows = re.compile(r"\s*").match(bare, at).end()
            if ends and "\n" in bare[at:follows] and bare[follows : follows + 1] != "{":
                at = last = follows
                continue
            if bare[follows : follows + 1] not in ("{", ";"):  # the statement goes on: only its blocks and end count
                nxt = re.compile(rf"[;{{}}{ends}]").search(bare, at)
                at = nxt.start() if nxt else n
            else:
                at = follows
            stop = re.compile(rf"[;{{}}{ends}]").match(bare, at)
            if not stop:
                continue
        if stop.group() == "{":
            scopes.append((t.partner[stop.start()], owner, bool(re.search(r"\b(?:namespace|extern|mod|module)\b[^;{}]*$", bare[start : stop.start()])) or language in ("typescript", "javascript", "php")))
        at = last = stop.start() + 1


_RUBY = re.compile(r"(?P<open>^[ \t]*(?:if|unless|while|until|case|for|begin)\b|(?<![\w.:])(?:do|begin|case)\b(?!\s*:)|=\s*(?:if|unless|case|begin)\b)|(?P<def>^[ \t]*(?:(?:private|public|protected)\s+)?def\s+(?:self\.)?(?P<name>[\w]+[?!=]?))|(?P<cls>^[ \t]*(?P<what>class|module)\s+(?P<cname>[\w:]+)(?:\s*<\s*(?P<base>[\w:]+))?|^[ \t]*class\s*<<\s*self)|(?P<end>(?<![\w.:])end\b(?!\s*:))", re.M)


def ruby_nodes(path: str, text: str) -> Iterator[tuple[dict, tuple[int, int]]]:
    t = read(text, "ruby")
    lines, last = text.split("\n"), 0
    stack: list[tuple[dict | None, str | None, int]] = []
    done: list[tuple[int, dict, tuple[int, int]]] = []
    for m in _RUBY.finditer(t.bare):
        line = t.bare.count("\n", 0, m.end()) + 1
        owner = next((o for _, o, _ in reversed(stack) if o), None)
        inside = any(x is not None and x["type"] != "class" for x, _, _ in stack)
        if m.group("end"):
            if stack:
                node, _, begin = stack.pop()
                if node is not None:
                    node["end_line"] = line
                    node["body_hash"] = hashlib.md5("\n".join(lines[node["start_line"] - 1 : line]).encode("utf-8", "surrogatepass")).hexdigest()
                    done.append((begin, node, (begin, m.end())))
        elif m.group("open"):
            if m.group("open").strip() == "do" and re.search(r"^[ \t]*(?:while|until|for)\b[^\n]*$", t.bare[t.bare.rfind("\n", 0, m.start()) + 1 : m.start()]):
                continue
            stack.append((None, None, m.start()))
        else:
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            doc = _doc(t, "ruby", last, start)
            common = {"file": path, "language": "ruby", "decorators": [], "return_type": None, "docstring": doc, "comments": [], "bases": [], "start_line": line, "error": None}
            if m.group("def"):
                args = re.compile(r"\s*\(([^)]*)\)").match(t.plain, m.end())
                name = m.group("name")
                node = None if inside else common | {"node_id": f"{path}::{owner}.{name}" if owner else f"{path}::{name}", "name": name, "type": "method" if owner else "function", "parameters": _parts(args.group(1)) if args else []}
                if re.compile(r"[ \t]*(?:\([^()\n]*\))?[ \t]*=[ \t](?!=)").match(t.bare, m.end()):  # a method of one line without an end
                    stop = t.bare.find("\n", m.end())
                    if node is not None:
                        node |= {"end_line": line, "body_hash": hashlib.md5(lines[line - 1].encode("utf-8", "surrogatepass")).hexdigest()}
                        done.append((m.end(), node, (m.end(), stop if stop >= 0 else len(text))))
                    continue
                stack.append((node, None, m.end()))
            else:
                name = (m.group("cname") or "").split("::")[-1] or None
                node = common | {"node_id": f"{path}::{name}", "name": name, "type": "class", "parameters": [], "bases": [m.group("base")] if m.group("base") else []} if m.group("what") == "class" and name and not inside else None
                stack.append((node, name or owner, m.end()))
        last = m.end()
    yield from ((node, body) for _, node, body in sorted(done, key=lambda x: x[0]))


def definitions(path: str, text: str, language: str) -> list[tuple[dict, tuple[int, int]]]:
    return list(ruby_nodes(path, text) if language == "ruby" else brace_nodes(path, text, language))


_CALL = re.compile(r"(?<![\w$@])(?P<name>[A-Za-z_$][\w$]*[!?]?)\s*(?:::)?(?:<[\w\s,.<>\[\]:&']*>)?\s*\(")


def calls(path: str, text: str, language: str) -> Iterator[tuple[str, str, str | None, str, int]]:
    """The calls in a file's functions: file, caller, receiver (the nearest name, or null), method, line."""
    t = read(text, language)
    for node, (begin, end) in definitions(path, text, language):
        if node["type"] == "class":
            continue
        line, counted = text.count("\n", 0, begin) + 1, begin
        for m in _CALL.finditer(t.bare, begin, end):
            name, before = m.group("name"), t.bare[max(begin, m.start() - 200) : m.start()]
            if name in _NO_CALL or re.search(r"\b(?:new|function|func|fn|def)\s+$", before):
                continue
            receiver = None
            if link := re.search(r"(?:\??->|\.|::)\s*$" if language in ("php", "c", "cpp") else r"(?:\?\.|\.|::)\s*$", before):
                head = before[: link.start()].rstrip()
                if head.endswith(")"):
                    opened = t.partner.get(m.start() - len(before) + len(head) - 1)
                    head = t.bare[max(begin, opened - 200) : opened].rstrip() if opened is not None else ""
                found = re.search(r"[A-Za-z_$][\w$]*$", head)
                receiver = found.group().lstrip("$") if found else None
            line, counted = line + text.count("\n", counted, m.start()), m.start()
            yield path, node["node_id"], receiver, name, line


def aliases(path: str, text: str, language: str) -> dict[str, str]:
    """What a file imports: the name used in it, and the original; the last import of a name wins."""
    plain, out = read(text, language).plain, {}
    how = RULES[language][1]
    last = lambda s: re.split(r"::|[.\\/]", s.strip().strip("\\"))[-1].strip()
    if how == "es_module":
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?P<default>[\w$]+)?\s*,?\s*(?:\*\s*as\s+[\w$]+\s*)?(?:\{(?P<named>[^}]*)\})?\s*from\b", plain):
            if m.group("default"):
                out[m.group("default")] = m.group("default")
            for part in (m.group("named") or "").split(","):
                words = [w for w in part.split() if w not in ("as", "type")]
                if words:
                    out[words[-1]] = words[0]
    elif language == "java":
        for m in re.finditer(r"(?:^|(?<=;))\s*import\s+(?:static\s+)?([\w.]+)\s*;", plain, re.M):
            out[last(m.group(1))] = last(m.group(1))
    elif language == "csharp":
        for m in re.finditer(r"(?:^|(?<=;))\s*(?:global\s+)?using\s+(?!static\b)(?:(?P<alias>\w+)\s*=\s*)?(?P<name>[\w.]+)\s*;", plain, re.M):
            out[m.group("alias") or last(m.group("name"))] = last(m.group("name"))
    elif language == "php":
        for m in re.finditer(r"(?:^|(?<=;))\s*use\s+(?:function\s+|const\s+)?([\w\\]+?\\?)(?:\{([^}]*)\}|((?:\s+as\s+\w+)?(?:\s*,[^;]*)?))\s*;", plain, re.M):
            for part in (m.group(2) if m.group(2) is not None else m.group(1) + (m.group(3) or "")).split(","):
                name, _, alias = part.strip().partition(" as ")
                if name:
                    out[alias.strip() or last(name)] = last(name)
    elif language == "go":
        for m in re.finditer(r"^\s*import\s+(?:\(([^)]*)\)|([^\n]*))", plain, re.M):
            for alias, path_ in re.findall(r"(?:([\w.]+)[ \t]+)?[\"`]([^\"`]+)[\"`]", m.group(1) or m.group(2) or ""):
                name = last(path_.rstrip("/"))
                if alias not in ("", "_", "."):
                    out[alias] = name
                elif name.isidentifier() and not alias:
                    out[name] = name
    elif language == "rust":
        for m in re.finditer(r"(?:^|(?<=;))\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", plain, re.M):
            out |= dict(_rust_use(m.group(1)))
    return {a: o for a, o in out.items() if a.replace("$", "_").isidentifier() and o}


def _rust_use(item: str) -> Iterator[tuple[str, str]]:
    item = item.strip()
    if item.endswith("}"):
        for part in _parts(item[item.index("{") + 1 : -1]):
            yield from _rust_use(part)
        return
    name, _, alias = item.partition(" as ")
    name = name.split("::")[-1].strip()
    if name.isidentifier() and name not in ("self", "super", "crate"):
        yield alias.strip() or name, name
