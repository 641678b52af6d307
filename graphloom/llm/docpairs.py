"""Functions and methods paired with their documentation.

One pattern for each language captures documentation, signature and balanced body together. A function's whole body is
part of its match, so functions inside functions are not found; strings and comments are taken whole, so code within them
isn't either. What the pattern captures is then filtered: documentation that is empty or trivial makes no pair.

Defined cases: null and empty contents, and files of another or no known language, give no rows; an unclosed string or
comment reaches to its line's or the text's end, a bracket without a partner counts as white space, so a function whose
body doesn't end has none and is not found; repeated files give repeated rows until made distinct;
columns that aren't named are not read.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.lexical import balanced, define, language_of
from graphloom.operators.skew import spread

#: Words that open blocks or expressions and never name a function.
_NO_NAME = "if for while switch catch return new throw else do try with using lock fixed foreach await yield typeof function when synchronized sizeof nameof"
#: Words that can't be the type of a function's result.
_NO_TYPE = "return new throw else await case class struct enum record delegate event interface namespace package import using goto in is as out ref var"
_MODIFIERS = (
    "public protected private internal static final abstract synchronized native default strictfp virtual override sealed async extern unsafe partial readonly new"
)

_rx = cache(regex.compile)


def _words(text: str) -> str:
    return "|".join(text.split())


_JSDOC = r"/\*\*(?![*/])(?:[^*]|\*(?!/))*+\*/"
_SLASHES = r"(?:///(?!/)[^\n]*(?:\n[ \t]*(?=///(?!/)))?)+"

_TS_TYPE = r"(?:[\w$.\s|&?,'\"]|(?&angle)|(?&paren)|(?&brack)|=>|(?&brace)(?=\s*(?:[|&{\[]|=>)))*?"
_NAME = r"(?P<name>[\p{L}_$\#][\w$]*)"
_ARROW_BODY = r"=>\s*(?:(?&brace)|(?&paren)|[^;{\n]*+)"

_BODIES = {
    "script": [
        rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*(?&angle)?\s*(?P<params>(?&paren))\s*(?::{_TS_TYPE})?\s*(?&brace)",
        rf"(?:export\s+)?(?:default\s+)?const\s+{_NAME}\s*(?::[^=;]*?(?:=>[^=;]*?)*)?=\s*(?:async\s+)?(?:"
        rf"function\s*\*?\s*[\w$]*\s*(?&angle)?\s*(?P<params>(?&paren))\s*(?::{_TS_TYPE})?\s*(?&brace)"
        rf"|(?&angle)?\s*(?P<params>(?&paren))\s*(?::{_TS_TYPE})?\s*{_ARROW_BODY}|(?P<params>[\w$]+)\s*{_ARROW_BODY})",
        rf"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set|declare)\s+)*+\*?\s*(?!(?:{_words(_NO_NAME)})\b){_NAME}\??\s*(?&angle)?\s*(?P<params>(?&paren))\s*(?::{_TS_TYPE})?\s*(?&brace)",
        rf"(?:async\s+)?(?:function\s*\*?\s*(?&angle)?\s*(?&paren)\s*(?::{_TS_TYPE})?\s*(?&brace)|(?&paren)\s*(?::{_TS_TYPE})?\s*=>\s*(?&brace))",
    ],
    "typed": [
        rf"(?:(?:{_words(_MODIFIERS)})\s++)*+(?:(?&angle)\s*)?(?P<type>(?!(?:{_words(_NO_TYPE)})\b)(?:[\w.]+(?:\s*(?&angle))?|(?&paren))(?:\s*\[[\s,]*\])*\??\s+)?"
        rf"(?!(?:{_words(_NO_NAME)})\b)(?:[\w]+\.)?{_NAME}\s*(?&angle)?\s*(?P<params>(?&paren))\s*(?:throws\s[\w.,\s<>]+?|(?:where\s[^{{;=]+)|:\s*(?:base|this)\s*(?&paren))?\s*(?:(?&brace)|=>[^;]*+;|(?(type);|(?!)))",
    ],
    "go": [r"func\s*(?:(?&paren)\s*)?" + _NAME + r"\s*(?&brack)?\s*(?P<params>(?&paren))(?:(?&paren)|interface\s*\{\s*\}|struct\s*\{\s*\}|[^(){}\n\"`])*?(?&brace)", r"func\s*(?&paren)[^{}\n]*?(?&brace)"],
    "rust": [
        r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*+fn\s+(?:r\#)?" + _NAME
        + r"\s*(?&angle)?\s*(?P<params>(?&paren))(?:(?&brack)|(?&angle)|->|[^{};\[<])*?(?:(?&brace)|;)",
    ],
}
_KIND = {"typescript": "script", "javascript": "script", "java": "typed", "csharp": "typed", "go": "go", "rust": "rust"}
_DOCS = {
    "typescript": _JSDOC, "javascript": _JSDOC, "java": _JSDOC, "rust": f"{_SLASHES}|{_JSDOC}", "csharp": f"{_SLASHES}|{_JSDOC}",
    "go": r"(?<=^[ \t]*)(?:(?://[^\n]*\n[ \t]*)+|/\*(?:[^*]|\*(?!/))*+\*/[ \t]*\r?\n[ \t]*)(?=func\b)",
}
_ATTRIBUTES = {
    "typescript": r"@[\w.$]+\s*(?&paren)?", "javascript": r"@[\w.$]+\s*(?&paren)?", "java": r"@(?!interface\b)[\w.]+\s*(?&paren)?", "rust": r"\#!?\s*(?&brack)", "csharp": r"(?&brack)",
    "go": r"(?!)",
}


@cache
def pattern(language: str) -> regex.Pattern:
    """Captures doc, name, params and code of the next function, or skips a string, a comment, a word or a character."""
    if language == "python":
        signature = r"(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?&brack)?\s*(?P<params>(?&paren))\s*(?:->(?:[^:\"'\[({\n\#]|(?&str)|(?&paren)|(?&brack))*+)?:"
        one = r"(?:(?<![\w\"'])(?![bBfFtT]{1,2}[\"'])(?&str))"
        docstring = rf"(?:(?:[ \t\r\f]*(?:\#[^\n]*)?\n)*[ \t]*(?P<doc>{one}(?:\s*{one})*?(?=[ \t\r]*(?:[;\n\#]|\Z))|{one}(?:[ \t\\]+\n?[ \t]*{one})+(?=[ \t\r]*(?:[;\n\#]|\Z))|\((?:\s|\#[^\n]*\n|{one})+\)(?=[ \t\r]*(?:[;\n\#]|\Z))))?"
        body = r"(?:(?&str)|(?&com)|(?&paren)|(?&brack)|(?&brace)|\\\r?\n|\w++|[^\n\"'\#\\]|\\|\n(?=(?P=ind)[ \t]|[ \t\r\f]*(?:\#[^\n]*)?(?:\n|\Z)))*+"
        functions = rf"(?P<code>^(?P<ind>[ \t]*){signature}{docstring}{body})"
        return regex.compile(define(language) + functions + r"|(?&com)|(?&str)|\w++|(?s:.)", regex.M)
    doc, attribute = _DOCS[language], _ATTRIBUTES[language]
    bodies = "|".join(_BODIES[_KIND[language]])
    gap = rf"(?:\s|(?!{doc})(?&com)|{attribute})*+" if language != "go" else ""
    functions = rf"(?<![\w$.@])(?:(?P<doc>{doc}){gap})?+(?P<code>(?:{attribute}\s*)*+(?:{bodies}))"
    return regex.compile(define(language) + functions + r"|(?&com)|(?&str)|\w++|\s++|(?s:.)", regex.M)


def doc_text(language: str, doc: str) -> str:
    """The documentation without its marks."""
    if language == "python":
        try:
            return str(ast.literal_eval(doc if doc.startswith("(") else f"({doc})"))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return _rx(r"""^\(?[rRuU]?["']{1,3}|["']{1,3}\)?$""").sub("", doc)
    if doc.lstrip().startswith("/*"):
        inner = _rx(r"^\s*/\*+|\*+/\s*$").sub("", doc)
        return "\n".join(_rx(r"^\s*\*+ ?").sub("", x) for x in inner.split("\n"))
    return "\n".join(_rx(r"^\s*//+!? ?").sub("", x) for x in doc.split("\n"))


#: Heading words of documentation sections.
_HEADINGS = "args arguments parameters params other parameters returns return value yields raises exceptions throws errors example examples note notes see also attributes keyword arguments panics safety remarks summary warning warnings references usage todo"
_HEADING = regex.compile(r"^\s*(?:#{1,6}\s.*|[=\-~*_#.\s]{3,}|(?:" + "|".join(regex.escape(x).replace(r"\ ", r"\s") for x in ["keyword arguments", "other parameters", "return value", "see also", *_HEADINGS.split()]) + r")\s*:?)\s*$", regex.I)
_TAG = regex.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]*>", regex.S)
_NAMING = [
    regex.compile(r"^\s*[@\\:](?:param|arg|argument|parameter|key|keyword|tparam|typeparam|property|prop|template)\b\s*(?:\{[^}\n]*\}\s*)?(?:[\w.<>\[\]|,]+\s+(?=[\w.$*]+\s*:))?\[?[\w.$*<>]+(?:=[^\]\s]*)?\]?\s*(?::|[-–—])?"),
    regex.compile(r"^\s*[@\\:](?:returns?|rtype|type|throws|raises?|exception|since|author|version|see|deprecated|override|inheritdoc)\b\s*(?:\{[^}\n]*\})?\s*:?(?:(?<=:)\s*[\w.\[\], |]+$|\s*[\w.]+\s*:?$)?", regex.I),
    regex.compile(r"^\s*(?:[-*+•]\s*)?[`*_]*(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\w.$*])+[`*_]*\s*(?:\([^()\n]*\)|\[[^\[\]\n]*\])?\s*(?::\s*[\w.\[\]]*)?(?:\s*[-–—])?\s*$"),
]
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]")
_WORD = regex.compile(r"(?!\d+\b)[\p{L}\p{N}_]+(?:['’\-.][\p{L}\p{N}_]+)*")
#: Notes that a documentation is yet to be written.
_UNWRITTEN = regex.compile(
    r"""^\W*(?:(?:todo|fixme|tbd|tbc|xxx|hack|wip)\b\W*)?(?:(?:please\s+)?(?:add|write|fill\s+in|insert|provide|complete|finish|update|improve)\s+(?:\w+\s+){0,3}?(?:docs?|documentation|docstring|description|comment|text)\b[^.]*
|(?:docs?|documentation|docstring|description|comment|text|this)\b(?:\s+\w+){0,6}?\s+(?:missing|pending|later|soon|needed|wanted|outstanding|to\s+(?:be\s+)?(?:\w+\s+)?(?:written|documented|added|follow|completed|described|done|filled|come)|not\s+(?:yet\s+)?(?:written|documented|available|described|there))\b[^.]*
|(?:not\s+(?:yet\s+)?(?:documented|described|written)|undocumented|to\s+be\s+(?:documented|written|described|done|added|completed))\b[^.]*
|(?:noch\s+(?:zu\s+(?:beschreiben|dokumentieren|schreiben|ergänzen)|nicht\s+(?:beschrieben|dokumentiert|geschrieben))|(?:beschreibung|dokumentation)\s+(?:folgt|fehlt|ergänzen|nachtragen))\b[^.]*
|(?:à\s+(?:documenter|compléter|rédiger|décrire)|(?:documentation|description)\s+à\s+\w+)\b[^.]*
|(?:por\s+(?:documentar|escribir|completar|describir)|(?:documentación|descripción)\s+(?:pendiente|por\s+\w+)|falta\s+(?:la\s+)?(?:documentación|descripción))\b[^.]*
|(?:(?:a|por)\s+(?:documentar|escrever|completar|descrever)|(?:documentação|descrição)\s+(?:pendente|por\s+\w+|a\s+\w+)|falta\s+(?:a\s+)?(?:documentação|descrição))\b[^.]*
|(?:описание|документация|текст)\s+(?:будет|позже|отсутствует|добавить|дополнить)[^.]*|(?:дописать|добавить|написать)\s+(?:описание|документацию)[^.]*
|(?:待|尚未|未)(?:補|补|撰|編|编|說|说|記|记|寫|写|完)\S{0,12}|(?:後で|あとで)\S{0,6}(?:書|記|追)\S{0,8}|説明(?:は)?(?:後|未|なし)\S{0,10}|未(?:記述|記載|作成)\S{0,8})\W*$""",
    regex.I | regex.X,
)
_MARK = regex.compile(r"^\W*(?:todo|fixme|tbd|tbc|xxx|wip)\b", regex.I)


def _parts(name: str) -> list[str]:
    return [x.lower() for x in _rx(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\d+|[^\W_]").findall(name)]


def real_lines(text: str) -> list[str]:
    """The lines that document: without headings and without what merely names a parameter."""
    kept = []
    for line in _TAG.sub(" ", text).split("\n"):
        if _HEADING.match(line):
            continue
        for n in _NAMING:
            line = n.sub("", line)
        line = _rx(r"\{@\w+\s+([^}]*)\}").sub(r"\1", line).strip()
        if line:
            kept.append(line)
    return kept


def is_trivial(text: str, name: str) -> bool:
    """Fewer than five words (Chinese, Japanese: eight characters), only the name again, or only a note that it is to come."""
    body = " ".join(real_lines(text))
    wide = len(_CJK.findall(body))
    words = _WORD.findall(_CJK.sub(" ", body))
    if len(words) < 5 and wide < 8:
        return True
    if _UNWRITTEN.match(body) or _MARK.match(body):
        return True
    said = [p for w in words for p in _parts(w)]
    own = _parts(name)
    idle = {"the", "a", "an", "this", "that", "function", "method", "of", "for", "to", "in", "and", "is", "it"}
    return not wide and {*said} <= {*own} | idle


def functions(language: str, content: str) -> Iterator[tuple[str, int, str | None, list[str], str, str]]:
    """Of each function: name, line, documentation (None if trivial), parameters, kind and code."""
    line, at = 1, 0
    content = balanced(language, content)
    for m in pattern(language).finditer(content):
        name = m.group("name")
        if name is None:
            continue
        start = m.start("name")
        line += content.count("\n", at, start)
        at = start
        doc = m.group("doc")
        text = doc_text(language, doc) if doc else None
        if text is not None and is_trivial(text, name):
            text = None
        code = m.group("code")
        params = parameters(m.group("params") or "")
        yield name, line, text, params, "method" if _is_method(language, params, code, m.group(0)) else "function", code


def parameters(text: str) -> list[str]:
    """The parameters as written, split at commas outside brackets and strings."""
    inner = text[1:-1] if text.startswith("(") else text
    parts, depth, begin, quote = [], 0, 0, ""
    for i, ch in enumerate(inner):
        if quote:
            quote = "" if ch == quote and inner[i - 1] != "\\" else quote
        elif ch in "\"'`":
            quote = ch if ch != "'" or inner.count("'") % 2 == 0 else ""
        elif ch in "([{<":
            depth += 1
        elif ch in ")]}>" and not (ch == ">" and inner[i - 1 : i] in ("-", "=")):
            depth -= 1
        elif ch == "," and depth <= 0:
            parts.append(inner[begin:i])
            begin = i + 1
    parts.append(inner[begin:])
    stripped = (_rx(r"\#[^\n]*|//[^\n]*|/\*.*?\*/", regex.S).sub("", p).strip() for p in parts)
    return [p for p in stripped if p]


def _is_method(language: str, params: list[str], code: str, whole: str) -> bool:
    if language == "python":
        return bool(params) and params[0].split(":")[0].strip() in ("self", "cls")
    if language == "go":
        return bool(_rx(r"func\s*\(").match(code))
    if language == "rust":
        return bool(params) and bool(_rx(r"(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?self\b").match(params[0]))
    if language in ("java", "csharp"):
        return True
    return not _rx(r"^(?:@\S+\s*)*(?:export\s+|default\s+|declare\s+|async\s+)*(?:function|const)\b").search(code)


_SCHEMA = pa.schema([
    ("file_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("line_no", pa.int64()), ("docstring", pa.string()),
    ("parameters", pa.list_(pa.string())), ("type", pa.string()), ("code", pa.string()),
])
_DDL = "file_id bigint, path string, language string, name string, line_no bigint, docstring string, parameters array<string>, type string, code string"


def _cleaned(text: str) -> str:
    return text if text.isascii() else _rx("[\ud800-\udfff]").sub("\N{REPLACEMENT CHARACTER}", text)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    for part in batches:
        for file_id, path, named, content in zip(*(part.column(i) for i in range(4)), strict=True):
            path = path.as_py()
            language = language_of(named.as_py(), path)
            if language is None:
                continue
            for name, line, doc, params, kind, code in functions(language, content.as_py()):
                if doc is not None:
                    rows.append((file_id.as_py(), path, language, name, line, _cleaned(doc), params, kind, code))
            if len(rows) >= 500:
                yield batch()
                rows = []
    if rows:
        yield batch()


def documented_functions(files: DataFrame) -> DataFrame:
    """The code-description pairs of files (file_id, path, language, content).

    file_id, path, language, name, line_no, docstring (without marks), parameters, type (function or method) and code
    (from the attributes to the end of the body), one row for each function with real documentation.
    """
    return spread(files.select("file_id", "path", "language", "content").where("content is not null and content <> ''")).mapInArrow(_extract, _DDL)


def documented_names(files: DataFrame) -> DataFrame:
    """file_id, func_name, line_no of every function with real documentation."""
    pairs = documented_functions(files)
    return pairs.select("file_id", pairs["name"].alias("func_name"), "line_no").distinct()
