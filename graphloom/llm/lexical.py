"""Recursive patterns for the lexical parts of source texts: strings, comments, brackets.

Every pattern is built for the regex library. Named groups inside (?(DEFINE)...) are called as (?&name); brackets call
themselves, and strings and comments are taken whole wherever they stand, so a brace in a string closes nothing.
"""

from __future__ import annotations

from functools import cache

import regex

LANGUAGES = ("python", "typescript", "javascript", "java", "go", "rust", "csharp")

#: File name endings by language.
ENDINGS = {
    "py": "python", "pyi": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go", "rs": "rust", "cs": "csharp",
}
#: Other spellings of language names.
SPELLINGS = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "golang": "go", "rs": "rust", "c#": "csharp", "cs": "csharp"}

_LINE = r"//[^\n]*+"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
_DOUBLE = r'"(?:[^"\\\n]|\\(?s:.))*+(?:"|(?=\n)|\Z)'
_SINGLE = r"'(?:[^'\\\n]|\\(?s:.))*+(?:'|(?=\n)|\Z)"
_TEXT_BLOCK = r'"""(?:[^"\\]|\\(?s:.)|"(?!""))*+(?:"""|\Z)'
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F]*\}|x[0-9a-fA-F]{2}|u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"
_PY_PREFIX = r"(?:\b[rRbBuUfFtT]{1,2})?"

STRINGS = {
    "python": _PY_PREFIX + r'(?:"""(?:[^"\\]|\\(?s:.)|"(?!""))*+(?:"""|\Z)|' + r"'''(?:[^'\\]|\\(?s:.)|'(?!''))*+(?:'''|\Z)|" + _DOUBLE + "|" + _SINGLE + ")",
    "typescript": _DOUBLE + "|" + _SINGLE + r"|`(?:[^`\\$]|\\(?s:.)|\$\{(?:[^{}\"'`]|(?&str)|(?&brace))*+\}|\$)*+(?:`|\Z)",
    "java": _TEXT_BLOCK + "|" + _DOUBLE + "|" + _CHAR,
    "go": r"`[^`]*+(?:`|\Z)|" + _DOUBLE + "|" + _CHAR,
    "rust": r'\b[bc]?r(?P<h>\#*)"(?:(?!"(?P=h))(?s:.))*+(?:"(?P=h)|\Z)|(?:\b[bc])?' + r'"(?:[^"\\]|\\(?s:.))*+(?:"|\Z)|' + _CHAR,
    "csharp": r'\$*"""(?:[^"]|"(?!""))*+(?:"""|\Z)|(?:@\$?|\$@)"(?:[^"]|"")*+(?:"|\Z)|\$?' + _DOUBLE + "|" + _CHAR,
}
STRINGS["javascript"] = STRINGS["typescript"]
COMMENTS = dict.fromkeys(LANGUAGES, f"{_LINE}|{_BLOCK}") | {
    "python": r"\#[^\n]*+",
    "rust": _LINE + r"|(?P<nest>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&nest))*+(?:\*/|\Z))",
}
#: A regular expression literal stands where no operand can have ended.
_REGEX_LITERAL = r"(?<=[=(,:;!&|?{}\[\n+]\s*|\breturn\s*)/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"


def define(language: str) -> str:
    """The DEFINE part: str, com, paren, brack, brace, angle."""
    string, comment = STRINGS[language], COMMENTS[language]
    if language in ("typescript", "javascript"):
        string = f"{string}|{_REGEX_LITERAL}"
    plain = r"[^()\[\]{}\"'`/\#@$bruRUfFtTB]" if language != "python" else r"[^()\[\]{}\"'\#bruRUfFtTB]"
    inner = f"(?:{plain}|(?&str)|(?&com)|(?&paren)|(?&brack)|(?&brace)|\\w++|[^()\\[\\]{{}}])*+"
    return rf"""(?(DEFINE)
(?P<str>{string})(?P<com>{comment})
(?P<paren>\({inner}\))(?P<brack>\[{inner}\])(?P<brace>\{{{inner}\}})
(?P<angle><(?:[^<>(){{}};"'=\-]|=>?|->?|(?&angle)|(?&paren)|(?&brace)|(?&str)|')*+>)
)"""


def language_of(language: str | None, path: str | None) -> str | None:
    """The language as named, else as the path's ending tells; None if neither does."""
    named = (language or "").strip().lower()
    named = SPELLINGS.get(named, named)
    return named if named in LANGUAGES else ENDINGS.get((path or "").rsplit(".", 1)[-1].lower())


@cache
def spans_pattern(language: str) -> regex.Pattern:
    """Finds comments (group c) and strings (group s), and skips all else."""
    return regex.compile(define(language) + r"(?P<c>(?&com))|(?P<s>(?&str))|\w++|(?s:.)")


@cache
def _brackets_pattern(language: str) -> regex.Pattern:
    return regex.compile(define(language) + r"(?:(?&com)|(?&str)|[^()\[\]{}\"'`/\#@$bcruRUfFtTB]++|\w++|[^()\[\]{}])++|(?P<b>[()\[\]{}])")


def balanced(language: str, content: str) -> str:
    """content with the brackets that have no partner blanked, so that no pattern follows one to the end of the text."""
    closes = {")": "(", "]": "[", "}": "{"}
    stack: list[tuple[str, int]] = []
    open_of = dict.fromkeys("([{", 0)
    alone: list[int] = []
    for m in _brackets_pattern(language).finditer(content):
        b = m.group("b")
        if b is None:
            continue
        if b in open_of:
            stack.append((b, m.start()))
            open_of[b] += 1
        elif open_of[closes[b]]:
            while True:
                top, at = stack.pop()
                open_of[top] -= 1
                if top == closes[b]:
                    break
                alone.append(at)
        else:
            alone.append(m.start())
    alone += [at for _, at in stack]
    if not alone:
        return content
    out = list(content)
    for at in alone:
        out[at] = " "
    return "".join(out)
