"""Column functions on labels, descriptions and other short texts."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Technical terms that descriptions for readers avoid.
PROHIBITED_TERMS = [
    "Service", "Handler", "Controller", "Loader", "IoC", "Middleware", "Decorator", "Class", "Module", "Import", "Endpoint", "Router", "Provider",
    "Factory", "Repository", "DAO", "ORM", "SDK", "API",
]
#: Ranges of characters that count as a token each.
WIDE = r"[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿＀-￯]"
#: Characters that Mermaid labels can't hold, and what stands for them.
LABEL_ESCAPES = [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"), ("|", "&#124;"), ("\n", " ")]
MISSING = "(missing)"


def token_estimate(text: Column) -> Column:
    """A token for each wide character and one for each four others, rounded up."""
    wide = F.regexp_count(text, F.lit(WIDE))
    return (wide + F.floor((F.char_length(text) - wide + 3) / 4)).cast("bigint")


def term_hits(text: Column, terms: list[str] | None = None) -> Column:
    """Every occurrence of a term as a whole word, in any case, as written."""
    pattern = "(?iU)\\b(" + "|".join(re.escape(t) for t in terms or PROHIBITED_TERMS) + ")\\b"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+"))).cast("bigint")


def slug(name: Column) -> Column:
    """Lower case; white space and underscores become hyphens, others than letters, digits and hyphens go, runs shrink."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\-]", ""), r"-+", "-"), r"^-|-$", "")


def label_escaped(label: Column) -> Column:
    for a, b in LABEL_ESCAPES:
        label = F.replace(label, F.lit(a), F.lit(b))
    return label


def or_missing(value: Column) -> Column:
    """The value, or a fixed text for null and blank ones."""
    return F.when(value.isNull() | (F.trim(value) == ""), MISSING).otherwise(value)


def provenance(born: Column, contract: str) -> Column:
    """current, legacy or unknown, by the contract a snapshot was born under."""
    return F.when(born.isNull(), "unknown").when(born == contract, "current").otherwise("legacy")


def marker_state(incomplete: Column, regenerated: Column, reviewed: Column, confidence: Column) -> Column:
    """The one state that a reader is shown: incomplete, regenerated, reviewed, or the confidence."""
    return F.when(incomplete, "incomplete").when(regenerated, "regenerated").when(reviewed, "reviewed").otherwise(F.coalesce(confidence, F.lit("incomplete")))


def reference_label(timestamp: Column, tags: Column, commit: Column, label: Column, version: Column) -> Column:
    """A version as readers know it: tag and short hash, short hash, label or id, after its date."""
    short = F.left(F.nullif(commit, F.lit("")), F.lit(7))
    tag = F.try_element_at(tags, F.lit(1))
    named = F.coalesce(F.concat(tag, F.lit(" "), short), tag, short, F.nullif(label, F.lit("")), version)
    return F.concat_ws(" ", F.left(timestamp, F.lit(10)), named)


def approximate_distance(a: Column, b: Column) -> Column:
    """Length of the longer text less the characters of the shorter that it holds."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longer = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b)
    shorter = F.when(F.char_length(a) >= F.char_length(b), b).otherwise(a)
    held = F.size(F.filter(F.split(shorter, ""), lambda c: (c != "") & F.contains(longer, c)))
    return (F.char_length(longer) - held).cast("bigint")


@F.pandas_udf(T.LongType())
def edit_magnitude(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longer length times one minus the matching ratio, as a whole number; null counts as empty."""

    def one(x: str | None, y: str | None) -> int:
        x, y = x or "", y or ""
        most = max(len(x), len(y))
        return int(most * (1 - difflib.SequenceMatcher(None, x, y).ratio())) if most and x != y else 0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


_WORDS = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]|\s+|[^\s぀-ヿ㐀-䶿一-鿿가-힣]+")


def word_changes(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """Runs of words that are equal, removed or added, by a longest common subsequence; wide characters are words."""
    a, b = _WORDS.findall(before or ""), _WORDS.findall(after or "")
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    runs: list[tuple[str, str]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            kind, word = "equal", a[i]
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            kind, word = "remove", a[i]
            i += 1
        else:
            kind, word = "add", b[j]
            j += 1
        if runs and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1] + word)
        else:
            runs.append((kind, word))
    return runs


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"type": k, "text": t} for k, t in word_changes(a, b)] for a, b in zip(before, after, strict=True)])


def body_hash(content: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """MD5 of the lines from start to end, with line ends made alike, or of the whole text; null if a given bound is unknown."""
    alike = F.regexp_replace(content, r"\r\n?", "\n")
    if start is None or end is None:
        return F.md5(alike)
    lines = F.split(alike, "\n")
    return F.md5(F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"))


def same_signature(a: str, b: str) -> Column:
    """Whether the nodes a and b (struct columns) have one signature: name, parameters, result, decorators, docstring."""
    fields = ["name", "parameters", "return_type", "decorators", "docstring"]
    return F.struct(*[F.col(f"{a}.{f}") for f in fields]).eqNullSafe(F.struct(*[F.col(f"{b}.{f}") for f in fields]))
