"""Natural language inside source files: which languages, and what share of each file.

Comments, docstrings and string literals are taken out of the files, named by a 128-bit hash, and every distinct one is
classified once; the labels are then joined back to all its places to weigh the files. A task sends a text only with its
first place there, so copies cost 16 bytes and not their text.

A sentence counts with at least five words (Chinese, Japanese: eight characters). Its language follows from its script,
and for Latin script from function words and letters. Tokens with code signs are no words, and what is mostly such
tokens, or a query, is no sentence.

Defined cases: null and empty contents and files of no known language give no rows; repeated files count once; a text
that fits two languages alike goes to the one named first in LANGUAGES; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lexical import language_of, spans_pattern
from graphloom.operators.skew import HOT_ROWS, hot_keys, looked_up, spread
from graphloom.session import checkpoint

_rx = cache(regex.compile)
LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
LEAST_WORDS, LEAST_WIDE = 5, 8

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in is are was were be been and or not no with without for from by on at as that this these those it its if unless until while when whenever because before after during so than then there which who whose what into over under between each every all any some one two can could will would should may must has have had do does did but only also more most other such our their his her you we they them i he she where how up out about off again once per does n't don't isn't",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht kein keine mit ohne für von vom zum zur zu auf an am im in ist sind war waren wird werden wurde wurden hat haben als wenn falls weil bevor nachdem sobald damit dass ob auch nur noch schon aus bei beim bis durch über unter zwischen nach vor jede jeder jedes jeden alle allen dieser diese dieses diesen sich es er sie wir ihr man wie was wer wo sein seine ihre ihrer ihres",
    "fr": "le la les l' un une des de du d' et ou ne pas sans avec pour par sur sous dans en au aux est sont était être été a ont que qu' qui quoi dont où si afin lorsque lorsqu' quand puisque parce car avant après dès pendant depuis entre chaque tout toute toutes tous cette cet ce ces c' il elle ils elles on nous vous se s' son sa ses leur leurs même plus moins aussi mais donc ainsi n' j' y",
    "es": "el la los las un una unos unas de del y no ni con sin para por en al a es son era fue ser ha han que quien cuyo donde si cuando aunque porque antes después desde hasta mientras entre cada todo toda todos todas esta este estas estos esto ese esa eso se su sus lo le les nos más menos también pero ya muy como otra otro según sobre vez veces",
    "pt": "o a os as um uma uns umas de do da dos das e ou não nem com sem para por pelo pela pelos pelas em no na nos nas ao aos à às é são era foi ser tem têm que quem cujo onde se quando quanto embora porque antes depois desde até enquanto entre cada todo toda todos todas esta este estas estes isto esse essa isso seu sua seus suas lhe mais menos também mas já muito como outra outro segundo sobre mesmo vez vezes",
}
#: Letters that mark a language, with the weight of a function word or a half.
LETTERS = {"de": "äöüß", "fr": "èëîïùûœæ", "es": "ñ¿¡", "pt": "ãõ"}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WEIGHTS: dict[str, dict[str, float]] = {}
for _k, _v in _SETS.items():
    for _w in _v:
        _WEIGHTS.setdefault(_w, {})[_k] = 1.0
for _w, _by in _WEIGHTS.items():  # a word that several languages have says less
    for _k in _by:
        _by[_k] = 1.0 / len(_by)

#: Frequent function words of languages that are not told by name; a sentence that is nearer to one of them is of no language known here.
OTHER_WORDS = {
    "it": "il lo la gli le un uno una di del della dei delle degli dal dalla nel nella nei nelle sul sulla che chi cui non con per tra fra e è sono era ha hanno viene essere questo questa questi queste quello quella se quando come più meno anche ma ogni tutti tutte dopo prima senza solo sempre",
    "nl": "de het een en van in op te dat die dit deze met voor niet geen is zijn was wordt worden werd heeft hebben als wanneer omdat door naar over onder tussen elke elk alle alleen ook maar nog dan bij uit tot na om wie wat welke zonder worden kan moet",
    "sv": "och att det som en ett den är inte på för med av till från om när ska kan har hade var blir eller men så också alla varje innan efter utan",
    "da": "og at det som en et den er ikke på for med af til fra om når skal kan har havde var bliver eller men så også alle hver før efter uden",
    "pl": "i w na z do nie że się jest są był było oraz lub jeśli gdy kiedy dla od po przed przez który która które tego ten ta to jak tylko każdy wszystkie bez",
    "tr": "ve bir bu için ile de da olan olarak ne daha çok gibi ama veya her kadar sonra önce değil ise tüm",
    "ro": "și de la în cu nu este sunt a fost un o pe pentru din care că sau dacă când după fără toate fiecare",
    "cs": "a v na se je že z do s pro není jsou byl bylo nebo když který která které ten ta to jak pouze každý všechny bez po před",
}
OTHER_LETTERS = {"it": "ìò", "sv": "å", "da": "åøæ", "pl": "łąęśźż", "tr": "ığş", "ro": "țășâ", "cs": "ěřůčž"}
_OTHER: dict[str, dict[str, float]] = {}
for _k, _v in OTHER_WORDS.items():
    for _w in {*_v.split()}:
        _OTHER.setdefault(_w, {})[_k] = 1.0 / (1 + sum(_w in x for x in _SETS.values()))
#: Letters of Cyrillic that Russian doesn't have.
_NOT_RUSSIAN = regex.compile("[іїєґўјљњћђџѓќѕ]")

_WIDE = r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〆]"
_WIDE_CHAR = regex.compile(_WIDE)
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_TOKEN = regex.compile(r"\S+")
_PLAIN = regex.compile(r"^[\"'“”‘’«»„(\[¿¡—–-]*(\p{L}[\p{L}\p{M}]*(?:['’\-]\p{L}+)*['’]?)[\"'“”‘’«»)\].,:;!?…]*$")
_MARKER = regex.compile(r"^\W*(?:TODO|FIXME|NOTE|XXX|HACK|BUG|WARNING|NB)\b(?:\([^)]*\))?[:\-\s]*")
_END = regex.compile(r"(?<=[.!?…][\"'”’»)]*)\s+|(?<=[。！？])")
_QUERY = regex.compile(r"\b(?:SELECT\b.+\bFROM|INSERT\s+INTO|UPDATE\b.+\bSET|DELETE\s+FROM|CREATE\s+(?:TABLE|VIEW|INDEX)|DROP\s+TABLE|ALTER\s+TABLE|MERGE\s+INTO)\b|^\s*(?:select\b.+\bfrom\b.+\bwhere|insert\s+into)\b", regex.S)
_CODE_LINE = regex.compile(r"^\s*(?:(?:return|import|from|using|package|const|let|var|def|class|function|fn|func|pub|if|for|while|public|private|static)\b.*[;{(=:})]\s*$|[\w.$]+\s*(?:[-+*/:]?=|\(.*\)\s*;?$).*|.*[;{}]\s*$)")
_ESCAPE = regex.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u+([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([0-7]{1,3})|(\r?\n[ \t]*)|(.))", regex.S)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " ", "v": " ", "a": " ", "e": " ", "0": " ", "s": " "}
_OPENING = regex.compile(r"""^(?P<p>[A-Za-z]{0,3}\#*|[@$]+)(?P<q>\"\"\"+|'''|["'`])""")


def _unescaped(m: regex.Match) -> str:
    braced, four, eight, two, octal, joined, plain = m.groups()
    for digits in (braced, four, eight, two):
        if digits:
            code = int(digits, 16)
            return chr(code) if code < 0x110000 else "�"
    if octal:
        return _PLAIN_ESCAPES.get(octal) or chr(int(octal, 8))
    return "" if joined else _PLAIN_ESCAPES.get(plain, plain)


def literal_text(language: str, raw: str) -> str:
    """A string literal's text with escapes resolved; a raw one's as it stands."""
    m = _OPENING.match(raw)
    if not m:
        return raw
    prefix, quote = m.group("p"), m.group("q")
    close = quote + "#" * prefix.count("#")
    text = raw[m.end() :]
    if text.endswith(close):
        text = text[: -len(close)]
    verbatim = "r" in prefix.lower() or "@" in prefix or (quote == "`" and language == "go") or (language == "csharp" and len(quote) > 2)
    if not verbatim and "\\" in text:
        text = _ESCAPE.sub(_unescaped, text)
        if not text.isascii():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def comment_text(raw: str) -> str:
    """A comment's text without its marks."""
    if raw.startswith("/*"):
        return "\n".join(_rx(r"^\s*\*+\s?").sub("", x) for x in _rx(r"^/\*+!?|\*+/$").sub("", raw).split("\n"))
    return _rx(r"^(?:\#+!?|/{2,}!?)\s?").sub("", raw)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def spans(language: str, content: str) -> Iterator[tuple[str, int]]:
    """The texts of all comments and string literals and the bytes they take in the file; line comments that follow each other line by line are one."""
    run: list[str] = []
    end, size = -1, 0
    for m in spans_pattern(language).finditer(content):
        comment = m.group("c")
        if comment is not None and not comment.startswith("/*"):
            if run and content[end : m.start()].strip(" \t\r") != "\n":
                yield "\n".join(run), size
                run, size = [], 0
            run.append(comment_text(comment))
            end, size = m.end(), size + _size(comment)
        elif comment is not None:
            yield comment_text(comment), _size(comment)
        elif m.group("s") is not None:
            yield literal_text(language, m.group("s")), _size(m.group("s"))
    if run:
        yield "\n".join(run), size


def latin_language(words: list[str]) -> str | None:
    """The language of words in Latin script, or None if they say too little."""
    score = dict.fromkeys(_SETS, 0.0)
    for w in words:
        pieces = [w] if "'" not in w else [w, w.split("'", 1)[0] + "'", w.split("'", 1)[1]]
        for p in pieces:
            for k, x in _WEIGHTS.get(p, {}).items():
                score[k] += x
        if not w.isascii():  # none of the letters is
            for k, letters in LETTERS.items():
                if any(c in letters for c in w):
                    score[k] += 0.5
        if w.endswith(("ção", "ções")):
            score["pt"] += 0.5
        elif w.endswith(("ción", "ciones")):
            score["es"] += 0.5
    best = max(score, key=score.get)
    if score[best] < max(0.75, 0.1 * len(words)):
        return None
    other = dict.fromkeys(OTHER_WORDS, 0.0)
    for w in words:
        for k, x in _OTHER.get(w, {}).items():
            other[k] += x
        if not w.isascii():
            for k, letters in OTHER_LETTERS.items():
                if any(c in letters for c in w):
                    other[k] += 0.5
    return best if score[best] >= max(other.values()) else None


def sentence_language(sentence: str) -> str | None:
    """The language of one sentence, or None if it is none, too short or of no language known here."""
    wide = len(_WIDE_CHAR.findall(sentence))
    tokens = _TOKEN.findall(sentence)
    if wide >= LEAST_WIDE and wide >= 0.3 * sum(len(t) for t in tokens):
        return "ja" if len(_KANA.findall(sentence)) >= max(2, 0.05 * wide) else "zh"
    if len(tokens) < LEAST_WORDS or _QUERY.search(sentence):
        return None
    words = [m.group(1).lower().replace("’", "'") for m in map(_PLAIN.match, tokens) if m]
    if len(words) < LEAST_WORDS or len(words) < 0.6 * len(tokens):
        return None
    cyrillic = sum(1 for w in words if "Ѐ" <= w[0] <= "ӿ")
    if cyrillic and sum(1 for w in words if _NOT_RUSSIAN.search(w)) * 20 > cyrillic:
        return None
    if cyrillic:
        return "ru" if cyrillic >= LEAST_WORDS and cyrillic >= 0.5 * len(words) else None
    return latin_language(words)


def sentences(text: str) -> Iterator[str]:
    """The sentences of a span: lines are joined to paragraphs where a sentence runs on, then cut at its ends."""
    paragraph: list[str] = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or not any(c.isalpha() for c in bare) or _CODE_LINE.match(bare):
            starts, bare = True, ""
        else:
            marked = _MARKER.sub("", bare)
            starts = marked != bare or bare[0] in "@:#*-+•<|>" or bool(_rx(r"\d+[.)]\s").match(bare)) or (
                bool(paragraph) and paragraph[-1].endswith((".", "!", "?", "。", "！", "？", ":"))
            )
            bare = _rx(r"</?[A-Za-z][^<>]*>").sub(" ", _rx(r"^(?:[@:]\w+:?\s+(?:\w+\s*:)?|[*\-+•>#]+\s+|\d+[.)]\s+)").sub("", marked)).strip()
        if starts and paragraph:
            yield from _END.split(" ".join(paragraph))
            paragraph = []
        if bare:
            paragraph.append(bare)
    if paragraph:
        yield from _END.split(" ".join(paragraph))


def span_languages(text: str) -> dict[str, int]:
    """UTF-8 bytes of sentences by language."""
    found: dict[str, int] = {}
    for s in sentences(text):
        language = sentence_language(s)
        if language:
            found[language] = found.get(language, 0) + len(s.encode("utf-8", "surrogatepass"))
    return found


_PLACES = pa.schema([("file_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("raw_bytes", pa.int64()), ("file_bytes", pa.int64()), ("text", pa.string())])
_PLACES_DDL = "file_id bigint, h1 bigint, h2 bigint, raw_bytes bigint, file_bytes bigint, text string"
_MOST_SEEN = 200_000  # hashes of sent texts that a task remembers; a forgotten text is sent again


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _halves(text: bytes) -> tuple[int, int]:
    h = xxhash.xxh128_intdigest(text)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    rows: list[tuple] = []
    for part in batches:
        for file_id, path, named, content in zip(*(part.column(i) for i in range(4)), strict=True):
            language = language_of(named.as_py(), path.as_py())
            if language is None:
                continue
            text = content.as_py()
            size = len(text.encode("utf-8", "surrogatepass"))
            own: dict[tuple[int, int], list] = {}
            for span, taken in spans(language, text):
                if not any(c.isalpha() for c in span):
                    continue
                data = span.encode("utf-8", "replace")
                own.setdefault(_halves(data), [0, data])[0] += taken
            for key, (taken, data) in own.items():
                first = key not in seen
                if first:
                    if len(seen) >= _MOST_SEEN:
                        seen.clear()
                    seen.add(key)
                rows.append((file_id.as_py(), *key, taken, size, data.decode() if first else None))
            if len(rows) >= 2000:
                yield _columns(rows, _PLACES)
                rows = []
    if rows:
        yield _columns(rows, _PLACES)


_LABELS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("nl_lang", pa.string()), ("part", pa.float64())])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        rows = [
            (h1, h2, language, n / max(1, _size(text)))
            for h1, h2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
            for language, n in span_languages(text).items()
        ]
        if rows:
            yield _columns(rows, _LABELS)


def file_languages(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """file_id, nl_lang, n_bytes and share (of the file's bytes) of every natural language in every file.

    A comment or literal takes part with the bytes it has in the file, marks and escapes included, by what share of its text
    the sentences of a language are; so a file's shares add up to one at most.
    """
    given = spread(files.select("file_id", "path", "language", "content").where("content is not null and content <> ''"))
    places = checkpoint(given.mapInArrow(_places, _PLACES_DDL))
    texts = places.where(F.col("text").isNotNull()).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    labels = texts.select("h1", "h2", "text").mapInArrow(_labels, "h1 bigint, h2 bigint, nl_lang string, part double")
    # A repeated file repeats its places. The labels of a copied text that many files hold come to its places.
    where = places.drop("text").distinct()
    hot = hot_keys(where, ["h1", "h2"], hot_rows)
    if hot is not None:
        labels = checkpoint(labels)
    named = labels.groupBy("h1", "h2").agg(F.collect_list(F.struct("nl_lang", "part")).alias("found"))  # a text has eight languages at most
    labelled = looked_up(where, named, ["h1", "h2"], hot).select("file_id", "raw_bytes", "file_bytes", F.inline("found"))
    weighed = labelled.groupBy("file_id", "nl_lang").agg(F.round(F.sum(F.col("part") * F.col("raw_bytes")), 3).alias("n_bytes"), F.max("file_bytes").alias("size"))
    return weighed.select("file_id", "nl_lang", "n_bytes", (F.col("n_bytes") / F.col("size")).alias("share"))

