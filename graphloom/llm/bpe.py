"""Encoding with a public byte-level BPE tokenizer, as a finite-state transducer.

The transducer reads the bytes of one piece of the pre-tokenizer at a time. Of a BPE encoding holds: it is the only
sequence of tokens in which each token encodes to itself and each neighbouring pair encodes to that pair. So the encoding
of every prefix is that of a shorter prefix and one more token, and what can still change is told by the threads that are
open: places from which some token could still begin, each with the tokens since the last emission. A state is that set
of threads; what all of them share is emitted at once, so the lookahead is bounded by the longest token. States and
transitions are made when they are first needed, and kept.

Decoding is streamed: bytes of tokens go through a UTF-8 state machine that holds back what is incomplete.

Defined cases: null and empty texts have no tokens; special tokens' strings are ordinary text; a text is never cut;
bytes that are no UTF-8 decode to U+FFFD, one for each broken sequence.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.skew import spread

#: The split of byte-level BPE, a fixed value of the tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MOST_STATES = 100_000
_MOST_PIECES = 200_000
_LONGEST_KEPT = 64
#: No vocabulary that is broadcast is larger than this.
MOST_BYTES = 64 * 2**20


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a public tokenizer's file is: in folder, else GRAPHLOOM_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("GRAPHLOOM_TOKENIZERS") or "/opt/tokenizers", name)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The tokens as bytes, and the merges by rank, of a tokenizers file."""

    def __init__(self, text: str) -> None:
        model = json.loads(text)["model"]
        letters = _byte_letters()
        self.ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if all(c in letters for c in token):
                self.ids[bytes(letters[c] for c in token)] = i
        special = {x["id"] for x in json.loads(text).get("added_tokens", [])}
        self.ids = {t: i for t, i in self.ids.items() if i not in special}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (self.ids[bytes(letters[c] for c in x)] for x in (a, b))
            self.merges[left, right] = (rank, self.ids[bytes(letters[c] for c in a + b)])
        self.single = [self.ids[bytes([b])] for b in range(256)]

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merging, for the short byte strings that transitions are made from."""
        parts = [self.single[b] for b in data]
        while len(parts) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            new, out, i = self.merges[pair][1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class Transducer:
    """Bytes of a piece in, token ids out; its states are made lazily."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.next: list[dict[int, int]] = [{}]  # of each node of the token tree
        self.token: list[int] = [-1]
        for data, i in vocabulary.ids.items():
            node = 0
            for b in data:
                following = self.next[node].get(b)
                if following is None:
                    following = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = following
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        self.names = {(-1, ((0, ()),)): 0}
        self.states = [(-1, ((0, ()),))]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _fit(self, before: int, token: int) -> bool:
        """Whether token can follow before (-1: nothing) in an encoding."""
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > 4 * _MOST_STATES:
                self.fits.clear()
            both = self.vocabulary.bytes
            data, want = (both[token], [token]) if before < 0 else (both[before] + both[token], [before, token])
            known = self.fits[before, token] = self.vocabulary.merged(data) == want
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of a state at a byte: the next state and what is emitted."""
        before, threads = self.states[state]
        moved = [(n, chain) for node, chain in threads if (n := self.next[node].get(byte)) is not None]
        done = None
        for node, chain in moved:
            token = self.token[node]
            if token >= 0 and self._fit(chain[-1] if chain else before, token):
                done = (*chain, token)
                break
        alive = [(n, chain) for n, chain in moved if self.next[n]]
        alive.append((0, done))
        shared = done
        for _, chain in alive:
            k = 0
            while k < min(len(shared), len(chain)) and shared[k] == chain[k]:
                k += 1
            shared = shared[:k]
        cut = len(shared)
        alive = tuple((n, chain[cut:]) for n, chain in alive)
        last = shared[-1] if cut else before
        if all(chain for _, chain in alive):
            last = -1
        key = (last, alive)
        number = self.names.get(key)
        if number is None:
            number = self.names[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        out = self.steps[state][byte] = (number, shared)
        return out

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        if len(self.states) > _MOST_STATES:
            self._clear()
        state, out, steps = 0, [], self.steps
        for b in data:
            step = steps[state].get(b) or self._step(state, b)
            state = step[0]
            if step[1]:
                out += step[1]
        if data:
            out += self.states[state][1][-1][1]
        return out

    def encode(self, text: str | None, split: regex.Pattern = regex.compile(PIECES)) -> list[int]:
        """The tokens of a text."""
        out: list[int] = []
        kept = self.pieces
        for piece in split.findall(text or ""):
            ids = kept.get(piece)
            if ids is None:
                ids = tuple(self.piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= _LONGEST_KEPT:
                    if len(kept) >= _MOST_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


class Utf8Stream:
    """Turns bytes that come in parts into text, holding back what is incomplete."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def _begin(self, b: int) -> str:
        if b < 0x80:
            return chr(b)
        self.low, self.high = 0x80, 0xBF
        if 0xC2 <= b <= 0xDF:
            self.need = 1
        elif 0xE0 <= b <= 0xEF:
            self.need = 2
            self.low, self.high = (0xA0, 0xBF) if b == 0xE0 else (0x80, 0x9F) if b == 0xED else (0x80, 0xBF)
        elif 0xF0 <= b <= 0xF4:
            self.need = 3
            self.low, self.high = (0x90, 0xBF) if b == 0xF0 else (0x80, 0x8F) if b == 0xF4 else (0x80, 0xBF)
        else:
            return "�"
        self.held.append(b)
        return ""

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if not self.need:
                out.append(self._begin(b))
            elif self.low <= b <= self.high:
                self.held.append(b)
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                    self.held.clear()
            else:
                self.held.clear()
                self.need = 0
                out += ["�", self._begin(b)]
        return "".join(out)

    def end(self) -> str:
        left = "�" if self.need else ""
        self.held.clear()
        self.need = 0
        return left


def decode_stream(vocabulary: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """The text of ids, token by token."""
    stream = Utf8Stream()
    for i in ids:
        text = stream.feed(vocabulary.bytes[i])
        if text:
            yield text
    left = stream.end()
    if left:
        yield left


_MADE: dict[bytes, Transducer] = {}  # one for each worker and vocabulary


def _transducer(text: str) -> Transducer:
    key = hashlib.sha256(text.encode()).digest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Transducer(Vocabulary(text))
    return _MADE[key]


def _shared(spark: SparkSession, path: str):
    """The tokenizer's file, sent to the executors once; its size is that of a vocabulary, about 1.5 MB, and checked."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes and is no vocabulary to broadcast")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """id_column and ids (array of int): the tokens of every row's text, whole."""
    vocabulary = _shared(df.sparkSession, path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _transducer(vocabulary.value).encode
        for part in batches:
            begin = 0
            while begin < part.num_rows:  # a part of about a million tokens at a time
                offsets, values, at = [0], [], begin
                while at < part.num_rows and len(values) < 1_000_000:
                    values += encode(part.column(1)[at].as_py())
                    offsets.append(len(values))
                    at += 1
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(begin, at - begin), ids], names=[id_column, "ids"])
                begin = at

    kind = dict(df.dtypes)[id_column]
    return spread(df.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """id_column and n_tokens of every row."""
    vocabulary = _shared(df.sparkSession, path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _transducer(vocabulary.value).encode
        for part in batches:
            counts = [len(encode(t.as_py())) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=[id_column, "n_tokens"])

    kind = dict(df.dtypes)[id_column]
    return spread(df.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")


def decoded(df: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """id_column and text of every row's ids."""
    vocabulary = _shared(df.sparkSession, path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _transducer(vocabulary.value).vocabulary
        for part in batches:
            texts = ["".join(decode_stream(known, ids.as_py() or [])) for ids in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")
