"""Byte-pair encoding and decoding of whole texts.

A token sequence is what the merges give exactly when every two neighbours are, so
the encoder takes the longest token at each place (one Aho-Corasick pass) and steps
back to a shorter one where a table of compatible pairs forbids it.  A place that
was left without success is never tried again, so the work is linear in the text.

The vocabulary is a file of fixed size, read on the driver and broadcast.  It must
be a byte-level BPE of the ``tokenizers`` kind in which each token is made by at
most one merge.

Defined results: null encodes to no tokens and decodes to the empty text; an empty
text has no tokens; ids that the vocabulary lacks decode to nothing; bytes that are
not UTF-8 decode to U+FFFD.  Rows are never joined or reordered, so ties, repeated
rows and empty tables need no rule.  A given column named like an added one is
replaced.
"""

from __future__ import annotations

import copy
import functools
import json
import pickle
from array import array
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm.common import binaries, extend, numbers

# Fixed value: the published pattern that splits a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_ENTRIES = 50_000
MEMO_LENGTH = 64
PAIR_ENTRIES = 500_000

ENDINGS = frozenset(",.;:!?")
"""Marks that are a piece of their own after letters, at the end of a run."""

JOINED_IDS = 1 << 16
"""Ids decoded at once; a byte of text takes some 30 bytes meanwhile."""


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens as Latin-1 strings of their bytes, merges by rank, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        spelled = {t: i for t, i in held["model"]["vocab"].items() if t not in self.special}
        size = 1 + max([*spelled.values(), *self.special.values()])
        self.tokens: list[str | None] = [None] * size
        for t, i in spelled.items():
            self.tokens[i] = "".join(chr(letters[c]) for c in t)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in held["model"]["merges"]]
        self.merges = {(spelled[a], spelled[b]): (rank, spelled[a + b]) for rank, (a, b) in enumerate(pairs)}
        by_bytes = {t: i for i, t in enumerate(self.tokens) if t is not None}
        self.bytes_id = [by_bytes[chr(b)] for b in range(256)]
        #: tokens that no merging ends in, not even of their own bytes
        self.never = {i for t, i in by_bytes.items() if self.merged(t) != [i]}

    def merged(self, text: str) -> list[int]:
        """The merges done one by one, lowest rank first; only for the few letters of a pair."""
        merges = self.merges
        out = [self.bytes_id[ord(c)] for c in text]
        while len(out) > 1:
            found = [(merges[p], k) for k, p in enumerate(zip(out, out[1:])) if p in merges]
            if not found:
                break
            (_, made), k = min(found)
            out[k : k + 2] = [made]
        return out


def _one_piece(word: str) -> bool:
    """Whether letters alone are certain to be one piece, with a blank before them or without."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0180")


class Memo(dict):
    """Packed ids by text.  When it is full, entries not asked for since it was full before go."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def keep(self, key: str, made: bytes) -> None:
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = made


class Encoder:
    """Exact encoder over one vocabulary; holds bounded memos, so one serves a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        #: places of tokens by when they are made, bytes first, and the places of the two tokens each is made of
        self.place = [-1] * len(self.tokens)
        self.left, self.right = list(range(256)), list(range(256))
        for b, i in enumerate(vocabulary.bytes_id):
            self.place[i] = b
        #: only where a merge takes tokens that are made later, or a token is made twice: places say nothing then
        self.merged: Callable[[str], list[int]] | None = None
        #: the place of what two tokens, given by place, merge to
        self.crossing: dict[int, int] = {}
        for (a, b), (_, made) in sorted(vocabulary.merges.items(), key=lambda m: m[1][0]):
            if min(self.place[a], self.place[b]) < 0 or self.place[made] >= 0:
                self.merged = vocabulary.merged
                break
            self.place[made] = len(self.left)
            self.crossing[self.place[a] << 20 | self.place[b]] = len(self.left)
            self.left.append(self.place[a])
            self.right.append(self.place[b])
        self.lengths = [len(t or "") for t in self.tokens]
        self.special = vocabulary.special
        by_bytes = {t: i for i, t in enumerate(self.tokens) if t is not None}
        self.shorter = [-1] * len(self.tokens)
        self.automaton = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.automaton.add_word(t, i)
            self.shorter[i] = next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1)
        self.automaton.make_automaton()
        self.pairs: dict[int, int] = {}
        self.never = vocabulary.never
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd = regex.compile(r"\s ")
        self.inner, self.first = Memo(), Memo()

    def for_task(self) -> Encoder:
        """The same tables with memos of their own, for who keeps tables between tasks."""
        own = copy.copy(self)
        own.inner, own.first = Memo(), Memo()
        return own

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, are what their bytes encode to."""
        if self.merged is not None:
            return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return a not in self.never and b not in self.never and self.apart(self.place[a], self.place[b])

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge joins anything across the border of two tokens, given by place.

        Their merges are undone, latest first; a merge across the border counts if it comes
        before the merge that made what it would take away (to the left also at the same rank).
        """
        crossing, left, right, until = self.crossing.get, self.left, self.right, len(self.left)
        while crossing(a << 20 | b, until) >= until:
            if a > b:
                until, a = a, right[a]
                if a == until:
                    return True
            else:
                until, b = b + 1, left[b]
                if b + 1 == until:
                    return True
        return False

    def step(self, last: int, t: int) -> int:
        """The longest token that begins ``t`` (itself counts) and fits after ``last`` (-1: nothing stands before), or -1."""
        known = self.pairs.get(last << 20 | t)
        if known is None:
            known = t
            while known >= 0 and not (self.fits(last, known) if last >= 0 else known not in self.never):
                known = self.shorter[known]
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            self.pairs[last << 20 | t] = known
        return known

    def piece(self, text: str) -> list[int]:
        """Tokens of one piece, given as Latin-1 of its bytes.

        Longest matches are taken while they fit; else a shorter token is tried, and
        with none left the token before it gives way.
        """
        at, last, out, dead = 0, -1, [], set()
        matches, lengths, shorter, pairs, step = self.automaton.iter_long, self.lengths, self.shorter, self.pairs.get, self.step
        while True:
            for end, t in matches(text, at):
                u = pairs(last << 20 | t)
                if u is None:
                    u = step(last, t)
                if u != t or end + 1 in dead:
                    break
                out.append(t)
                last, at = t, end + 1
            else:
                return out
            while True:
                if u < 0:
                    dead.add(at)
                    u = out.pop()
                    at -= lengths[u]
                    last = out[-1] if out else -1
                elif at + lengths[u] not in dead:
                    out.append(u)
                    at += lengths[u]
                    last = u
                    break
                u = shorter[u]
                if u >= 0:
                    u = step(last, u)

    def chunk(self, text: str) -> bytes:
        """Packed ids of a run of text that no piece crosses the ends of."""
        blank, word = (" ", text[1:]) if text[0] == " " else ("", text)
        if _one_piece(word):
            return self.packed_piece(text)
        if word[-1:] in ENDINGS and _one_piece(word[:-1]):
            return self.remembered(word[:-1], blank, self.packed_piece) + self.remembered(word[-1], "", self.packed_piece)
        special = self.cut is not None and any(s in text for s in self.special)
        out = []
        for part in self.cut.split(text) if special else (text,):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            for p in self.pieces.findall(part):
                key, blank = (p[1:], " ") if p[0] == " " else (p, "")
                out.append(self.remembered(key, blank, self.packed_piece))
        return b"".join(out)

    def packed_piece(self, text: str) -> bytes:
        return array("i", self.piece(text if text.isascii() else text.encode().decode("latin-1"))).tobytes()

    def remembered(self, key: str, blank: str, make: Callable[[str], bytes]) -> bytes:
        """Packed ids of a text given without the blank it may begin with."""
        memo = self.inner if blank else self.first
        made = memo.get(key)
        if made is None:
            made = memo.older.get(key)
            if made is None:
                made = make(blank + key)
            if len(key) <= MEMO_LENGTH:
                memo.keep(key, made)
        return made

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as packed 32-bit integers.

        A piece never has white space after other characters, so a text may be cut
        before any blank that follows a character other than white space.
        """
        if self.odd.search(text):
            get = self.first.get
            return b"".join([get(p) or self.remembered(p, "", self.chunk) for p in self.split_odd(text)])
        parts = text.split(" ")
        get, remembered, chunk = self.inner.get, self.remembered, self.chunk
        out = [get(p) or remembered(p, " ", chunk) for p in parts[1:]]
        if parts[0]:
            out.insert(0, remembered(parts[0], "", chunk))
        return b"".join(out)

    @staticmethod
    def split_odd(text: str) -> list[str]:
        """Cut before each blank that follows other than white space; joined again they give the text."""
        out, held = [], ""
        for k, p in enumerate(text.split(" ")):
            if not k:
                held = p
            elif held and not held[-1].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        out.append(held)
        return [p for p in out if p]


class Decoder:
    """All tokens' bytes in one row, with the offset of each."""

    def __init__(self, vocabulary: Vocabulary):
        spelled = [b"" if t is None else t.encode("latin-1") for t in vocabulary.tokens]
        for text, i in vocabulary.special.items():
            spelled[i] = text.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)

    def join(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each document of ``rows`` (id offsets) begins in them."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        safe = np.where(known, ids, 0)
        lengths = np.where(known, self.offsets[safe + 1] - self.offsets[safe], 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        joined = np.empty(ends[-1], np.uint8)
        for k in range(0, len(ids), JOINED_IDS):
            some = slice(k, k + JOINED_IDS)
            first, last = ends[k], ends[min(k + JOINED_IDS, len(ids))]
            take = np.repeat(self.offsets[safe[some]] - ends[:-1][some], lengths[some]) + np.arange(first, last)
            joined[first:last] = self.bytes[take]
        return joined, ends[rows]


def _tables(shared, *kinds: type) -> list[Encoder | Decoder]:
    """Tables for one task, which go with it: idle workers wait beside busy ones, and building them takes a tenth of a second."""
    vocabulary = pickle.loads(shared.value)
    return [kind(vocabulary) for kind in kinds]


@functools.lru_cache(maxsize=1)
def packed_vocabulary(path: str) -> bytes:
    """Pickled, 1.3 MB: a worker keeps what is broadcast, and the vocabulary itself is many times as large."""
    return pickle.dumps(Vocabulary(path))


def broadcast_vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(packed_vocabulary(path))


def _texts(column: pa.Array) -> Iterable[str]:
    try:
        return ["" if x is None else x for x in column.to_pylist()]
    except UnicodeDecodeError:
        return ["" if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _encoded(encoder: Encoder, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each document begins in them."""
    made = [encoder.packed(x) for x in _texts(column)]
    rows = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int64)
    return np.frombuffer(b"".join(made), np.int32), rows


def _lists(ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(numbers(rows, np.int32), numbers(ids, np.int32))


def _decoded(decoder: Decoder, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    joined, places = decoder.join(ids, rows)
    held = pa.StringArray.from_buffers(
        len(rows) - 1, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(joined.tobytes())
    )
    try:
        held.validate(full=True)
    except pa.ArrowInvalid:
        texts = [joined[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(places, places[1:])]
        return binaries([x.encode() for x in texts], pa.string())
    return held


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the token ids of each whole text as ``array<int>``."""
    shared = broadcast_vocabulary(df, path)

    def begin():
        [encoder] = _tables(shared, Encoder)
        return lambda column: [_lists(*_encoded(encoder, column))]

    return extend(df, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), begin, [text])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append the token ids and the text decoded from them, in one worker per task instead of two."""
    shared = broadcast_vocabulary(df, path)

    def begin():
        encoder, decoder = _tables(shared, Encoder, Decoder)

        def work(column):
            made, rows = _encoded(encoder, column)
            return [_lists(made, rows), _decoded(decoder, made, rows)]

        return work

    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return extend(df, T.StructType(added), begin, [text])


def count_tokens(df: DataFrame, path: str, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """Append the number of tokens of each whole text; the ids stay in the worker."""
    shared = broadcast_vocabulary(df, path)

    def begin():
        [encoder] = _tables(shared, Encoder)
        return lambda column: [numbers([len(encoder.packed(x)) // 4 for x in _texts(column)])]

    return extend(df, T.StructType([T.StructField(tokens, T.LongType())]), begin, [text])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text that each list of ids stands for."""
    shared = broadcast_vocabulary(df, path)

    def begin():
        [decoder] = _tables(shared, Decoder)

        def work(column):
            lists = column.fill_null([]) if column.null_count else column
            flat = lists.flatten().cast(pa.int64())
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            return [_decoded(decoder, flat.fill_null(-1).to_numpy(zero_copy_only=False), rows)]

        return work

    return extend(df, T.StructType([T.StructField(text, T.StringType())]), begin, [ids])
