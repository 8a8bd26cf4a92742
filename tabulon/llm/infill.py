"""Fill-in-middle texts: a document cut in three at unit borders and put together in another order.

Every byte of a batch of texts falls in a class (inside a character, line break, blank,
start of a word, inside a word, sign).  A wavelet matrix over the classes, three bit vectors
deep, answers how often a class stands before a place (rank) and where its j-th member is
(select).  Sums of ranks count unit borders: lines end at line breaks, words begin at
starts of words, tokens at those and at signs, characters wherever no byte is inside one.
A border of one class is found by select, one of several classes by bisection on the ranks.

Prefix and middle end after the smaller and the larger of two numbers of units, drawn from
a digest of seed and id, so a document is cut alike wherever and whenever it is met.

Defined results: a null or empty text stays as it is (``plain``, a null one reads as empty),
as does one that holds a marker; any part may be empty.  A line ends with its line break;
a word or a token reaches to the start of the next, and what stands before the first belongs
to it.  A row without an id draws with an empty one; rows that share an id draw alike.  Given
columns stay; one named like an added column is replaced.  An empty table gives an empty
result.  A task holds a few bytes for each byte of one batch, or of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import extend, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

INSIDE, BREAK, BLANK, WORD, IN_WORD, SIGN = range(6)

#: unit -> classes whose members are borders, and whether a unit ends behind its border or begins there
UNITS = {
    "lines": ((BREAK,), True),
    "words": ((WORD,), False),
    "tokens": ((WORD, SIGN), False),
    "chars": ((BREAK, BLANK, WORD, IN_WORD, SIGN), False),
}

ADDED = T.StructType(
    [
        T.StructField("n_units", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("fim_text", T.StringType()),
    ]
)


def _first_classes() -> np.ndarray:
    """Class of each byte value, words not yet told apart by their starts."""
    out = np.full(256, SIGN, np.uint8)
    out[[9, 11, 12, 13, 32]] = BLANK
    out[10] = BREAK
    out[0x80:0xC0] = INSIDE
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF)):
        out[first : last + 1] = IN_WORD
    return out


_CLASSES = _first_classes()


def classes_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of texts that start at ``starts``."""
    out = _CLASSES[data]
    wordly = (out == IN_WORD) | (out == INSIDE)
    begins = out == IN_WORD
    begins[1:] &= ~wordly[:-1]
    here = starts[starts < len(data)]
    begins[here] = out[here] == IN_WORD
    out[begins] = WORD
    return out


class Bits:
    """A bit vector with rank and select, 64 bits to a word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)
        padded[: self.size] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = self.size - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def select(self, nth: np.ndarray, one: bool) -> np.ndarray:
        """Place of the n-th one or zero, counted from 0."""
        before = self.before if one else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(before, nth, side="right") - 1
        held = self.words[word] if one else ~self.words[word]
        bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.cumsum(bits, axis=1) > (nth - before[word])[:, None]
        return word * 64 + inside.argmax(axis=1)


class WaveletMatrix:
    """Rank and select of every class in a sequence of classes below 2 ** depth."""

    def __init__(self, classes: np.ndarray, depth: int = 3):
        self.size, self.levels = len(classes), []
        for shift in range(depth - 1, -1, -1):
            bit = (classes >> shift) & 1
            self.levels.append(Bits(bit))
            classes = np.concatenate([classes[bit == 0], classes[bit == 1]])

    def _bits(self, c: int) -> list[bool]:
        return [bool(c >> shift & 1) for shift in range(len(self.levels) - 1, -1, -1)]

    def rank(self, c: int, at: np.ndarray) -> np.ndarray:
        """Members of class ``c`` before each place."""
        both = np.append(at, 0)
        for level, bit in zip(self.levels, self._bits(c)):
            ones = level.rank(both)
            both = level.zeros + ones if bit else both - ones
        return both[:-1] - both[-1]

    def select(self, c: int, nth: np.ndarray) -> np.ndarray:
        """Place of the n-th member of class ``c``, counted from 0; there has to be one."""
        first = np.zeros(1, np.int64)
        for level, bit in zip(self.levels, self._bits(c)):
            ones = level.rank(first)
            first = level.zeros + ones if bit else first - ones
        at = nth + first[0]
        for level, bit in zip(reversed(self.levels), reversed(self._bits(c))):
            at = level.select(at - level.zeros if bit else at, bit)
        return at


class Borders:
    """Unit borders of texts that lie one behind the other."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str):
        self.kinds, self.behind = UNITS[unit]
        self.matrix = WaveletMatrix(classes_of(data, starts))
        self.starts, self.ends, self.data = starts, ends, data
        self.first = self.before(starts)
        self.marks = self.before(ends) - self.first
        if self.behind:  # what follows the last border is a unit too
            self.units = self.marks + self._tail()
        else:  # what stands before the first border is a part of it
            self.units = np.maximum(self.marks, ends > starts)

    def _tail(self) -> np.ndarray:
        some = self.ends > self.starts
        final = np.where(some, self.ends - 1, 0)
        return (some & (self.before(np.where(some, self.ends, 0)) == self.before(final))).astype(np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Borders before each place."""
        return sum(self.matrix.rank(c, at) for c in self.kinds)

    def characters(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters between places."""
        return (b - self.matrix.rank(INSIDE, b)) - (a - self.matrix.rank(INSIDE, a))

    def after(self, units: np.ndarray) -> np.ndarray:
        """Place behind the first ``units`` units of each text."""
        nth = units - 1 if self.behind else units
        inner = (units > 0) & (nth < self.marks)
        out = np.where(units > 0, self.ends, self.starts)
        if inner.any():
            found = self._find((nth + self.first)[inner], self.starts[inner], self.ends[inner])
            out[inner] = found + self.behind
        return out

    def _find(self, nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the n-th border of all texts, which lies in ``low .. high - 1``."""
        if len(self.kinds) == 1:
            return self.matrix.select(self.kinds[0], nth)
        while (low < high - 1).any():  # before(low) <= nth < before(high)
            middle = (low + high) // 2
            left = self.before(middle) > nth
            low, high = np.where(left, low, middle), np.where(left, middle, high)
        return low


def draws(seed: int, id: object) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))  # type: ignore[return-value]


def fill_in_middle(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "lines",
    seed: int = 7,
    percent: int = 100,
    suffix_first: int = 50,
    markers: Sequence[str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Append ``n_units, form, prefix_chars, middle_chars, fim_text``.

    ``percent`` of the documents are cut; of these ``suffix_first`` per cent get the form
    ``spm`` (suffix, prefix, middle), the others ``psm`` (prefix, suffix, middle).
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    p, s, m = (x.encode() for x in markers)

    def begin():
        def work(ids, column):
            texts = texts_of(column)
            drawn = np.array([draws(seed, i) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
            ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
            starts = ends - np.array([len(x) for x in texts], np.int64)
            borders = Borders(np.frombuffer(b"".join(texts), np.uint8), starts, ends, unit)
            cuts = np.sort(drawn[:, :2] % (borders.units + 1)[:, None], axis=1)
            one, two = borders.after(cuts[:, 0]), borders.after(cuts[:, 1])
            left, middle = borders.characters(starts, one), borders.characters(one, two)
            forms, out = [], []
            for k, x in enumerate(texts):
                if not x or p in x or s in x or m in x or drawn[k, 2] % 100 >= percent:
                    forms.append("plain")
                    out.append(x)
                    continue
                a, b = int(one[k] - starts[k]), int(two[k] - starts[k])
                forms.append("spm" if drawn[k, 3] % 100 < suffix_first else "psm")
                order = (s, x[b:], p, x[:a]) if forms[-1] == "spm" else (p, x[:a], s, x[b:])
                out.append(b"".join((*order, m, x[a:b])))
            plain = np.array([f == "plain" for f in forms], bool)
            as_text = pc.CastOptions(pa.string(), allow_invalid_utf8=True)
            return [
                pa.array(borders.units, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(left, pa.int64(), mask=plain),
                pa.array(middle, pa.int64(), mask=plain),
                pc.cast(pa.array(out, pa.binary()), options=as_text),
            ]

        return work

    return extend(df, ADDED, begin, [id, text])


def restored(made: Column, form: Column, markers: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone.

    No marker stands in the text, and none can arise where parts meet, so the first of each is the one put in.
    """
    p, s, m = markers

    def parted(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(made, len(first) + 1, F.length(made))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parted(p, s)
    late, early, between = parted(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, between, late)).otherwise(made)
