"""Finding and removing test items inside training texts.

All test items, as word sequences, go into one generalised suffix automaton.  A
document streams through it word by word; the automaton keeps the longest run of
words that ends here and stands in some item.  Where that run has ``width`` words,
they are a window of an item and are marked; an item of fewer words is one window.

Items are taken in blocks of bounded size: one automaton per block is built on the
driver and broadcast, and the documents pass through one block after another without
a shuffle, each pass adding to the spans found before.

Defined results: null and empty texts have no words and no hits; an item without
words never occurs; items with the same words all count; items sharing an id count
once; an item without an id marks words but is not listed; without items nothing is
hit.  Repeated documents are judged one by one.  Given columns stay; one named like
an added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import binaries, byte_classes, extend, lists, numbers, texts_of
from tabulon.session import settle

WIDTH = 13
BLOCK_WORDS = 400_000

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(SPAN)),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return text.translate(byte_classes("plain")).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items behind each window."""

    def __init__(self, items: Sequence[tuple[str | None, bytes]], width: int = WIDTH):
        self.width = width
        self.codes: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[int]] = [set()]  # items in which a state's words end at some place
        self.names: list[str | None] = []
        whole: dict[int, dict[int, set[int]]] = {}  # state -> number of words -> short items
        for n, (name, text) in enumerate(items):
            self.names.append(name)
            words = [self.codes.setdefault(w, len(self.codes)) for w in words_of(text)]
            state = 0
            for c in words:
                state = self._grow(state, c, owners)
                if self.length[state] >= width:
                    owners[state].add(n)
            if 0 < len(words) < width:
                whole.setdefault(state, {}).setdefault(len(words), set()).add(n)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:  # whatever ends in a state ends in its suffixes too; shorter ones are never asked for
            if self.length[self.link[s]] >= width:
                owners[self.link[s]] |= owners[s]
        #: items in which the words of a state of at least width words stand
        self.items = owners
        self.whole = whole
        #: per state: the nearest state on the way to the root that ends a short item
        self.short = [-1] * len(self.length)
        for s in reversed(order):
            self.short[s] = s if s in whole else self.short[self.link[s]]

    def _grow(self, last: int, c: int, owners: list[set[int]]) -> int:
        """Append one word after the state ``last``; states of earlier items are reused."""
        moves, link, length = self.moves, self.link, self.length
        old = moves[last].get(c)
        if old is not None and length[old] == length[last] + 1:
            return old
        if old is not None:
            return self._split(last, c, old, owners)
        new = self._state({}, length[last] + 1, 0, owners, set())
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, owners)
        return new

    def _split(self, p: int, c: int, q: int, owners: list[set[int]]) -> int:
        """A copy of ``q`` for the shorter words reached from ``p``."""
        copy = self._state(dict(self.moves[q]), self.length[p] + 1, self.link[q], owners, set())
        self.link[q] = copy
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, moves: dict[int, int], length: int, link: int, owners: list[set[int]], own: set[int]) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        owners.append(own)
        return len(self.length) - 1

    def matched(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (end exclusive, ascending and apart) covered by windows, and the items."""
        moves, link, length, short, whole, width = self.moves, self.link, self.length, self.short, self.whole, self.width
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        state = run = 0
        for k, c in enumerate(map(self.codes.get, words)):
            if c is None:
                state = run = 0
                continue
            to = moves[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = moves[state].get(c)
            if to is None:
                run = 0
                continue
            state = to
            run += 1
            reach = 0
            if run >= width:
                reach = width
                window = state
                while length[link[window]] >= width:
                    window = link[window]
                if window not in seen:
                    seen.add(window)
                    items |= self.items[window]
            at = short[state]
            while at > 0:
                for n, ended in whole[at].items():
                    if n <= run:
                        items |= ended
                        reach = max(reach, n)
                at = short[link[at]] if link[at] > 0 else -1
            if reach:
                start = k + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, k + 1))
        return spans, items


def item_blocks(items: DataFrame, id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items, a bounded number of words at a time; no more than one block is on the driver."""
    held, size = [], 0
    rows = items.select(F.col(id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).distinct()
    for row in rows.toLocalIterator():
        content = bytes(row["t"] or b"")
        words = len(words_of(content))
        if held and size + words > block_words:
            yield held
            held, size = [], 0
        if words:
            held.append((row["i"], content))
            size += words
    if held:
        yield held


def find_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Append ``n_words``, ``hit_spans`` (word positions, end exclusive) and ``hit_items`` (ids as text)."""
    out, passes = docs, 0
    for block in item_blocks(items, item_id, item_text, block_words):
        out = _one_pass(out, ItemAutomaton(block, width), text, passes > 0)
        passes += 1
    return out if passes else _one_pass(out, ItemAutomaton([], width), text, False)


def _one_pass(docs: DataFrame, automaton: ItemAutomaton, text: str, more: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def begin():
        found = shared.value

        def work(column, *before):
            spans_before = before[0].to_pylist() if more else None
            items_before = before[1].to_pylist() if more else None
            counts, spans, items = [], [], []
            for k, x in enumerate(texts_of(column)):
                words = words_of(x)
                marked, hit = found.matched(words)
                names = {found.names[n] for n in hit} - {None}
                if more:
                    marked = _union(marked + [(s["start"], s["end"]) for s in spans_before[k]])
                    names |= set(items_before[k])
                counts.append(len(words))
                spans.append(marked)
                items.append(sorted(names))
            borders = [[span[k] for x in spans for span in x] for k in (0, 1)]
            return [
                numbers(counts),
                lists([len(x) for x in spans], pa.StructArray.from_arrays([numbers(side) for side in borders], names=["start", "end"])),
                lists([len(x) for x in items], binaries([n.encode() for x in items for n in x], pa.string())),
            ]

        return work

    return extend(docs, FOUND, begin, [text, "hit_spans", "hit_items"] if more else [text])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_words() -> F.Column:
    """Number of marked words, from ``hit_spans``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share: int = 20) -> F.Column:
    """Whether some word is hit and the hits are at least one word in ``share``."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("n_words"))


def without_spans(docs: DataFrame, text: str = "text", longest: int = 1) -> DataFrame:
    """Cut every marked span out of the texts of ``find_items``, or those of at least ``longest`` words.

    A span goes from the first to the last character of its words; what stands
    around it stays.
    """

    def begin():
        def work(column, spans):
            out = []
            for x, marked in zip(column.cast(pa.binary()).to_pylist(), spans.to_pylist()):
                marked = [s for s in marked or [] if s["end"] - s["start"] >= longest]
                out.append(x if x is None or not marked else _cut(x, marked))
            return [binaries(out).cast(pa.string())]

        return work

    added = T.StructType([T.StructField(text, T.StringType())])
    return extend(docs, added, begin, [text, "hit_spans"])


def cleaned(
    docs: DataFrame, items: DataFrame, text: str = "text", share: int = 20, width: int = WIDTH, **named: str
) -> DataFrame:
    """Rows without the contaminated ones, and without every marked span in the texts of the others.

    Where a span is cut out, what stood before and behind it meet; a window that arises
    there is cut as well, in further passes over the texts that were cut, until none is left.
    """
    columns = docs.columns
    found = settle(find_items(docs, items, text, width=width, **named))
    found = found.where(~contaminated(share))
    out = found.where(F.size("hit_spans") == 0).select(*columns)
    hit = found.where(F.size("hit_spans") > 0)
    while not hit.isEmpty():  # texts only get shorter
        cut = without_spans(hit, text).select(*columns)
        found = settle(find_items(cut, items, text, width=width, **named))
        out = out.unionByName(found.where(F.size("hit_spans") == 0).select(*columns))
        hit = found.where(F.size("hit_spans") > 0)
    return out


def _cut(text: bytes, spans: Sequence[dict]) -> bytes:
    inside = np.frombuffer(text.translate(byte_classes("plain")), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s in spans:
        out.append(text[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    out.append(text[at:])
    return b"".join(out)
