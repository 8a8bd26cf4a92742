"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors hold integers.  Candidates are cut into blocks of bounded size; in a block, all
ids with the same value in one dimension form a posting segment.  For a query a
segment's impact is the size of query value times segment value, quantised to levels.
Segments are processed level by level from the highest, in steps that hold equal shares of
the postings.  After a step, a candidate's score is at most what it has plus, for each
dimension it was not yet met in, the highest impact still to come.  Candidates whose bound is below the k-th best known score
can not be members; as soon as the others have fewer components than there are postings
to come, they are scored exactly.  The k best of every block are merged.

Queries are cut into blocks as well, and each meets each block of candidates in a task of
its own; nothing but the number, width and largest component of vectors comes to the driver.

Defined results: vectors that are null, or hold a null or a component that is not
finite, take no part, and neither do rows without an id; a missing component counts
as 0, so vectors of different lengths can meet and an empty one scores 0; components
must fit 64 bits once scaled.  Of equal scores the smaller id is better.  A repeated id is a candidate once per row, but rows
with the query's own id never are.  Without queries or candidates the result is
empty.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import small_batches
from tabulon.session import settle

QUERY_BLOCK = 65_536
CANDIDATE_BLOCK = 8192
LEVELS = 64
STEPS = 8
"""Levels are taken together so that each step processes such a part of the postings."""

FEW = 64

HITS = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]
)
EXACT = 2**53


def whole_components(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component; null where the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale)))


class SegmentIndex:
    """Posting segments of one block of candidates."""

    def __init__(self, vectors: np.ndarray):
        n, width = vectors.shape
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        values = np.take_along_axis(vectors, order, axis=0)
        begins, found, dims = [], [], []
        for d in range(width):
            first = np.concatenate([[0], np.flatnonzero(np.diff(values[:, d])) + 1])
            begins.append(first + d * n)
            found.append(values[first, d])
            dims.append(np.full(len(first), d))
        self.posts = np.ascontiguousarray(order.T).reshape(-1)
        #: where each segment begins, and behind the last one where it ends
        self.begins = np.append(np.concatenate(begins), n * width)
        self.sizes = np.diff(self.begins)
        self.values, self.dims = np.concatenate(found), np.concatenate(dims)
        self.base = 1 << width.bit_length()
        """A sum of ``product * base + 1`` holds a score and the number of dimensions met."""

    def possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the ``k`` best; no other row can be."""
        n, width = self.vectors.shape
        if n <= max(FEW, k) or self.vectors.dtype == object:  # numbers that floating point can not add exactly
            return np.arange(n)
        product = self.values * query[self.dims]
        impact = np.abs(product)
        top = impact.max()
        if top <= 0 or top * width * self.base * 4 >= EXACT:
            return np.arange(n)
        level = (impact * (LEVELS - 1) / top).astype(np.int64)  # quantised impact
        above = np.cumsum(np.bincount(level, self.sizes, LEVELS)[::-1])[::-1]  # postings of a level and those over it
        packed = product * self.base + 1
        held, left, floor = np.zeros(n), np.arange(n), -np.inf
        done, before = 0, LEVELS
        for step in range(1, STEPS + 1):
            # down to the level at which a further share of the postings is processed
            cut = min(int(np.searchsorted(-above, -step * self.posts.size / STEPS, side="right")) - 1, before - 1)
            cut = max(cut, 0)
            chosen = (level >= cut) & (level < before)
            if not chosen.any():
                continue
            edge = np.flatnonzero(np.diff(chosen.view(np.int8), prepend=0, append=0))
            rows = [self.posts[a:b] for a, b in zip(self.begins[edge[::2]].tolist(), self.begins[edge[1::2]].tolist())]
            held += np.bincount(np.concatenate(rows), np.repeat(packed[chosen], self.sizes[chosen]), n)
            done, before = int(above[cut]), cut
            score = np.floor(held / self.base)
            best = np.argpartition(-score, k)[:k]
            floor = max(floor, (self.vectors[best] @ query).min())
            ceiling = cut * top / (LEVELS - 1)  # every impact still to come is smaller
            left = np.flatnonzero(score + (width - (held - score * self.base)) * ceiling >= floor)
            if cut == 0 or len(left) * width <= max(self.posts.size - done, FEW):
                break
        return left

    def best(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """``(id, score)`` of the ``k`` best candidates other than ``own``."""
        rows = self.possible(query, k + int((ids == own).sum()))
        rows = rows[ids[rows] != own]
        many = len(rows) * 4 > len(ids)
        scores = (self.vectors @ query)[rows] if many else self.vectors[rows] @ query
        order = np.lexsort((ids[rows], -scores))[:k]
        return [(int(ids[rows[i]]), int(scores[i])) for i in order]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width, filled up with 0."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), at] = flat
    return out


def _number_type(largest: int, width: int):
    """Floating point adds integers exactly, and faster, as long as no sum passes 2^53."""
    return np.float64 if largest * largest * max(1, width) * 4 < EXACT else object


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of every row for which ``queries`` holds, against all rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    whole = vectors.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
        whole_components(F.col(vector)).alias("x"),
    )
    held = settle(whole.where("x is not null"))
    facts = held.agg(
        F.count(F.lit(1)),
        F.count_if("asks"),
        F.max(F.size("x")),
        F.max(F.array_max(F.transform("x", F.abs))),
    ).first()
    rows, asking, width, largest = (v or 0 for v in facts)
    kind = _number_type(int(largest), width)
    narrow = next((t for t, most in (("short", 1 << 15), ("int", 1 << 31)) if largest < most), "long")
    slim = held.withColumn("x", F.col("x").cast(f"array<{narrow}>"))
    blocks, asked = max(1, -(-rows // CANDIDATE_BLOCK)), max(1, -(-asking // QUERY_BLOCK))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    pair = ("block", "part")
    candidates = slim.select(
        "id", "x", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), every(asked, "part")
    )
    asks = slim.where("asks").select("id", "x", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int").alias("part"), every(blocks, "block"))
    found = candidates.groupBy(*pair).cogroup(asks.groupBy(*pair)).applyInArrow(_searcher(k, width, kind), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec_id").alias(id), "score")
    )


def _searcher(k: int, width: int, kind):
    def search(block: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if block.num_rows and asks.num_rows:
            ids = block.column("id").to_numpy()
            index = SegmentIndex(_matrix(block.column("x").combine_chunks(), width).astype(kind)) if width else None
            vectors = _matrix(asks.column("x").combine_chunks(), width).astype(kind)
            for own, query in zip(asks.column("id").to_pylist(), vectors):
                if index is None:
                    best = [(i, 0) for i in sorted(ids[ids != own].tolist())[:k]]
                else:
                    best = index.best(query, ids, own, k)
                out += [(own, i, s) for i, s in best]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=pa.schema([(f.name, pa.int64()) for f in HITS]))

    return search
