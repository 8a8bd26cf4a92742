"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. A pass over the texts gives every document its number of distinct five-word
   shingles, a digest of the whole set and a min-max signature: under each of 64
   permutations both the smallest and the largest value are kept, so 128 values cost
   64 evaluations.  They are banded four at a time into 32 bands.
2. Documents with the same set are one class from here on; classes share buckets by
   band.  Pairs of a small bucket whose signatures are far too different are put
   aside; of a large bucket no pairs are listed, its members just stay together.
   What remains together (connected) is a cluster.
3. Clusters are cut into blocks of bounded weight; each task compares two blocks on
   full sets, with inverted lists, and returns no more links than it has documents.
4. Components of the confirmed links.

With similarity 0.85 a link escapes all bands with probability below 10^-9, and the
signature test with probability below 10^-9.  Shingles are compared by 64-bit hashes.

Defined results: a null or empty text, or one without words, has an empty set and is
linked with nothing; of fewer words than a shingle the whole sequence is the one
shingle.  A row without an id is linked with nothing, has no component and is kept.
Rows that repeat an id are judged each by its own text: another text under the same id has
no part in it.  Equal sets are one class, so ties need no rule: a component's name is its
smallest id.  Other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import (
    binaries,
    content_keys,
    extend,
    likely,
    lists,
    marked_likely,
    mixed,
    numbers,
    shingle_set,
    texts_of,
    word_hashes,
)
from tabulon.llm.graph import components
from tabulon.session import settle

PERMUTATIONS = 64
BAND = 4
SHINGLE = 5
PERCENT = 85
SIGNATURE_SHARE = 0.6
SMALL_BUCKET = 32
BLOCK_SHINGLES = 300_000
BLOCK_DOCS = 400

SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("signature", T.BinaryType()),
    ]
)
SETS = T.StructType([T.StructField("shingles", T.BinaryType()), T.StructField("digest", T.BinaryType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def min_max(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray, step: int = 2048) -> np.ndarray:
    """Smallest and largest value of a set under each permutation, side by side."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for k in range(0, len(shingles), step):
        values = factors[:, None] * shingles[None, k : k + step]
        values += shifts[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key per band; a band joins values of different permutations."""
    spread = signature.reshape(rows, -1)
    keys = np.arange(spread.shape[1], dtype=np.uint64)
    for row in spread:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def signatures(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, content keys, set size, set digest, band keys and one byte of each signature value."""

    def begin():
        factors, shifts = permutations(PERMUTATIONS)
        none = np.zeros(0, np.int64)

        def work(column):
            sizes, digests, bands, signed = [], [], [], []
            for x in texts_of(column):
                shingles = shingle_set(word_hashes(x, "spaced"), SHINGLE)
                sizes.append(len(shingles))
                if not len(shingles):
                    for out in (digests, bands, signed):
                        out.append(None)
                    continue
                made = min_max(shingles, factors, shifts)
                digests.append(_digest(shingles.tobytes()))
                bands.append(band_keys(made, BAND).view(np.int64))
                signed.append(mixed(made).astype(np.uint8).tobytes())
            return [
                numbers(sizes),
                binaries(digests),
                lists([None if b is None else len(b) for b in bands], numbers(np.concatenate([none, *[b for b in bands if b is not None]]))),
                binaries(signed),
            ]

        return work

    plain = df.select(F.col(id).cast("long").alias("id"), *content_keys(text), F.col(text).alias("text"))
    return extend(plain, SIGNED, begin, ["text"]).drop("text")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges ``a, b`` that tie together all classes which may be similar; linear in the bands."""
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first")).where("m > 1")
    inside = rows.join(full, "bucket")
    large = inside.where(F.col("m") > SMALL_BUCKET).select(F.col("first").alias("a"), F.col("id").alias("b"))
    lists = inside.where(F.col("m") <= SMALL_BUCKET).groupBy("bucket").agg(F.collect_set("id").alias("ids"))
    pairs = (
        lists.select("ids", F.explode("ids").alias("a"))
        .select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
        .distinct()
    )
    signed = classes.select("id", "signature")
    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("left")), "a").join(
        signed.select(F.col("id").alias("b"), F.col("signature").alias("right")), "b"
    )
    return both.mapInArrow(_alike, LINKS).unionByName(large.where("a != b").distinct())


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of which enough signature bytes agree."""
    for b in batches:
        left, right = (
            np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
            for c in ("left", "right")
        )
        good = numbers(np.flatnonzero((left == right).mean(axis=1) >= SIGNATURE_SHARE))
        yield pa.RecordBatch.from_arrays([b.column("a").take(good), b.column("b").take(good)], names=["a", "b"])


def confirmed_links(texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links ``a, b`` between nodes of one cluster, enough of them to connect what is linked.

    ``texts``: ``id, text``; ``clusters``: ``node, id, n_shingles, set_key, cluster``.
    """
    weight = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.greatest(F.col("w") / BLOCK_SHINGLES, F.col("m") / BLOCK_DOCS))
    placed = clusters.join(weight.select("cluster", blocks.alias("blocks")), "cluster").select(
        "node", "id", "set_key", "cluster", "blocks", F.expr("pmod(xxhash64(node), blocks)").alias("block")
    )
    # an id may stand for several texts: the one with the node's set is meant
    met = likely(texts, clusters, "id").join(placed, "id")
    held = extend(met, SETS, _sets, ["text"]).drop("text").where("digest = set_key")
    meeting = held.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "cluster",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        F.col("node").alias("id"),
        "block",
        "shingles",
    )
    return meeting.groupBy("cluster", "low", "high").applyInArrow(_compare, LINKS)


def _sets():
    def work(column):
        sets = [shingle_set(word_hashes(x, "spaced"), SHINGLE).tobytes() for x in texts_of(column)]
        return [binaries(sets), binaries([_digest(s) for s in sets])]

    return work


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _compare(group: pa.Table) -> pa.Table:
    """Links inside one block, or between two; links that close a circle are left out."""
    ids = group.column("id").to_numpy()
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    side = group.column("block").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    holders, firsts = owner[order], np.cumsum(often) - often
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(sets) - 1):
        held = at[begins[i] : begins[i + 1]]
        held = held[often[held] > 1]
        if not len(held):
            continue
        n = often[held]
        places = np.repeat(firsts[held] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(holders[places], minlength=len(sets))
        good = 100 * common >= PERCENT * (sizes[i] + sizes - common)
        good[: i + 1] = False
        if low != high:
            good &= side != side[i]
        for j in np.flatnonzero(good):
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                links.append((ids[i], ids[j]))
    return pa.Table.from_arrays([numbers([x for x, _ in links]), numbers([y for _, y in links])], names=["a", "b"])


def judged(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id, k1, k2, n_shingles, component, kept``; the two keys name the row's content.

    Sets are the nodes, named by the number of one of their rows, so that an id that stands
    for several texts ties none of them together.
    """
    signed = settle(signatures(df, id, text).withColumn("row", F.monotonically_increasing_id()))
    known = signed.where("n_shingles > 0 and id is not null")
    classes = settle(known.groupBy("set_key").agg(F.min("id").alias("least"), F.min("row").alias("node")))
    shown = known.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    edges = candidate_edges(shown.select(F.col("node").alias("id"), "bands", "signature"))
    clusters = settle(
        components(edges)
        .withColumnRenamed("component", "cluster")
        .join(shown.select("node", "id", "n_shingles", "set_key"), "node")
    )
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = components(confirmed_links(texts, clusters))
    tied = classes.join(found, "node").select("set_key", "component", "least")
    names = tied.groupBy("component").agg(F.min("least").alias("smallest"))
    named = tied.join(names, "component").select("set_key", "smallest")
    whole = classes.join(named, "set_key", "left").select("set_key", F.coalesce("smallest", "least").alias("smallest"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id"))
    return signed.join(whole, "set_key", "left").select(
        "id", "k1", "k2", "n_shingles", component.alias("component"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept")
    )


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id, n_shingles, component_id, kept``."""
    return judged(df, id, text).select(F.col("id").alias(id), "n_shingles", F.col("component").alias("component_id"), "kept")


def without_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are kept, by id and text, and of fully equal rows one."""
    key = ["_id", "k1", "k2"]
    rows = judged(df, id, text).withColumnRenamed("id", "_id").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept"))
    marks = settle(rows.where("_id is not null and (n > 1 or not kept)"))
    keyed = df.select("*", F.col(id).cast("long").alias("_id"), *[c.alias(f"_{k}") for c, k in zip(content_keys(text), ("k1", "k2"))])
    marks = marks.withColumnsRenamed({"k1": "_k1", "k2": "_k2", "kept": "_kept"})
    key = ["_id", "_k1", "_k2"]
    found = marked_likely(keyed, marks, "_k1")  # only rows that may be marked are moved
    plain = found.where("not _maybe").select(*df.columns)
    moved = found.where("_maybe").join(marks, key, "left")
    once = moved.where("_kept").select(*df.columns).distinct()
    return plain.unionByName(moved.where("_kept is null").select(*df.columns)).unionByName(once)
