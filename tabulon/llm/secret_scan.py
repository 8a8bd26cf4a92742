"""Secret scans that look at every content once.

A content is named by the SHA-256 of its bytes, whatever paths and versions hold it.
The ledger, a folder of Parquet tables, has one row per content and rule version that was
ever scanned, with the spans found (empty if none).  A scan first compares digests with the
ledger; only contents whose pair with some current rule version is missing are moved and
scanned, each once and for the missing versions alone.  What it finds is added as a part of
its own, and contents with findings are joined back to all paths.  DataFrame functions only.

Rules are regular expressions (Java syntax) with a kind, a version, and a least length
of one group; matches are leftmost and do not overlap, and short ones are dropped
afterwards.  Positions are code points, end exclusive.

Defined results: a null or empty content has no spans; contents that occur often are
scanned once and reported on each of their rows, repeated rows included; an empty
table gives an empty result.  Spans at the same start come in the order of the rules.
Given columns stay; one named ``spans`` is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import likely, marked_likely
from tabulon.session import scratch_path, settle

SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    #: a cheaper pattern that every kept match contains; contents without it are not cut up
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds of secrets that are looked for.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        hint=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", least=16, hint="AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, "[0-9a-f]+", least=32, hint="[0-9a-f]{32}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of a rule's kept matches, found from the lengths of matches and of what lies between."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(
            F.slice(F.transform(between, F.length), F.lit(1), F.size(matches)),
            F.transform(matches, F.length),
            lambda gap, length: F.struct(gap.cast("long").alias("gap"), length.cast("long").alias("length")),
        ),
        F.transform(kept, F.length),
        lambda s, n: F.struct(s["gap"].alias("gap"), s["length"].alias("length"), (n >= rule.least).alias("good")),
    )
    empty = F.from_json(F.lit("[]"), SPANS)
    begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))

    def step(held, s):
        start = held["at"] + s["gap"]
        end = start + s["length"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["good"], F.concat(held["found"], one)).otherwise(held["found"]).alias("found"))

    found = F.aggregate(steps, begin, step, lambda held: held["found"])
    return F.when(text.rlike(rule.hint or rule.pattern), found).otherwise(empty)


LEDGER = f"blob string, rule string, found {SPANS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``blob, rule, found`` of all finished scans."""
    return spark.read.schema(LEDGER).parquet(f"{path}/*")


def blob_of(text: str) -> Column:
    """The name of a content."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def unseen_pairs(files: DataFrame, text: str, rules: Sequence[Rule], ledger: str | None) -> DataFrame:
    """``blob, missing``: contents, and the rule versions they were never scanned for."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = files.select(blob_of(text).alias("blob")).distinct()
    if ledger is None:
        return blobs.withColumn("missing", keys)
    seen = read_ledger(files.sparkSession, ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))
    return blobs.join(seen, "blob", "left").select("blob", missing.alias("missing")).where(F.size("missing") > 0)


def scan(
    files: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, ledger: str | None = None
) -> tuple[DataFrame, str]:
    """Scan unseen contents, and return all rows with their ``spans`` and the path of the ledger.

    ``spans`` is ``array<struct<kind, start, end>>`` in order of start.  ``ledger`` is the path
    an earlier scan returned: a part is added to it, which counts once it is written whole.
    """
    spark = files.sparkSession
    path = ledger or scratch_path(spark, "ledger")
    todo = settle(unseen_pairs(files, text, rules, ledger))
    held = files.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    contents = likely(held, todo, "blob").groupBy("blob").agg(F.first("content").alias("content")).join(todo, "blob")
    each = F.array(
        *[
            F.when(
                F.array_contains("missing", r.key),
                F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("content"), r).alias("found")),
            )
            for r in rules
        ]
    )
    contents.select("blob", F.inline(F.filter(each, lambda x: x.isNotNull()))).write.parquet(f"{path}/scan-{uuid.uuid4().hex}")

    kinds = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    names = F.array(*[F.lit(r.kind) for r in rules])
    flat = settle(
        read_ledger(spark, path)
        .where(F.col("rule").isin([r.key for r in rules]) & (F.size("found") > 0))
        .select(
            "blob",
            F.transform(
                "found", lambda s: F.struct(s["start"].alias("start"), kinds[F.col("rule")].alias("k"), s["end"].alias("end"))
            ).alias("part"),
        )
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_set("part"))).alias("all"))
        .select(
            F.col("blob").alias("_blob"),
            F.transform(
                "all", lambda s: F.struct(names[s["k"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
            ).alias("spans"),
        )
    )
    given = files.drop(*[c for c in files.columns if c.lower() == "spans"])
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:bigint,end:bigint>>")
    rows = marked_likely(given.withColumn("_blob", blob_of(text)), flat, "_blob")
    kept = [F.col(f"`{c}`") for c in given.columns]
    hit = rows.where("_maybe").join(flat, "_blob", "left").select(*kept, F.coalesce("spans", none).alias("spans"))
    return rows.where("not _maybe").select(*kept, none.alias("spans")).unionByName(hit), path


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every stretch that spans cover replaced by a mark."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("made"))

    def step(held, s):
        gap = F.substring(text, held["at"] + 1, F.greatest(s["start"] - held["at"], F.lit(0)))
        fresh = s["start"] >= held["at"]  # a span that overlaps the one before only lengthens it
        made = F.when(fresh, F.concat(held["made"], gap, F.lit(mark))).otherwise(held["made"])
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), made.alias("made"))

    def finish(held):
        return F.concat(held["made"], F.substring(text, held["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, finish)).otherwise(text)
