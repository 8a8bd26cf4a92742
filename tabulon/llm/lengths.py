"""Exact histogram of encoded lengths, and what each context limit costs.

Documents are counted by their number of tokens; everything else is read from that
histogram.  Sums over all shorter or longer lengths are taken in two steps (inside
blocks of neighbouring lengths, then over the blocks), so no task sorts all lengths.

Defined results: null and empty texts have length 0 and count as documents; an empty
table has no rows; repeated rows count as often as they stand there; ties share one
row.  Columns other than the text do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.bpe import count_tokens
from tabulon.session import settle

BLOCK = 1024


def length_histogram(lengths: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """Documents by length: ``n_tokens``, ``n_docs``."""
    return lengths.groupBy(F.col(tokens).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per occurring length, taken as a context limit.

    ``docs_over``: documents that are longer; ``tokens_kept``: tokens left if every
    document is cut there; ``tokens_whole``: tokens of the documents that fit;
    ``share_fitting``: documents that fit, as a share, so the q-quantile of the
    lengths is the first ``n_tokens`` whose share is at least q.
    """
    parts = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn(
        "tokens", F.col("n_tokens") * F.col("n_docs")
    )
    totals = parts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    upward = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select(
        "block",
        F.coalesce(F.sum("d").over(upward), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(upward), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(everything).alias("docs_all"),
        F.sum("t").over(everything).alias("tokens_all"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    fitting = F.col("docs_before") + F.sum("n_docs").over(inside)
    whole = F.col("tokens_before") + F.sum("tokens").over(inside)
    over = F.col("docs_all") - F.col("docs_fitting")
    return (
        parts.join(before, "block")
        .select("n_tokens", "n_docs", "docs_all", "tokens_all", fitting.alias("docs_fitting"), whole.alias("tokens_whole"))
        .select(
            "n_tokens",
            "n_docs",
            over.alias("docs_over"),
            "tokens_whole",
            (F.col("tokens_whole") + over * F.col("n_tokens")).alias("tokens_kept"),
            "tokens_all",
            (F.col("docs_fitting") / F.col("docs_all")).alias("share_fitting"),
        )
    )


def token_budget(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``context_limits`` of a table's texts under the vocabulary at ``path``.

    The limits read the histogram more than once, so it is written out first: every text
    is encoded once.
    """
    return context_limits(settle(length_histogram(count_tokens(df.select(text), path, text))))
