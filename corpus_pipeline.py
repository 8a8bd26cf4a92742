"""From raw documents to token ids, in five stages.

Each stage is written as Parquet to the shared folder and read again, so a lost
executor costs a part of one stage, and a broken run can be taken up after the last
written one.  All but the last return the columns of documents.

Defined results, beside those of the operators: documents without text pass every
filter that has nothing to hold against them; an id that stands for several texts is judged
text by text; of rows that are equal in all columns one stays; rows without an id are never
dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, decontamination, near_duplicates, quality, secret_scan
from tabulon.llm.registered import remainder, table, vocabulary
from tabulon.session import scratch_path

KEEP_FROM = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the limit; the model never sees one label in four."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_quality(docs, labels.where(remainder(4) != 2))
    return quality.score_quality(docs, model).where(F.col("score") >= KEEP_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id."""
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty stands in a window of a benchmark item, and these words cut out."""
    length = F.coalesce(F.length("text"), F.lit(0))
    counted = docs.withColumn("n_chars", F.col("n_chars") - length)  # the count follows the text
    clean = decontamination.cleaned(counted, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.col("n_chars") + length).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; the character count follows the text."""
    scanned, _ = secret_scan.scan(docs)
    clean = scanned.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(
        *docs.columns
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.round_trip(docs, vocabulary()).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encode", encode),
]

#: a trained model, a similarity join and an encoder stand in the way of SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
