"""Datasets and trained models kept under a root folder on shared storage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.inference import DATASET_INFO, dataset_info
from tabulon.sources import profiles
from tabulon.session import small_table

PERFORMANCE = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("training_time", T.DoubleType()),
        T.StructField("is_best", T.BooleanType()),
    ]
)
_NAMES = T.ArrayType(T.StringType())
METADATA = T.StructType(
    [
        T.StructField("training_id", T.StringType()),
        T.StructField("problem_type", T.StringType()),
        T.StructField("best_model_name", T.StringType()),
        T.StructField("feature_names", _NAMES),
        T.StructField("labels", _NAMES),
        T.StructField("model_performances", T.ArrayType(PERFORMANCE)),
        T.StructField(
            "original_columns",
            T.StructType(
                [
                    T.StructField("numerical", _NAMES),
                    T.StructField("categorical", _NAMES),
                    T.StructField("hash_encoded", _NAMES),
                ]
            ),
        ),
        T.StructField("scaling", T.MapType(T.StringType(), T.StringType())),
        T.StructField("encoding", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.DoubleType()),
    ]
)


def _read(spark: SparkSession, path: str, missing: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        raise ValueError(missing) from error


def register_dataset(df: DataFrame, name: str, root: str) -> tuple[str, DataFrame]:
    """Store a table with its description and its profile; returns the id and the one-row description."""
    dataset_id = str(uuid.uuid4())
    stored = _keep_part(df, f"{root}/{dataset_id}")
    info = dataset_info(stored, name)
    info.write.json(f"{root}/{dataset_id}/info")
    return dataset_id, info


def append_dataset(df: DataFrame, dataset_id: str, root: str) -> DataFrame:
    """Add rows to a stored table; only they are read and profiled. Returns the stored part.

    The columns and their types have to be those of the stored table.  The description
    stays that of the first part.  An append that breaks off between rows and profile leaves
    rows that the profile does not count.
    """
    held, _ = load_dataset(df.sparkSession, dataset_id, root)
    if [(f.name, f.dataType) for f in held.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"columns differ from those of dataset {dataset_id}")
    return _keep_part(df, f"{root}/{dataset_id}")


def _keep_part(df: DataFrame, place: str) -> DataFrame:
    """Write rows and their profile as a new part; the profile reads the written rows."""
    part = uuid.uuid4().hex
    df.write.parquet(f"{place}/data/{part}")
    stored = df.sparkSession.read.parquet(f"{place}/data/{part}")
    profiles.partial_profile(stored).write.parquet(f"{place}/profile/{part}")
    return stored


def dataset_profile(spark: SparkSession, dataset_id: str, root: str) -> DataFrame:
    """The profile of a stored table from the profiles of its parts; no row of the table is read."""
    try:
        parts = spark.read.schema(profiles.PARTIAL).option("recursiveFileLookup", "true").parquet(f"{root}/{dataset_id}/profile")
    except AnalysisException as error:
        raise ValueError(f"dataset {dataset_id} not found") from error
    return profiles.spelled_out(parts)


def load_dataset(spark: SparkSession, dataset_id: str, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored table, all its parts, and its description; an unknown id is refused."""
    info = _read(spark, f"{root}/{dataset_id}/info", f"dataset {dataset_id} not found", DATASET_INFO)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{dataset_id}/data"), info


def save_model(
    spark: SparkSession,
    root: str,
    model: PipelineModel,
    metadata: Mapping,
    quality: Mapping[str, DataFrame] | None = None,
) -> str:
    """Store the fitted steps and model, a metadata row and the quality tables."""
    training_id = metadata.get("training_id") or str(uuid.uuid4())
    folder = f"{root}/{training_id}"
    model.write().overwrite().save(f"{folder}/model")
    row = {f: None for f in METADATA.fieldNames()} | dict(metadata)
    row |= {"training_id": training_id, "timestamp": row["timestamp"] or time.time()}
    small_table(spark, [row], METADATA).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    for name, table in (quality or {}).items():
        table.write.mode("overwrite").parquet(f"{folder}/quality/{name}")
    return training_id


def load_model(spark: SparkSession, training_id: str, root: str) -> tuple[PipelineModel, DataFrame]:
    """The fitted model and its metadata row; an unknown id is refused."""
    metadata = _read(spark, f"{root}/{training_id}/metadata", f"training {training_id} not found", METADATA)
    return PipelineModel.load(f"{root}/{training_id}/model"), metadata


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Every stored model, the newest first."""
    try:
        stored = spark.read.schema(METADATA).json(f"{root}/*/metadata")
    except AnalysisException:
        stored = small_table(spark, [], METADATA)
    return stored.select(
        "training_id",
        "problem_type",
        F.col("best_model_name").alias("best_model"),
        "timestamp",
        F.coalesce(F.size("feature_names"), F.lit(0)).alias("feature_count"),
    ).orderBy(F.desc_nulls_last("timestamp"))


def training_report(metadata: DataFrame) -> DataFrame:
    """The report of one training: summary, performances, features, applied steps."""
    applied = F.struct(
        F.col("scaling").alias("numerical_scaling"),
        F.col("encoding").alias("categorical_encoding"),
        F.lit("Applied").alias("missing_value_imputation"),
    )
    return metadata.select(
        F.struct(
            "training_id",
            "problem_type",
            F.col("best_model_name").alias("best_model"),
            F.col("timestamp").alias("training_timestamp"),
            F.size("feature_names").alias("feature_count"),
            F.size("model_performances").alias("models_trained"),
        ).alias("training_summary"),
        "model_performances",
        "feature_names",
        F.struct("original_columns", applied.alias("preprocessing_applied")).alias("data_info"),
    )


def write_report(metadata: DataFrame, path: str) -> None:
    training_report(metadata).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
