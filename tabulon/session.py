"""Session defaults and the shared scratch folder.

A cluster passes its own session in; ``local_session`` is for tests and the
bench only.  Every intermediate table goes under the folder the session names
in ``spark.checkpoint.dir`` so that it outlives any single executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: paths handed out, by application
_GIVEN: dict[str, list[str]] = {}


def local_session(cores: str = "*", app: str = "tabulon", memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("TABULON_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    Only a session on one machine may name none (tests); a fresh local folder is
    then made and registered with it.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set(CHECKPOINT_KEY, named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete everything this application put under the shared folder; the number of paths deleted.

    Tables that still read from there (splits, training tables, scored tables) are gone
    afterwards, so call it when the results are written.
    """
    gone = 0
    for path in _GIVEN.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return gone


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: write the table to the shared folder and read it back.

    A Parquet table rather than an RDD checkpoint, so that the many passes that
    follow read only the columns they need.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Iterable[Mapping | tuple], schema: str | StructType) -> DataFrame:
    """A driver-side table (column names, fitted numbers) as a local relation.

    Going through Arrow keeps it inside the plan, with no Python worker behind it.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.fieldNames()
    records = [dict(r) if isinstance(r, Mapping) else dict(zip(names, r)) for r in rows]
    arrow = pa.Table.from_pylist(
        [{n: (list(v.items()) if isinstance(v, dict) else v) for n, v in r.items()} for r in records],
        schema=to_arrow_schema(kind),
    )
    return spark.createDataFrame(arrow, schema=kind)
