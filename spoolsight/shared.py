"""Written intermediates in the folder that driver and executors share.

It is the one that ``spark.checkpoint.dir`` names. Only a session on one machine may do without, and then gets a temporary
folder; anywhere else executors would write where nobody reads.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors can read and write; ValueError on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        key = spark.sparkContext.applicationId
        if key not in _fallback:
            _fallback[key] = "file://" + tempfile.mkdtemp(prefix="spoolsight-")
        base = _fallback[key]
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. ``codec`` is Spark's own
    unless given."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
