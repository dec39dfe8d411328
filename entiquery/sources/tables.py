"""Shared scratch tables: what a plan writes so that lineage and recomputation end there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..errors import PlanError


def scratch_path(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a local one only where it is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise PlanError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="entiquery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write and read back; lost executors then repeat nothing that lies before."""
    path = scratch_path(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_and_measure(df: DataFrame, measure: Column, *partition_by: str) -> tuple[DataFrame, object]:
    """The same, and the value of an aggregate over the rows, taken while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, measure.alias("value")), *partition_by)
    return out, seen.get["value"]
