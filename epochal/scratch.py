"""The shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the one that the cluster names for checkpoints.

    Driver and executors must both see it, so a machine-local folder is only
    made where the setting is absent on one machine, as in tests.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("epochal.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="epochal-")
        spark.conf.set("epochal.scratch", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to a scratch folder and read back, for plans that read it several times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
