"""Written tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; unset, a new temporary folder on one machine and an error on a cluster."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vicinage-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is written once and read back: what comes after costs a reread, not a rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vicinage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
