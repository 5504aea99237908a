"""Frames written once and read from then on, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset a local folder serves a local master;
    on a cluster this is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share.")
    own = tempfile.mkdtemp(prefix="rarespark-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and whatever reads it reads
    only the columns it needs."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
