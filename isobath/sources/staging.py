"""Tables staged in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="isobath-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of this machine only where Spark runs in one process on it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or own_folder(spark.sparkContext.applicationId)).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and reread ``df``: lineage ends here, and lost executors cost nothing of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/isobath/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
