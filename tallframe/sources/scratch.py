"""Intermediate tables in a folder that all executors share.

They cut lineage in a way that survives the loss of any executor.  The folder is
the one in ``spark.checkpoint.dir``; where that is unset it lies below the
warehouse, which is shared too."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return base.rstrip("/") if base else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path; a session that has ended already leaves it alone."""
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except (TypeError, ConnectionError, AttributeError):
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; removed
    when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
