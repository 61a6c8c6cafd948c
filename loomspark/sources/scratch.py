"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this driver has written and not released.
WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, one below the warehouse, or a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, base, True)
            base = f"file://{base}"
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables written so far, once no result that reads them is needed any more; returns how many."""
    paths, n = spark._jvm.org.apache.hadoop.fs.Path, len(WRITTEN)
    while WRITTEN:
        path = paths(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
