"""Tables written to the shared folder and read again: what several branches of a plan read is computed once, and plans stay short."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="inkwell-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, gone when it ends; on a cluster
    it is an error, as executors would write to disks of their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (shared or _own_dir()).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """A table written under `folder` and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/inkwell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.inkwell_path = path
    return held


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more, and lets go of the shuffles behind them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.inkwell_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()  # Spark removes the files of shuffles that no plan holds any more
