"""Tables that cut a plan: written to a folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=4)
def _application_dir(top: str, application: str) -> str:
    """The folder of this application, deleted when the driver ends."""
    path = f"{top.rstrip('/')}/ledgerline-{application}-{uuid.uuid4().hex[:8]}"

    def clear():
        try:
            jvm = SparkContext._gateway.jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
        except Exception:  # the driver ends anyway; the folder's name tells whose it was
            pass

    atexit.register(clear)
    return path


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a local session gets a default; a cluster has to name a folder
    that all its machines share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"{tempfile.gettempdir()}/ledgerline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{_application_dir(top, spark.sparkContext.applicationId)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. What nothing reads any more goes
    by ``drop_dir``, all the rest when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, df_or_path) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rpartition("/")[0] for f in df_or_path.inputFiles()}
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
