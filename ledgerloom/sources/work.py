"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    A session without that setting gets a local temporary folder if it is a local one (tests, a
    laptop); on a cluster, where a local folder is not shared, that is an error. The folder goes when
    the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-work")
    path = f"{base.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared work folder and return a reader of what was written.

    Cuts lineage and fixes anything that a second evaluation could order differently; the files
    outlive any executor.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
