"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the folder that spark.checkpoint.dir names, and read again; survives lost executors.

    Where that is unset and all runs in one process, as in tests, the folder is
    one of its own.  The driver deletes the table when it ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:" + tempfile.mkdtemp(prefix="settled-")
    path = f"{root.rstrip('/')}/settled-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
