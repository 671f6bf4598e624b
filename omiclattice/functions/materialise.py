"""Write an intermediate result once and read it back.

Used where several branches need the same expensive rows or an iteration
would grow its lineage. The table lands in the shared folder named by
``spark.checkpoint.dir``, so it survives lost executors, and as Parquet it
brings real sizes to the join planner.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WORKDIR = "spark.omiclattice.workdir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, else ``spark.omiclattice.workdir``.

    Only a local session that names neither gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORKDIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir or {WORKDIR} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(WORKDIR, path)
    return path


def settle(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/omiclattice/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
