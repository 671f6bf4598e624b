"""Where operators keep intermediate tables and files."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """New folder below ``spark.checkpoint.dir``; a temporary one only for a local session that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        with contextlib.suppress(PySparkException):
            spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, the text as string; extra columns are left aside."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; module globals are sent anew with each task."""
    return sys.__dict__.setdefault(f"_cache_{name}", {})


def give_back(*names: str) -> None:
    """Leave named caches, and return memory that this process no longer uses: a reused worker keeps its largest size otherwise."""
    for name in names:
        process_cache(name).clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
