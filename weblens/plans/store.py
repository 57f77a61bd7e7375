"""Prepared tables in the shared folder of the cluster.

Stages are cut by writing a table, not by caching: a lost executor only re-reads
files.  The folder is ``spark.checkpoint.dir``; a local folder is used only by a
local session that does not set it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="weblens-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/weblens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table under a fresh path and read it back, which cuts the lineage."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Wide expressions as many small methods while a table is written: Java does not compile a method of over 8000 bytes and interprets it for every row."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)
