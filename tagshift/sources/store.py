"""Intermediate and versioned tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it then gets one scratch folder of its own,
    which goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if root:
        return f"{root.rstrip('/')}/tagshift/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tagshift-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """While it holds, what is run evaluates long chains of expressions in methods that the JVM compiles.

    The JVM only interprets methods of more than 8000 bytes. The kinematics and the bins of all variables make such methods when
    Spark puts them into one for a whole stage; with this limit it evaluates their projections one by one instead.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the table that was written.

    Cuts the lineage, keeps column pruning on the way back and survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_wide(df: DataFrame, name: str = "stage") -> DataFrame:
    """``materialize`` for tables of long chains of expressions."""
    with short_methods(df.sparkSession):
        return materialize(df, name)
