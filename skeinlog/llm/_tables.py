"""Shared-folder tables: how an operator cuts lineage or reads an intermediate result more than once.

A written table is plain Parquet in the folder the cluster names in ``spark.checkpoint.dir``, so that a lost
executor loses nothing and any other executor can read it. Tables live until the folder is cleaned, as
Spark's own checkpoints do; :func:`drop_table` removes one early.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary folder;
    a cluster session gets an error, since a folder of one machine would be invisible to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/skeinlog-scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a Python worker is sent. A batch stands in the executor and in the worker at once.
ARROW_BYTES = 8 << 20


@contextmanager
def frugal(spark: SparkSession):
    """Actions inside remove their shuffle files as each of them ends, not when the driver next collects garbage, and send
    Python workers small batches, however large rows are."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with frugal(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(df: DataFrame, name: str, column: str, values: list[int]) -> list[DataFrame]:
    """Write ``df`` once and return a table for each of the values that an integer column takes; each can be dropped alone."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with frugal(spark):
        df.write.partitionBy(column).parquet(path, compression="zstd")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    own = df.drop(column).schema
    out = []
    for value in values:
        folder = f"{path}/{column}={value}"
        at = fs_path(folder)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        out.append(spark.read.schema(own).parquet(folder) if there else spark.createDataFrame([], own))
    return out


def drop_table(table: DataFrame) -> None:
    """Delete a table made by :func:`write_table` that no later plan reads."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parents = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for parent in parents:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
