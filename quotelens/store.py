"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on one machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quotelens-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quotelens/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: its lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Give a folder another name; whether it has it now. It doesn't take a name that another one has."""
    (old, files), (new, _) = _at(spark, source), _at(spark, target)
    return not files.exists(new) and files.rename(old, new)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(table.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has materialized, those that results still read too: for when they have been written."""
    delete(spark, _own(spark))
