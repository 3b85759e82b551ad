"""Intermediate tables in the cluster's shared checkpoint folder.

Lineage is cut by writing Parquet to the folder named by ``spark.checkpoint.dir`` and reading it
back: the columns stay prunable, the size is known to the optimiser, and a lost executor costs
nothing but a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; below the warehouse where none is set."""
    root = spark.conf.get(_CHECKPOINT_DIR, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/gridterrain/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return the re-read table and its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` with its lineage replaced by a written table."""
    return materialise(df, label)[0]


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop knows them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target, store = hadoop_path(spark, path)
    store.delete(target, True)
