"""The persisted postcode table and its CSV export."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridterrain.scratch import hadoop_path, release


# The file that names a table's current version, and how many versions stay for readers that have begun.
POINTER, VERSIONS = "_current", 2


def save_table(df: DataFrame, path: str) -> None:
    """Store the table, clustered by area so that area filters skip row groups.

    A version is written beside the former ones and then published by one renamed pointer file, so a job that fails
    leaves the former table, and a table can be built from itself. Versions before the last ``VERSIONS`` are deleted. A table has one writer at a time.
    """
    spark = df.sparkSession
    by = [c for c in ("Postcode_area", "Postcode") if c in df.columns]
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
    (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.parquet(f"{path}/{version}")
    _publish(spark, path, version)
    folder, store = hadoop_path(spark, path)
    older = sorted(name for name in (f.getPath().getName() for f in store.listStatus(folder)) if name.startswith("v") and name <= version)
    for name in older[:-VERSIONS]:
        release(spark, f"{path}/{name}")


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the current one in a single step."""
    jvm = spark.sparkContext._jvm
    draft, store = hadoop_path(spark, f"{path}/_{version}")
    out = store.create(draft)
    out.write(version.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(draft.makeQualified(store.getUri(), store.getWorkingDirectory()), hadoop_path(spark, f"{path}/{POINTER}")[0].makeQualified(store.getUri(), store.getWorkingDirectory()), options)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Path of a table's current version; none if there is no table."""
    pointer, store = hadoop_path(spark, f"{path}/{POINTER}")
    if not store.exists(pointer):
        return None
    raw = store.open(pointer)
    name = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(raw)
    raw.close()
    return f"{path}/{bytes(name).decode()}"


def load_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read the table's current version; a missing table is an empty one."""
    version = current_version(spark, path)
    return spark.read.parquet(version) if version else spark.createDataFrame([], schema)


def csv_path(out_dir: str, area: str = "all") -> str:
    """Name of an export."""
    return f"{out_dir}/postcodes.{area.lower()}.csv"


def export_csv(df: DataFrame, out_dir: str, area: str | None = None) -> int:
    """Write the whole table, or one area, as CSV with headings.

    Returns 0, or 1 without writing when there is nothing to write. Only ``all`` in lower case means
    every area. The export is a folder of part files.
    """
    area = "all" if area is None else area
    rows = df if area == "all" else df.filter(F.col("Postcode_area") == area.upper())
    if area != "all" and rows.isEmpty():
        return 1
    rows.write.mode("overwrite").option("header", True).csv(csv_path(out_dir, area))
    return 0
