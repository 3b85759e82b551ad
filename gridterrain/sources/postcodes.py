"""Postcode files, their heading contract and the load chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridterrain.operators.quality import key_violations
from gridterrain.schemas import HEADER_LONG, HEADER_SHORT, RAW_POSTCODE, SCANNED_COLUMNS


# Names of the postcode files in an archive.
DATA_ENTRY = r"^Data/CSV/[^/]+\.csv$"


def area_of_file(path: Column) -> Column:
    """Area of a file named after it (``ng.csv``), or of part files below such a folder."""
    return F.upper(F.regexp_extract(path, r"([^/=]+)\.csv(?:/[^/]*)?$", 1))


def as_scanned(raw: DataFrame, path: Column) -> DataFrame:
    """Rename, add the area, drop the NHS columns, order the rest."""
    return (
        raw.withColumn("Postcode_area", area_of_file(path))
        .withColumnRenamed("Positional_quality_indicator", "Quality")
        .select(*SCANNED_COLUMNS)
    )


def scan_postcode_files(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` files of the folder as one distributed scan; other files are left alone."""
    raw = spark.read.schema(RAW_POSTCODE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    return as_scanned(raw, F.col("_metadata.file_path"))


def postcodes_from_lines(lines: DataFrame) -> DataFrame:
    """S1 on lines ``(entry, line)`` of archive entries; empty lines are left out."""
    parsed = lines.filter(F.length("line") > 0).select("entry", F.from_csv("line", _ddl(RAW_POSTCODE)).alias("r"))
    return as_scanned(parsed.select("entry", "r.*"), F.col("entry"))


# Holds the text of a row that does not have the fields of the format.
_MALFORMED = "_malformed"
_CHECKED = StructType([*RAW_POSTCODE.fields, StructField(_MALFORMED, StringType())])
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _ddl(schema: StructType) -> str:
    return schema.simpleString()[len("struct<"):-1].replace(":", " ")


def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the folder's files that do not have ten fields of the right types: ``(file, reason, line)``.

    Scans show what can be read of such rows, null where nothing can.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
    return malformed_lines(lines.select(F.col("_metadata.file_path").alias("entry"), F.col("value").alias("line")))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """The same of lines ``(entry, line)``: another number of fields, or a value of another type."""
    parsed = F.from_csv("line", _ddl(_CHECKED), {"columnNameOfCorruptRecord": _MALFORMED})[_MALFORMED]
    fields = F.size(F.split("line", _COMMA))
    reason = F.when(fields < len(RAW_POSTCODE), "too few fields").when(fields > len(RAW_POSTCODE), "too many fields").otherwise("value")
    return lines.filter((F.length("line") > 0) & parsed.isNotNull()).select(F.col("entry").alias("file"), reason.alias("reason"), "line")


def as_faults(malformed: DataFrame) -> DataFrame:
    """Malformed rows as faults ``(check, subject, cases)``."""
    subject = F.concat_ws(" ", "file", "reason", "line")
    return malformed.select(F.lit("row").alias("check"), subject.alias("subject"), F.lit(1).cast("bigint").alias("cases"))


def header_faults(files: DataFrame) -> DataFrame:
    """Heading files ``(path, text)`` whose first two lines are not the expected names."""
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")

    def names(number: int) -> Column:
        line = F.coalesce(F.get(lines, F.lit(number)), F.lit(""))
        return F.transform(F.split(line, ","), lambda v: F.trim(v))

    short = F.array(*[F.lit(v) for v in HEADER_SHORT])
    long = F.array(*[F.lit(v) for v in HEADER_LONG])
    fault = F.when(names(0) != short, "line 1").when(names(1) != long, "line 2")
    return files.select("path", fault.alias("fault")).filter(F.col("fault").isNotNull())


def read_header_file(spark: SparkSession, path: str) -> DataFrame:
    """A heading file as ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def load_postcode_folder(spark: SparkSession, folder: str, header_file: str) -> tuple[DataFrame, DataFrame]:
    """S3: scanned table and its faults ``(check, subject, cases)``; no faults means it may be used."""
    scanned = scan_postcode_files(spark, folder)
    headings = header_faults(read_header_file(spark, header_file)).select(
        F.lit("heading").alias("check"), F.concat_ws(" ", "path", "fault").alias("subject"), F.lit(1).cast("bigint").alias("cases")
    )
    keys = key_violations(scanned, "Postcode").select(
        F.lit("key").alias("check"), F.col("key_value").alias("subject"), "cases"
    )
    return scanned, headings.unionByName(keys).unionByName(as_faults(malformed_rows(spark, folder)))
