"""Readers of tables and files, with time zones settled at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column without a zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``us``, the microseconds of ``ts`` since 1970."""
    return table(spark, sf_dir, "events").withColumn("us", micros("ts"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a folder of text files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows with a declared schema; a row that does not parse is null in every column."""
    return spark.read.schema(schema).json(path)


def quarantined_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of a folder of JSON lines with a declared schema; ``broken`` (path, line) holds what does not fit it, whole."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_path", F.col("_metadata.file_path"))
    rows = written(rows, "json")  # a query of the corrupt column alone would not parse the rows
    return rows.where("_corrupt is null").drop("_corrupt", "_path"), rows.where("_corrupt is not null").select(F.col("_path").alias("path"), F.col("_corrupt").alias("line"))


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
