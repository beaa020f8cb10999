"""Delimited measurement files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_measurements(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """``;``-separated file with a header; the schema is given, so the data is read once."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_measurements(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
