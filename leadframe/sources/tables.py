"""Parquet tables of the lake, one file or folder per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str | Column) -> DataFrame:
    """Scan ``root/name.parquet``; with ``columns`` only those reach the reader."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
