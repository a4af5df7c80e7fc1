"""The tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in naive}) if naive else df
