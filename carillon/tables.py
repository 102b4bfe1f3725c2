"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a file and a folder of part files read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
