"""Runs of experiments in, reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "tracks array<struct<path string, vector array<float>>>, neighbors array<struct<query bigint, items array<struct<index bigint, path string, score double>>>>"


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A run's documents as ``(pos, path, vector)`` and ``(query, rank, index, path, score)``."""
    run = spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)
    tracks = run.select(F.posexplode("tracks").alias("pos", "t")).select(F.col("pos").cast("bigint").alias("pos"), "t.path", "t.vector")
    near = run.select(F.explode("neighbors").alias("n")).select("n.query", F.posexplode("n.items").alias("r", "i")).select("query", (F.col("r") + 1).alias("rank"), "i.index", "i.path", "i.score")
    return tracks, near


def csv_field(c: Column) -> Column:
    """A field for CSV: quoted only where it holds a comma, a quote or a line's end; quotes are doubled."""
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: each row as one CSV line, in the order of the columns."""
    return df.select(F.concat_ws(",", *(csv_field(F.col(c).cast("string")) for c in df.columns)).alias("line"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, JSON lines or Parquet, written by all tasks."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(kind)
