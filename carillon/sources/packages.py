"""Discovery of packages in folders, and reading of their manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carillon.operators.flatten import MANIFEST_GROUPS, flatten

# What one scan may find at most.
MOST_DEPTH, MOST_OBJECTS, MOST_PACKAGES, MOST_PATH_BYTES = 64, 100_000, 10_000, 64 * 2**20


def kind_of(path: Column) -> Column:
    """container, manifest, or other, by name."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.endswith(".mpack") | name.endswith(".mpak"), F.lit("container")).when(name.endswith("manifest.json"), F.lit("manifest")).otherwise(F.lit("other"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified``: all files below ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def write_files(cells: DataFrame, root: str) -> None:
    """Cells (``path, content``) as files below a folder, each by the task that holds it, through the session's file systems."""
    from pyarrow import fs

    def run(batches):
        for b in batches:
            base, at = fs.FileSystem.from_uri(root)
            for path, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                base.create_dir(f"{at}/{path}".rsplit("/", 1)[0], recursive=True)
                with base.open_output_stream(f"{at}/{path}") as out:
                    out.write(bytes(body))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    cells.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def over_limits(files: DataFrame) -> DataFrame:
    """``limit, found``: the limits that a listing exceeds; none if the scan may go on."""
    got = files.agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(kind_of(F.col("path")) != "other").alias("packages"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("path_bytes"), F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(0)).alias("depth"))
    most = {"objects": MOST_OBJECTS, "packages": MOST_PACKAGES, "path_bytes": MOST_PATH_BYTES, "depth": MOST_DEPTH}
    rows = F.array(*(F.struct(F.lit(k).alias("limit"), F.col(k).cast("bigint").alias("found"), F.lit(v).cast("bigint").alias("_most")) for k, v in most.items()))
    return got.select(F.inline(rows)).where("found > _most").select("limit", "found")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``path, manifest, sha256, valid``: every manifest below ``root`` with the digest of its bytes and whether it can be read as
    a whole with media in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*manifest.json").load(root)
    text = files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("manifest"), F.sha2("content", 256).alias("sha256"))
    good = flatten(text, "path", "manifest", MANIFEST_GROUPS, "media").select(F.col("rec_id").alias("path")).distinct().withColumn("_v", F.lit(True))
    return text.join(good, "path", "left").select("path", "manifest", "sha256", F.coalesce("_v", F.lit(False)).alias("valid"))


def count_by_extension(files: DataFrame) -> DataFrame:
    """``ext, n``: files per extension in lower case."""
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
