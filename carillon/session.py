"""Session factory and the written stages that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def build_session(app: str = "carillon", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on. Settings a cluster already makes are left alone."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once: they need not have it installed or run in its folder."""
    sc = spark.sparkContext
    if _OWN.get("shipped") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="carillon-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/carillon_code.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(f"{folder}/carillon_code.zip")
    _OWN["shipped"] = sc.applicationId


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where that is unset (tests, local runs) one of our own."""
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    if "local" not in _OWN:
        _OWN["local"] = tempfile.mkdtemp(prefix="carillon-")
        atexit.register(shutil.rmtree, _OWN["local"], ignore_errors=True)
    return "file://" + _OWN["local"]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written stage."""
    return f"{checkpoint_dir(spark)}/carillon/{uuid.uuid4().hex}-{name}"


def stage(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation, and the plan starts anew.
    ``folders``: columns by whose values the rows are laid in folders, so that a filter on them reads no others."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*folders) if folders else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one written stage that no later result reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer thinks a result's size is at most, told without a job: that of its inputs, or more after joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def width(spark: SparkSession) -> int:
    """Tasks that keep all cores busy in a step whose work isn't seen from its bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that comes in fewer parts than there are cores, dealt out over them before costly work a row; a scan in many parts,
    as every large table is, stays as it is and isn't shuffled. Only for plans without a shuffle of their own."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


class StageLog:
    """Stages of one computation; ``close(keep=...)`` deletes those that the final result doesn't read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = stage_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((path, out))
        return out

    def drop(self, df: DataFrame) -> None:
        for path, out in self.paths:
            if out is df:
                drop_path(self.spark, path)
        self.paths = [(p, o) for p, o in self.paths if o is not df]

    def close(self, *keep: DataFrame) -> None:
        for path, out in self.paths:
            if not any(out is k for k in keep):
                drop_path(self.spark, path)
