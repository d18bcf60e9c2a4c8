"""Tables, and the shared folder that stages are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of this session's own on a local master; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wfspark-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, lost executors cost no recomputation,
    and the shuffles behind it may go (see ``settled_jobs``). The table goes with ``discard``, or else when the driver ends. ``light``: what follows the
    last shuffle is little work, so its partitions are joined up to the advisory size even if fewer tasks than cores are left; a small table is then one file."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wfspark-{name}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    with settled_jobs(spark, light):
        df.write.parquet(path)
    files.deleteOnExit(where)
    out = spark.read.parquet(path)
    out._shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them any more."""
    for df in frames:
        where, files = _file_system(df.sparkSession, df._shared_path)
        files.delete(where, True)


class settled_jobs:
    """While it holds, shuffle files of a finished job are removed at its end, so that the disk holds one step's; with ``light``, small partitions are
    joined up."""

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"

    def __init__(self, spark: SparkSession, light: bool = False):
        self.spark = spark
        self.wanted = {self.CLEAN: "true"} | ({self.SPREAD: "false"} if light else {})

    def __enter__(self) -> None:
        self.before = {key: self.spark.conf.get(key, None) for key in self.wanted}
        for key, value in self.wanted.items():
            self.spark.conf.set(key, value)

    def __exit__(self, *_: object) -> None:
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
