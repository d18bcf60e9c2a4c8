"""Readers, writers and seeded synthetic tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table by the ending of its path; CSV has a header and needs a schema, so that no pass goes to guessing."""
    kind = next((f for f in FORMATS if path.rstrip("/").endswith(f)), "parquet")
    if kind == "csv" and schema is None:
        raise ValueError("a CSV file needs a schema")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    kind = next((f for f in FORMATS if path.rstrip("/").endswith(f)), "parquet")
    writer = df.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {}))
    (writer.partitionBy(*partition) if partition else writer).save(path)


def save_state(state: DataFrame, path: str) -> None:
    """Fitted state (an encoder's codes, a cohort's statistics, a curve) as a table; never a pickle."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """State that ``save_state`` wrote; the transforms of ``operators.encoding`` take it as they take a fresh fit."""
    return spark.read.parquet(path)


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or on a local master a folder of this session's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.wfspark.work", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wfspark-")
        spark.conf.set("spark.wfspark.work", folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The frame checkpointed in the work folder: an iteration's lineage ends there."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(work_folder(spark))
    return df.checkpoint()


def labour_panel(spark: SparkSession, stores: int = 10, departments: int = 4, weeks: int = 104, seed: int = 42) -> DataFrame:
    """Store x department x week: headcount, hours, turnover."""
    rows = spark.range(stores * departments * weeks)
    unit = F.floor(F.col("id") / weeks)
    work = rows.select((unit / departments).cast("int").alias("store"), (unit % departments).cast("int").alias("dept"), (F.col("id") % weeks).cast("int").alias("week"), F.rand(seed).alias("u"), F.randn(seed + 1).alias("z"))
    head = (20 + 5 * F.col("dept") + F.round(3 * F.col("z"))).cast("bigint")
    return work.select(F.format_string("STORE_%03d", "store").alias("store_id"), F.format_string("DEPT_%02d", "dept").alias("dept_id"), F.col("week").cast("bigint").alias("week"), head.alias("headcount"), (head * (32 + 8 * F.col("u"))).alias("assigned_hours"), F.floor(F.col("u") * 4).alias("turnover_count"))


def roster(spark: SparkSession, n: int = 2500, seed: int = 42) -> DataFrame:
    """One row an employee: store, department, tenure, overtime, whether they left."""
    u = [F.rand(seed + k) for k in range(5)]
    return spark.range(n).select(
        F.format_string("EMP_%05d", "id").alias("employee_id"), F.format_string("STORE_%03d", F.floor(u[0] * 50).cast("int")).alias("store_id"), F.format_string("DEPT_%02d", F.floor(u[1] * 8).cast("int")).alias("dept_code"),
        (1 + F.floor(u[2] * 260)).alias("tenure_weeks"), (u[3] * 12).alias("weekly_overtime_hours"), (u[4] < 0.2).cast("bigint").alias("turnover_event"),
    )
