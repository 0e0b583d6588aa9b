"""Sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions.metrics import json_map

RESPONSE_CACHE = "cache_key STRING, request_type STRING, task_name STRING, doc_id BIGINT, idx INT, gen_kwargs STRING, response STRING, created_at DOUBLE"
AUDIT_LOG = RESPONSE_CACHE + ", deterministic BOOLEAN"


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for work that costs more than reading it.

    A small table of one file is one split, so one task would do all of that
    work: its rows are dealt to as many tasks as run at once.  A table of as
    many splits as that, as any large one is, is read as it lies.
    """
    rows, tasks = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE_CACHE).parquet(path)


def read_frame_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``mask_idx frame_idx``; comments and broken lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return rows.select(F.get(parts, 0).try_cast("int").alias("mask_idx"), F.get(parts, 1).try_cast("int").alias("frame_idx")).dropna()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Depth frames with arrays by pixel."""
    schema = "scene_id STRING, frame STRING, h INT, w INT, depth ARRAY<FLOAT>, conf ARRAY<FLOAT>, mask ARRAY<INT>, k ARRAY<DOUBLE>, c2w ARRAY<DOUBLE>"
    return spark.read.schema(schema).parquet(path)


def parameter_table(spark: SparkSession, values: dict[str, float], value: str = "eps") -> DataFrame:
    """Small table of a parameter by category."""
    return spark.createDataFrame(sorted(values.items()), f"category string, {value} double")


def write_samples(samples: DataFrame, path: str, task: str = "task") -> None:
    """Sample log as JSON lines, one folder per task; nested columns become
    JSON text and ``resps`` goes where ``filtered_resps`` repeats it."""
    nested = {f.name: F.to_json(f.name) for f in samples.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    rows = samples.withColumns(nested)
    if {"resps", "filtered_resps"} <= set(rows.columns):
        rows = rows.withColumn("resps", F.when(~F.col("resps").eqNullSafe(F.col("filtered_resps")), F.col("resps")))
    rows.write.partitionBy(task).json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)


def write_submission(df: DataFrame, path: str, key: str, answer: str) -> None:
    """Benchmark submission: id and answer."""
    df.select(key, F.col(answer).alias("answer")).write.json(path)


def write_training_set(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append every response, valid or not, to the audit log."""
    df.write.mode("append").json(path)


def wide_samples(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per sample with the metrics as columns."""
    return scores.groupBy(*keys).pivot("metric", metrics).agg(F.first("score"))


def props(column: str):
    """A JSON object column as a map."""
    return json_map(column)
