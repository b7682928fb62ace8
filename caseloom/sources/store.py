"""Run artefacts (splits, vocabularies, model tables) as Parquet tables under one folder per run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from caseloom.session import scratch_path


def save_tables(spark: SparkSession, tables: dict[str, DataFrame], run: str, path: str | None = None) -> str:
    """Write every table below ``path`` (a fresh scratch folder by default) with an index of names."""
    path = path or scratch_path(spark, f"run-{run}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, "tables", name))
    index = spark.createDataFrame([(n,) for n in tables], "name string")
    index.coalesce(1).write.mode("overwrite").json(os.path.join(path, "index"))
    return path


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in spark.read.schema("name string").json(os.path.join(path, "index")).collect()]
    return {n: spark.read.parquet(os.path.join(path, "tables", n)) for n in names}
