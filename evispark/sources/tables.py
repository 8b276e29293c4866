"""Parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.sources.shipping import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    ship(spark.sparkContext)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
