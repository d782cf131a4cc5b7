"""Given tables and small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "shared_folder", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
