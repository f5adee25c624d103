"""Parquet tables of a folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Loads `name` from folder/name.parquet: t("orders"), t.orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return self(name)
