"""Parquet tables of one data folder."""

from pyspark.sql import DataFrame, SparkSession

from cadastra.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`: one Parquet file, or a folder of them, called `<name>.parquet`."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
