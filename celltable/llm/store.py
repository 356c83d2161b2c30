"""Shared folder for intermediate tables, read from the session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F


def ready(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; without one, fail by name."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ready(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A table that grows with the corpus: joins with it are sorted merges and never go through the driver, however low Spark sizes it."""
    return df.hint("merge")


def with_own(df: DataFrame, *needed: str) -> DataFrame:
    """Every row as one struct ``own`` beside the columns that an operator needs, so that no name can clash."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("own"), *[F.col(c) for c in needed])


def quoted(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
