"""Sinks: tables, edges, annotation files and appends."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from celltable.functions.columns import rgb_to_int


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists", laid: bool = False) -> None:
    """One folder per slide, with few files each; patches stay sorted inside its files.

    A folder per patch would leave millions of tiny files at scale, so ``patch_id``
    remains a column, clustered for row-group skipping.  The edges of a slide are brought together first: otherwise
    every task writes a file into every folder; ``laid`` says that they are."""
    edges = edges if laid else edges.hint("rebalance", "slide_id")
    (edges.sortWithinPartitions("slide_id", "patch_id").write.mode(mode).partitionBy("slide_id").parquet(path))


def dictionary_json(dictionary: DataFrame) -> str:
    """The feature dictionary (one short row per column) as JSON text."""
    return json.dumps({r["feature"]: r["description"] for r in dictionary.collect()}, ensure_ascii=False, indent=2)


def to_qupath(nuclei: DataFrame, types: DataFrame, keep: list[str] = []) -> DataFrame:
    """x, y, class, name, color rows after the ``keep`` columns; an unknown type keeps its number as the name."""
    t = types.select(F.col("type_id").alias("type"), F.col("name").alias("_name"), rgb_to_int("r", "g", "b").alias("_color"))
    return (nuclei.join(t, "type", "left")
            .select(*keep, F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit("").alias("class"),
                    F.coalesce("_name", F.col("type").cast("string")).alias("name"), F.coalesce("_color", F.lit(-16777216)).alias("color")))


def write_qupath(rows: DataFrame, path: str, mode: str = "errorifexists", by: list[str] = []) -> None:
    """Tab-separated files, in a folder for each value of the ``by`` columns; few files a folder, a large one in several."""
    rows = rows.hint("rebalance", *by) if by else rows
    rows.write.mode(mode).partitionBy(*by).option("sep", "\t").option("header", True).csv(path)


def regroup(inventory: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Inventory or pixel rows laid out by key folders."""
    inventory.write.mode(mode).partitionBy(*keys).parquet(path)


def has_files(spark: SparkSession, path: str) -> bool:
    """Does the path hold anything?  A damaged table does, so reading it still fails aloud."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and len(files.listStatus(where)) > 0


def append_bags(df: DataFrame, path: str) -> None:
    """Append to a dataset; the schema must match what is there."""
    if has_files(df.sparkSession, path):
        have = df.sparkSession.read.parquet(path).schema
        want = {f.name: f.dataType.simpleString() for f in have.fields}
        got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        if want != got:
            raise ValueError(f"schema differs from the dataset: {got} against {want}")
    df.write.mode("append").parquet(path)


def upsert(base: DataFrame, new: DataFrame, key: str, ts: str, tie: str | None = None) -> DataFrame:
    """Newest record per key.  A struct maximum is combined map-side, so a key with very
    many versions needs no sort."""
    both = base.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, ts, tie)]
    lead = [c for c in (ts, tie) if c]
    top = both.groupBy(key).agg(F.max(F.struct(*lead, F.struct(*rest).alias("_r"))).alias("_m"))
    cols = {c: f"_m.{c}" for c in lead} | {c: f"_m._r.{c}" for c in rest}
    return top.select(key, *[F.col(cols[c]).alias(c) for c in both.columns if c != key])
