"""Set operations, pairings and reader-study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from celltable.functions.columns import image_name
from celltable.operators.skew import row_index


def common(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def minus(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_anti")


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def match_images(a: DataFrame, b: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """Images of both sides by name; ``strict`` refuses names found on one side only."""
    if strict:
        lone = a.select(name, F.lit(1).alias("_a")).join(b.select(name, F.lit(1).alias("_b")), name, "full").filter(
            "_a is null or _b is null").take(5)
        if lone:
            raise ValueError(f"unmatched images, e.g. {[r[name] for r in lone]}")
    return a.join(b, name)


def parsed_inventory(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("_n", image_name(path)).filter(F.col("_n").isNotNull()).select("*", "_n.*").drop("_n")


def pair_modalities(inv: DataFrame, path: str = "path") -> DataFrame:
    """H&E and IF images of the same marker, source and number, each image once."""
    one = inv.groupBy("marker", "source", "idx", "kind").agg(F.min(path).alias("p"))
    side = lambda k: one.filter(F.col("kind") == k).select("marker", "source", "idx", F.col("p").alias(f"{k}_path"))
    return side("if").join(side("he"), ["marker", "source", "idx"])


def remaining(pool: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Items of the pool in none of the other tables."""
    for d in done:
        pool = pool.join(d.select(key).distinct(), key, "left_anti")
    return pool


def progress(records: DataFrame, pool: DataFrame, item: str, group: str = "marker") -> DataFrame:
    """Labelled and total items per group."""
    done = records.groupBy(group).agg(F.countDistinct(item).alias("labelled"))
    return (pool.groupBy(group).agg(F.countDistinct(item).alias("total")).join(done, group, "left")
            .select(group, F.coalesce("labelled", F.lit(0).cast("bigint")).alias("labelled"), "total"))


def chunk(df: DataFrame, keys: list[str], order: list[str], size: int = 500, split: bool | None = None) -> DataFrame:
    """Part number of each row: consecutive rows of a key in parts of ``size``."""
    return row_index(df, keys, order, "_i", split).withColumn("part", F.floor(F.col("_i") / size)).drop("_i")


def zip_sorted(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """i-th row of a beside the i-th row of b; the counts must agree."""
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"cannot pair {na} rows with {nb}")
    return row_index(a, [], order_a, "pos").join(row_index(b, [], order_b, "pos"), "pos")


def with_missing_stains(bags: DataFrame, slides: DataFrame, stains: list[str], dim: int) -> DataFrame:
    """Every slide has every stain; an absent one gets two zero rows."""
    want = slides.select("slide_id", F.explode(F.array(*[F.lit(s) for s in stains])).alias("stain"))
    lost = want.join(bags.select("slide_id", "stain").distinct(), ["slide_id", "stain"], "left_anti")
    zero = lost.withColumn("patch_ix", F.explode(F.expr("array(0L, 1L)")))
    zero = zero.withColumn("feature", F.array_repeat(F.lit(0.0).cast("float"), dim))
    return bags.select("slide_id", "stain", "patch_ix", "feature").unionByName(zero)
