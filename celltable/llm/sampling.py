"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAIN = 1 << 30


def uniform(*seed) -> Column:
    """A number in [0, 1) drawn from the given columns and constants."""
    return F.pmod(F.xxhash64(*[s if isinstance(s, Column) else F.lit(s) for s in seed]), F.lit(GRAIN)) / float(GRAIN)


def balanced(df: DataFrame, label: str, most: int, key: Column, seed: int = 0) -> tuple[DataFrame, dict]:
    """About ``most`` rows of every label, picked by a hash of the key, and the share taken of each label.

    One count per label decides the shares; the result is held to twice the expected size."""
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df.limit(0), {}
    share = {k: min(1.0, most / n) for k, n in counts.items()}
    chance = F.lit(0.0)
    for k, s in share.items():
        chance = F.when(F.col(label) == F.lit(k), F.lit(s)).otherwise(chance)
    return df.filter(uniform(key, seed) < chance).limit(2 * most * len(counts)), share
