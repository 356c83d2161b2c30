"""Embedding tables: means, moments, distances and contrastive scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from celltable.functions.columns import cosine


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "feature", out: str = "feature") -> DataFrame:
    """Mean vector per group; partial means are combined before the shuffle."""
    v = array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double")))
    g = df.withColumn("_v", v).groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"),
                                                   F.count(F.lit(1)).alias("n_members"))
    return g.select(*keys, vector_to_array("_m").alias(out), "n_members")


def gram(df: DataFrame, vec: str = "feature") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sum and second-moment matrix.  Each task sends one d x d partial per
    partition; partials are added element-wise on Spark and only the d x d result
    (never rows) reaches the driver."""
    def part(it):
        n, s, g = 0, None, None
        for pdf in it:
            x = np.array(pdf["v"].tolist(), dtype=float)
            if len(x) == 0:
                continue
            n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            d = len(s)
            yield pd.DataFrame({"i": np.arange(d), "n": n, "s": s, "row": list(g)})

    parts = df.select(F.transform(F.col(vec), lambda x: x.cast("double")).alias("v")).mapInPandas(
        part, "i int, n bigint, s double, row array<double>")
    rows = (parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"),
                                   Summarizer.sum(array_to_vector("row")).alias("row"))
            .orderBy("i").collect())
    if not rows:
        raise ValueError("no vectors")
    return rows[0]["n"], np.array([r["s"] for r in rows]), np.array([r["row"].toArray() for r in rows])


def moments(df: DataFrame, vec: str = "feature") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance; fewer than two rows give the identity."""
    n, s, g = gram(df, vec)
    mu = s / n
    return mu, (g - n * np.outer(mu, mu)) / (n - 1) if n > 1 else np.eye(len(mu))


def frechet_from_moments(mu1, c1, mu2, c2, eps: float = 1e-6) -> float:
    """Squared mean gap plus the trace term, on d x d matrices only."""
    def trace_root(a, b):
        lam, u = np.linalg.eigh(a)
        half = (u * np.sqrt(np.clip(lam, 0, None))) @ u.T
        return np.sqrt(np.clip(np.linalg.eigvalsh(half @ b @ half), 0, None)).sum()

    t = trace_root(c1, c2)
    if not np.isfinite(t):
        e = np.eye(len(mu1)) * eps
        t = trace_root(c1 + e, c2 + e)
    return float(((mu1 - mu2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * t)


def frechet(a: DataFrame, b: DataFrame, vec: str = "feature") -> float:
    return frechet_from_moments(*moments(a, vec), *moments(b, vec))


def smooth_rank(df: DataFrame, vec: str = "feature", eps: float = 1e-7) -> float:
    """exp(entropy) of the normalised singular values, two decimals."""
    _, _, g = gram(df, vec)
    s = np.sqrt(np.clip(np.linalg.eigvalsh(g), 0, None))
    p = s / s.sum() + eps
    return round(float(np.exp(-(p * np.log(p)).sum())), 2)


def info_nce(df: DataFrame, batch: str, item: str, query: str, positive: str, temperature: float = 0.1,
             symmetric: bool = False, batch_size: int = 256) -> DataFrame:
    """Contrastive loss per batch: positives on the diagonal, other rows of the batch negative.

    A batch is a training batch of at most ``batch_size`` rows (checked); a batch of
    one row has no negatives and loss zero."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    too_big = F.raise_error(F.lit(f"a batch has more than {batch_size} rows")).cast("boolean")
    ok = sizes.filter(F.when(F.col("_n") <= batch_size, F.lit(True)).otherwise(too_big))
    d = df.join(ok.select(batch), batch, "left_semi")
    q = d.select(batch, F.col(item).alias("i"), F.col(query).alias("q"))
    p = d.select(batch, F.col(item).alias("j"), F.col(positive).alias("p"))
    s = q.join(p, batch).select(batch, "i", "j", (cosine("q", "p", 1e-12) / temperature).alias("s"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("s")))

    def loss(side: str) -> DataFrame:
        # cosine is at most one, so subtracting 1/T keeps every exponent at or below zero
        lse = F.log(F.sum(F.exp(F.col("s") - 1.0 / temperature))) + 1.0 / temperature
        return (s.groupBy(batch, side).agg((lse - own).alias("l"))
                .groupBy(batch).agg(F.avg("l").alias(f"loss_{side}")))

    out = loss("i")
    if symmetric:
        return out.join(loss("j"), batch).select(batch, ((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"))
    return out.withColumnRenamed("loss_i", "loss")
