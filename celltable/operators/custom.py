"""User-supplied functions on groups and on row batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from celltable.operators.skew import in_blocks

GROUP_FUNCTIONS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    GROUP_FUNCTIONS[name] = fn


def apply_groups(df: DataFrame, keys: list[str], fn: str | Callable, schema: str, max_rows: int = 1_000_000) -> DataFrame:
    """A pandas function per group, given itself or by registered name.

    The function needs its whole group, so group sizes are checked first.  Small groups share a task call."""
    if isinstance(fn, str):
        fn = GROUP_FUNCTIONS[fn]
    worst = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if worst > max_rows:
        raise ValueError(f"a group has {worst} rows, more than {max_rows}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby(keys, sort=False, dropna=False)], ignore_index=True)

    return in_blocks(df, keys, run, schema)


def score_batches(df: DataFrame, vec: str, score: Callable[[np.ndarray], np.ndarray], keep: list[str],
                  batch: int = 64, out: str = "score") -> DataFrame:
    """Score vectors in batches; ``score`` maps (n, d) to n numbers and is loaded once per task."""
    types = dict(df.dtypes)

    def run(parts):
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                cut = pdf.iloc[i:i + batch]
                x = np.array(cut[vec].tolist(), dtype=float)
                yield cut[keep].assign(**{out: np.asarray(score(x), dtype=float)})

    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"{out} double"])
    return df.select(*keep, vec).mapInPandas(run, schema)
