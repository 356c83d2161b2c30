"""Named queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``fn(v) -> DataFrame`` where ``v`` is a Views object."""
    from celltable.plans.views import Views

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        COVERS[name] = covers.split()
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def r6(df: DataFrame, *cols: str, scale: str = "1e6") -> DataFrame:
    """Round doubles to six decimals with plain arithmetic (all double columns by default)."""
    cols = cols or tuple(c for c, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({c: F.expr(f"floor(`{c}` * {scale} + 0.5) / {scale}") for c in cols})


def sql_r6(body: str, cols: list[str], scale: str = "1e6") -> str:
    """The same rounding on the SQL side."""
    rep = ", ".join(f'floor("{c}" * {scale} + 0.5) / {scale} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) AS rounded_input"
