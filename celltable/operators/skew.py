"""Order statistics and running totals that survive a hot key.

A group may hold any share of the rows.  Each helper first measures the
largest group (one narrow aggregate).  While every group fits the limit a
plain window or the built-in ``percentile`` runs.  Otherwise the rows are
range-partitioned by (keys, order), so a hot key spreads over many tasks, and
per-partition totals (a few rows per key) supply the offsets.  For quantiles the
rows move once, in sorted slices of a key, and a few values of each slice follow.
Both ways give the same exact answer.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from celltable.functions.columns import col

GROUP_LIMIT = 1_000_000
LIMIT_KEY = "spark.celltable.maxGroupRows"


def group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_KEY, str(GROUP_LIMIT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; an error by name without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by spark.checkpoint.dir."""
    folder, sc = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table beside the checkpoints; for rows with long ids, of which a checkpoint takes several times the space."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path).hint("merge")


def in_blocks(df: DataFrame, keys: list[str], fn, schema: str, rows: int = 20_000) -> DataFrame:
    """``fn`` on pandas tables that hold whole groups, about ``rows`` rows of many small groups together.

    A call for each small group would cost more than its work; the groups must fit one task."""
    blocks = max(1, df.count() // rows)
    return (df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).groupBy("_block")
            .applyInPandas(lambda pdf: fn(pdf.drop(columns="_block")), schema))


def in_groups(df: DataFrame, keys: list[str], fn, schema: str, rows: int = 20_000) -> DataFrame:
    """As ``in_blocks`` for rows that lie together by the keys already, or by some of them: nothing moves."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    shape = to_arrow_schema(T._parse_datatype_string(schema))

    def call(held: list[pa.Table]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(fn(pa.concat_tables(held).to_pandas()), schema=shape, preserve_index=False)

    def run(batches):
        held, n = [], 0
        for b in batches:
            ends = np.cumsum(b["_rows"].value_lengths().to_numpy())
            cuts = np.searchsorted(ends, np.arange(rows, ends[-1], rows)) + 1 if len(ends) else []
            cuts = np.unique(np.concatenate([[0], cuts, [len(ends)]])).astype(int)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                lists = b["_rows"].slice(lo, hi - lo)
                at = pa.array(np.repeat(np.arange(lo, hi), lists.value_lengths().to_numpy()))
                flat = lists.flatten()
                held.append(pa.table([*(b[k].take(at) for k in keys), *(flat.field(i) for i in range(len(rest)))], names=[*keys, *rest]))
                n += len(at)
                if n >= rows:
                    yield call(held)
                    held, n = [], 0
        if n:
            yield call(held)

    return packed.mapInArrow(run, schema)


def group_rows(pdf: pd.DataFrame, keys: list[str]) -> list[np.ndarray]:
    """Row positions of each group of a table, in row order; NULL is a key."""
    code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL; the key columns are those of the left side."""
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
    return left.join(right.withColumnsRenamed(names), match, how).drop(*names.values())


def has_hot_group(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    limit = group_limit(df) if limit is None else limit
    if df.count() <= limit:
        return False
    if not keys:
        return True
    # a hash is shorter to move than the keys; groups whose hashes are equal only count as one
    return not df.groupBy(F.xxhash64(*keys).alias("_key")).count().filter(F.col("count") > limit).isEmpty()


def prefix_agg(df: DataFrame, keys: list[str], order: list, value: Column | str, out: str,
               how: str = "sum", split: bool | None = None) -> DataFrame:
    """Running sum or max per key in the given order, current row included.

    ``split`` forces (True) or forbids (False) the range-partitioned way; None
    measures the groups.  ``order`` should be unique inside a key.  A NULL key is a
    key; a NULL amount counts as none, and a row with only NULLs up to it gets NULL."""
    fn, join = {"sum": (F.sum, lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))),
                "max": (F.max, lambda a, b: F.greatest(a, b))}[how]
    if split is None:
        split = has_hot_group(df, keys)
    order = [col(o) for o in order]
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, fn(col(value)).over(w))
    laid = (df.withColumn("_amount", col(value))
            .repartitionByRange(*[F.col(k) for k in keys], *order)
            .withColumn("_slice", F.spark_partition_id()))
    laid = stable(laid)
    w_off = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (laid.groupBy(*keys, "_slice").agg(fn("_amount").alias("_part"))
               .withColumn("_before", fn("_part").over(w_off)).drop("_part"))
    w_in = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (join_same(laid.withColumn(out, fn("_amount").over(w_in)), offsets, [*keys, "_slice"])
            .withColumn(out, join(F.col(out), F.col("_before")))
            .drop("_amount", "_slice", "_before"))


def row_index(df: DataFrame, keys: list[str], order: list, out: str = "idx",
              split: bool | None = None) -> DataFrame:
    """0-based position inside each key."""
    return (prefix_agg(df, keys, order, F.lit(1).cast("bigint"), out, split=split)
            .withColumn(out, F.col(out) - 1))


def avg_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank",
             split: bool | None = None) -> DataFrame:
    """1-based rank inside each key, ties averaged; NULL values get no rank.

    Equal values are counted first, so the ordered step sees distinct values."""
    peers = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
             .agg(F.count(F.lit(1)).alias("_peers")))
    ranked = prefix_agg(peers, keys, [value], "_peers", "_cum", split=split)
    ranked = ranked.select(*keys, value, (F.col("_cum") - F.col("_peers")
                                          + (F.col("_peers") + 1) / 2.0).alias(out))
    return join_same(df, ranked, [*keys, value], "left")


def quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float],
              split: bool | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: one array column ``<c>_q`` per input column."""
    if split is None:
        split = has_hot_group(df, keys)
    if not split:
        # every group fits one task, so plain rows are shuffled once and both aggregation
        # steps run behind that shuffle; partial value maps would be larger than the rows
        arr = [float(p) for p in probs]
        return df.select(*keys, *cols).repartition(*keys).groupBy(*keys).agg(*[F.percentile(F.col(c), arr).alias(f"{c}_q") for c in cols])
    d, slices, short = sliced(df, keys, cols)
    return from_slices(d, keys, cols, probs, slices, short)


SLICE_ROWS, GUIDES, CALL_ROWS = 100_000, 1024, 100_000


def sliced(df: DataFrame, keys: list[str], cols: list[str]) -> tuple[DataFrame, int, bool]:
    """Sorted arrays of the columns' values, one row per key and slice; the number of slices a key is dealt over (at least
    four), and whether no slice can hold more than GUIDES values.

    Slices follow the values and the input partition, so neither a hot key nor a hot row gathers in one."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    slices = max(4, -(-top // SLICE_ROWS))
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    d = d.withColumn("_slice", F.pmod(F.xxhash64(*cols) + F.spark_partition_id(), F.lit(slices)).cast("int"))
    d = d.repartition(*keys, "_slice").groupBy(*keys, "_slice").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in cols])
    return (d, slices, True) if top <= GUIDES else (stored(d), slices, False)


def from_slices(d: DataFrame, keys: list[str], cols: list[str], probs: list[float], slices: int, short: bool) -> DataFrame:
    """Quantiles ``<c>_q`` of keys whose values lie in sorted slices.

    Every slice names evenly spaced values, all of them if they are few.  What they say together is the quantile itself, or
    two values that enclose it; in that case the slices hand over what lies between, and the number of values below."""
    if not keys:
        one = d.sparkSession.range(1).select(F.lit(0).alias("_all"))
        found = from_slices(d.withColumn("_all", F.lit(0)), ["_all"], cols, probs, slices, short)
        return join_same(one, found, ["_all"], "left").drop("_all")
    most = max(64, min(GUIDES, 500_000 // slices))
    guides = []
    for c in cols:
        step = F.lit(1).cast("bigint") if short else F.greatest(F.lit(1), F.ceil(F.size(c) / most)).cast("bigint")
        some = F.col(c) if short else F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.size(c).cast("bigint") - 1, step), lambda i: F.get(c, i.cast("int")))).otherwise(F.col(c))
        guides += [some.alias(f"{c}_v"), step.alias(f"{c}_s"), F.size(c).cast("bigint").alias(f"{c}_n")]
    rows = d.select(*keys, *guides)
    blocks = max(1, int(rows.agg(F.sum(F.size(f"{cols[0]}_v"))).first()[0] or 0) // CALL_ROWS)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema)
    kind += ", _open boolean" + "".join(f", `{c}_q` array<double>, `{c}_lo` array<double>, `{c}_hi` array<double>, `{c}_n` bigint" for c in cols)
    guess = (rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).groupBy("_block")
             .applyInArrow(lambda t: enclosed(t, keys, cols, probs), kind))
    wanted = [*keys, *[f"{c}_q" for c in cols]]
    if short:
        return guess.select(*wanted)
    guess = stored(guess)
    parts = F.array(*[F.struct(F.lit(c).alias("_var"), F.lit(i).alias("_i"), ((F.col(f"{c}_n") - 1) * F.lit(float(p))).alias("_at"),
                               F.size(F.filter(c, lambda x: x < F.col(f"{c}_lo")[i])).cast("bigint").alias("_below"),
                               F.filter(c, lambda x: x.between(F.col(f"{c}_lo")[i], F.col(f"{c}_hi")[i])).alias("_mid"))
                      for c in cols for i, p in enumerate(probs)])
    found = (join_same(d, guess.filter("_open"), keys).select(*keys, F.inline(parts)).groupBy(*keys, "_var", "_i")
             .agg(F.max("_at").alias("_at"), F.sum("_below").alias("_below"), F.sort_array(F.flatten(F.collect_list("_mid"))).alias("_mid")))
    lo, hi = (F.get("_mid", (f("_at") - F.col("_below")).cast("int")) for f in (F.floor, F.ceil))
    found = found.withColumn("_x", lo + (hi - lo) * (F.col("_at") - F.floor("_at"))).groupBy(*keys).agg(*[
        F.array(*[F.max(F.when((F.col("_var") == c) & (F.col("_i") == i), F.col("_x"))) for i in range(len(probs))]).alias(f"{c}_q") for c in cols])
    # a column without values has no quantiles, as in the other way
    found = found.select(*keys, *[F.when(F.col(f"{c}_q")[0].isNotNull(), F.col(f"{c}_q")).alias(f"{c}_q") for c in cols])
    return guess.filter("not _open").select(*wanted).unionByName(found.select(*wanted))


def enclosed(table: pa.Table, keys: list[str], cols: list[str], probs: list[float]) -> pa.Table:
    """For whole keys: the quantiles, right where no slice left values out, and else values that enclose them."""
    codes = np.stack([table[k].combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in keys], axis=1)
    _, first, code = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    code, groups = code.reshape(-1), len(first)
    out = {k: table[k].combine_chunks().take(pa.array(first)) for k in keys}
    out["_open"] = np.zeros(groups, bool)
    for c in cols:
        lists, step = table[f"{c}_v"].combine_chunks(), table[f"{c}_s"].to_numpy()
        length = lists.value_lengths().to_numpy()
        val, key, weight = lists.flatten().to_numpy(), np.repeat(code, length), np.repeat(step, length)
        n = np.bincount(code, table[f"{c}_n"].to_numpy(), groups).astype(np.int64)
        slack = np.bincount(code, np.where(length > 0, step - 1, 0), groups).astype(np.int64)
        order = np.lexsort((val, key))
        val, key, weight = val[order], key[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], (val[1:] != val[:-1]) | (key[1:] != key[:-1])])) if len(val) else np.zeros(0, np.int64)
        sums = np.cumsum(weight)
        # at most so many values lie under a named value, and at least so many, less the slack, up to it; all keys in one line
        under, upto, last = sums[new] - weight[new], sums[np.append(new[1:], len(val)) - 1] if len(val) else sums, np.searchsorted(key[new], np.arange(groups), "right")
        before = np.searchsorted(key, np.arange(groups), "left")
        base, value = np.concatenate([[0], sums])[before], np.append(val[new], np.inf)
        q, lo, hi = (np.full((groups, len(probs)), np.nan) for _ in range(3))
        some = n > 0
        for i, p in enumerate(probs):
            at = (n - 1) * float(p)
            below, above = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
            one, two = (value[np.searchsorted(under, base + r, "right") - 1] for r in (below, above))
            end = np.searchsorted(upto, base + slack + above + 1, "left")
            q[some, i], lo[some, i] = (one + (two - one) * (at - below))[some], one[some]
            hi[some, i] = np.where(end < last, value[np.minimum(end, len(value) - 1)], np.inf)[some]
        out["_open"] |= slack > 0
        starts = pa.array(np.arange(groups + 1, dtype=np.int32) * len(probs))
        for name, x in (("q", q), ("lo", lo), ("hi", hi)):
            out[f"{c}_{name}"] = pa.ListArray.from_arrays(starts, pa.array(x.reshape(-1)), mask=pa.array(~some))
        out[f"{c}_n"] = n
    return pa.table(out)


def pick(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of a sorted array without NULLs; NULL for an empty one."""
    at = (F.size(values) - 1) * F.lit(float(p))
    lo = F.get(values, F.floor(at).cast("int"))
    return lo + (F.get(values, F.ceil(at).cast("int")) - lo) * (at - F.floor(at))


def deviation(values: Column, median: Column) -> Column:
    """Median absolute deviation of a sorted array."""
    return pick(F.sort_array(F.transform(values, lambda x: F.abs(x - median))), 0.5)


def group_mad(df: DataFrame, keys: list[str], cols: list[str], medians: DataFrame,
              split: bool | None = None) -> DataFrame:
    """Median absolute deviation ``<c>_mad`` given a table of ``<c>_med``."""
    med = medians.select(*keys, *[f"{c}_med" for c in cols])
    if split:
        d, slices, short = sliced(df, keys, cols)
        d = join_same(d, med, keys).select(*keys, "_slice", *[
            F.sort_array(F.transform(c, lambda x: F.abs(x - F.col(f"{c}_med")))).alias(c) for c in cols])
        q = from_slices(d, keys, cols, [0.5], slices, short)
    else:
        dev = join_same(df.select(*keys, *cols).repartition(*keys), med, keys)
        q = quantiles(dev.select(*keys, *[F.abs(F.col(c) - F.col(f"{c}_med")).alias(c) for c in cols]), keys, cols, [0.5], split=split)
    return q.select(*keys, *[F.col(f"{c}_q")[0].alias(f"{c}_mad") for c in cols])
