"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata columns are quantised to a few bits each, at edges that halve the rows again and again; the cell's position
on the curve orders the rows, and equal runs of that order are the shards.  Neighbours on the curve are close in every
dimension, so each shard covers a small box and its files' minimum and maximum prune on all dimensions.

Rules: a NULL value takes code 0.  Text columns are compared by all their bytes.  Rows of one cell are ordered
by the tie columns, so a cell that holds a third of all rows is cut like any other run.  An empty table gives an empty
result.  Repeated rows take neighbouring places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.llm.store import quoted, saved


def ordered(c: Column, kind: str) -> Column:
    """The value to compare by: the bytes of a whole text, or a number."""
    return c.cast("binary") if kind == "string" else c.cast("double")


def text_edges(df: DataFrame, dim: str, bits: int) -> list[bytes]:
    """Up to 2^bits - 1 whole texts that cut the rows into about equal counts: counts per distinct text, summed up in order."""
    value = ordered(F.col(quoted(dim)), "string").alias("value")
    counts = df.select(value).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    laid = saved(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    every = Window.orderBy("part")
    parts = laid.groupBy("part").agg(F.sum("n").alias("held"))
    parts = parts.select(F.col("part"), (F.sum("held").over(every) - F.col("held")).alias("before"),
                         F.sum("held").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    # one row per part of the range partitioning
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    summed = laid.join(F.broadcast(parts), "part").withColumn("upto", upto)
    first, last = F.expr(f"(upto - n) * {1 << bits} div total"), F.expr(f"upto * {1 << bits} div total")
    found = summed.filter((first < last) & (first < (1 << bits) - 1)).select("value").collect()  # at most one per cut
    return sorted(bytes(r["value"]) for r in found)


def edges(df: DataFrame, dims: list[str], bits: int, accuracy: int = 10_000) -> list[list]:
    """For each dimension, up to 2^bits - 1 cut values of about equal row counts: one bounded sketch per number."""
    kinds, cells = dict(df.dtypes), 1 << bits
    probs = [i / cells for i in range(1, cells)]
    numbers = [d for d in dims if kinds[d] != "string"]
    found = df.agg(*[F.percentile_approx(ordered(F.col(quoted(d)), kinds[d]), probs, accuracy) for d in numbers]).first() if numbers else ()
    cuts = dict(zip(numbers, found, strict=True))
    return [sorted(set(cuts[d] or [])) if d in cuts else text_edges(df, d, bits) for d in dims]


def quantised(c: Column, kind: str, cuts: list) -> Column:
    value = ordered(c, kind)
    if not cuts:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda e: e < value))
    return F.when(value.isNull(), 0).otherwise(below)


def with_hilbert_index(df: DataFrame, coords: list[str], bits: int, out: str) -> DataFrame:
    """Position on the Hilbert curve of a point of ``bits``-bit coordinates; replaces the coordinate columns.

    One fold over the bits from the highest turns the axes back level by level; the Gray code of what is left,
    with its bits interleaved, is the position."""
    n = len(coords)

    def turn(state: Column, mask: Column) -> Column:
        low = mask - 1
        x = [state[f"a{i}"] for i in range(n)]
        for i in range(n):
            high = x[i].bitwiseAND(mask) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            first = F.when(high, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
            if i:
                x[i] = F.when(high, x[i]).otherwise(x[i].bitwiseXOR(swap))
            x[0] = first
        return F.struct(*[c.alias(f"a{i}") for i, c in enumerate(x)])

    start = F.struct(*[F.col(c).alias(f"a{i}") for i, c in enumerate(coords)])
    masks = F.array(*[F.lit(1 << k) for k in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    df = df.withColumn(coords[0], F.aggregate(masks, start, turn))
    turned = F.col(coords[0])
    gray = [turned["a0"]]
    for i in range(1, n):
        gray.append(gray[-1].bitwiseXOR(turned[f"a{i}"]))
    flip = F.lit(0)
    for k in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(gray[-1].bitwiseAND(1 << k) != 0, (1 << k) - 1).otherwise(0))
    df = df.select(*[c for c in df.columns if c not in coords], F.array(*gray).alias(coords[0]), flip.alias(coords[-1] + "_flip"))
    index = F.lit(0).cast("bigint")
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(coords[0])[i].bitwiseXOR(F.col(coords[-1] + "_flip")), k).bitwiseAND(1)
            index = F.shiftleft(index, 1).bitwiseOR(bit.cast("bigint"))
    return df.withColumn(out, index).drop(coords[0], coords[-1] + "_flip")


def hilbert_order(df: DataFrame, dims: list[str], bits: int = 5, out: str = "curve") -> DataFrame:
    """The rows with their place on the curve through the quantised dimensions."""
    kinds = dict(df.dtypes)
    cuts = edges(df, dims, bits)
    coords = [f"_axis{i}" for i in range(len(dims))]
    df = df.withColumns({a: quantised(F.col(quoted(d)), kinds[d], c).cast("int") for a, d, c in zip(coords, dims, cuts, strict=True)})
    return with_hilbert_index(df, coords, bits, out)


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = 16, bits: int = 5) -> DataFrame:
    """The rows with ``curve``, ``shard`` (0 to shards-1, row counts at most one apart) and ``slot`` (from 0 in each).

    The rows are dealt by range of (curve, ties) and numbered inside each part; a row per part supplies the offsets.
    What is passed in is what moves: pass narrow rows to get only the plan, whole rows to lay them out."""
    order = ["curve", *ties]
    laid = (hilbert_order(df, dims, bits).repartitionByRange(*[F.col(quoted(c)) for c in order])
            .sortWithinPartitions(*[F.col(quoted(c)) for c in order])
            .withColumn("_mark", F.monotonically_increasing_id()))
    laid = saved(laid).withColumns({"_part": F.shiftright("_mark", 33), "_at": F.col("_mark").bitwiseAND((1 << 33) - 1)})
    parts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.orderBy("_part")
    parts = parts.select("_part", (F.sum("_n").over(every) - F.col("_n")).alias("_before"),
                         F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"))
    # one row per part of the range partitioning, so the size is that of the layout, not of the data
    placed = laid.join(F.broadcast(parts), "_part").withColumn("_place", F.col("_before") + F.col("_at"))
    placed = placed.withColumn("shard", F.expr(f"(_place * {shards}) div _rows").cast("int"))
    return (placed.withColumn("slot", F.expr(f"_place - (shard * _rows + {shards - 1}) div {shards}"))
            .drop("_part", "_mark", "_at", "_before", "_rows", "_place"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so that row groups keep narrow ranges in every dimension."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def shard_ranges(placed: DataFrame, dims: list[str]) -> DataFrame:
    """Smallest and largest value per shard and dimension: what a reader prunes by."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *[
        f(quoted(d)).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))])


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot and size of every document, ordered by source, language and size."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    narrow = docs.select("doc_id", "source", "lang", size.cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"))
    return hilbert_shards(narrow, ["source", "lang", "size"], ["doc_id", "size", "text_crc32"], shards)
