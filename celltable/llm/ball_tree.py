"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers floor(scale * x).  A shard is a bounded block of vectors with its own tree; a node with centre
c and radius r holds no score above q.c + |q| r.  Nodes are visited best bound first, and a node whose bound is below
the query's current kth score is skipped.  The kth score is shared: every query first searches the one shard it was
dealt to, and carries the kth score found there into all other shards.

Queries are a stated part of the rows and go to every shard in packed blocks.  Each shard returns its k best at most
per query, and only scores that reach the shared kth one.

Rules: vectors that are NULL or hold a NULL or a non-finite component take no part, nor do rows without an id.  Only
vectors of equal length are compared.  Ties go to the smaller id.  Repeated rows are candidates each; rows with the
query's own id are not its candidates.  A query with fewer candidates returns them all.  Empty tables give no rows.
Scores are exact while they fit a 64-bit integer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.llm.store import quoted, saved

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 1024, 128


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    parts: tuple


def build_tree(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Split at the median along the line through two far points, until a leaf is small."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    centre = own.mean(axis=0)
    radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
    if len(rows) <= LEAF_ROWS or radius == 0:
        return Node(centre, radius, rows, ())
    far = own[((own - centre) ** 2).sum(axis=1).argmax()]
    other = own[((own - far) ** 2).sum(axis=1).argmax()]
    order = np.argsort(own @ (other - far), kind="stable")
    half = len(order) // 2
    return Node(centre, radius, None, (build_tree(points, rows[order[:half]]), build_tree(points, rows[order[half:]])))


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point only where it is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(1, queries.shape[1])
    if most < 2.0**53:
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    return queries @ points.T


class Search:
    """The k best per query in one tree; ``kth`` holds each query's current kth score."""

    def __init__(self, tree: Node, ids: np.ndarray, points: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.points, self.q_ids, self.queries, self.k = ids, points, q_ids, queries, k
        self.kth = kth.copy()
        self.as_float = queries.astype(np.float64)
        self.norm = np.sqrt((self.as_float**2).sum(axis=1))
        self.best: list = [None] * len(q_ids)
        if len(q_ids) and len(ids):
            self.visit(tree, np.arange(len(q_ids)))

    def bound(self, node: Node, live: np.ndarray) -> np.ndarray:
        dot = self.as_float[live] @ node.centre
        reach = self.norm[live] * node.radius
        return dot + reach + 1e-9 * (np.abs(dot) + reach) + 1e-6

    def visit(self, node: Node, live: np.ndarray) -> None:
        live = live[self.bound(node, live) >= self.kth[live]]
        if not len(live):
            return
        if node.rows is None:
            a, b = node.parts
            first = self.bound(a, live) >= self.bound(b, live)
            for part, own in ((a, live[first]), (b, live), (a, live[~first])):
                self.visit(part, own)
            return
        got = scores(self.queries[live], self.points[node.rows])
        ids = self.ids[node.rows]
        allowed = (got >= self.kth[live][:, None]) & (ids[None, :] != self.q_ids[live][:, None])
        for i in np.flatnonzero(allowed.any(axis=1)):
            q, take = live[i], allowed[i]
            s, v = got[i, take], ids[take]
            if self.best[q] is not None:
                s, v = np.concatenate([self.best[q][0], s]), np.concatenate([self.best[q][1], v])
            order = np.lexsort((v, -s))[:self.k]
            self.best[q] = s[order], v[order]
            if len(order) == self.k:
                self.kth[q] = max(self.kth[q], self.best[q][0][-1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [i for i, b in enumerate(self.best) if b is not None]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return (np.repeat(self.q_ids[found], [len(self.best[i][0]) for i in found]),
                np.concatenate([self.best[i][1] for i in found]), np.concatenate([self.best[i][0] for i in found]))


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, vec (array of long) of the rows that take part."""
    big = float(2**62)
    v = F.col(quoted(vec_col))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < big))
    return (df.filter(F.col(quoted(id_col)).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col(quoted(id_col)).cast("bigint").alias("id"), whole.cast("array<bigint>").alias("vec")))


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _packed(df: DataFrame, block: Column, extra: str | None = None) -> DataFrame:
    """One row per block: ids, vectors and kth scores as bytes."""
    def pack(table):
        vec = _stack(table["vec"])
        kth = table["kth"].to_numpy() if "kth" in table.column_names else np.zeros(len(vec), np.int64)
        return pa.table({"block": table["block"][:1], "dim": pa.array([vec.shape[1]], pa.int32()),
                         "ids": [table["id"].to_numpy().tobytes()], "vecs": [vec.tobytes()], "kths": [kth.tobytes()]})

    df = df.withColumn("block", block).withColumn("dim", F.size("vec"))
    return df.groupBy("block", "dim").applyInArrow(pack, "block bigint, dim int, ids binary, vecs binary, kths binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vecs"], np.int64).reshape(len(ids), row["dim"]), np.frombuffer(row["kths"], np.int64)


def _search(packed: DataFrame, k: int) -> DataFrame:
    """``packed``: a shard (ids, vecs) beside a block of queries (q_ids, q_vecs, q_kths), sorted by shard."""
    def run(batches):
        shard, tree, ids, points = None, None, None, None
        for b in batches:
            for row in b.to_pylist():
                if (row["block"], row["dim"]) != shard:
                    shard = (row["block"], row["dim"])
                    ids, points, _ = _unpacked({**row, "kths": b""})
                    tree = build_tree(points.astype(np.float64))
                q_ids, queries, kth = _unpacked({"ids": row["q_ids"], "vecs": row["q_vecs"], "kths": row["q_kths"], "dim": row["dim"]})
                q, v, s = Search(tree, ids, points, q_ids, queries, kth, k).rows()
                yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": v, "score": s})

    return packed.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest inner products of every query row."""
    lowest = -(2**63)
    rows = saved(quantised(df, id_col, vec_col, scale))
    queries = saved(quantised(df.filter(is_query), id_col, vec_col, scale).distinct())
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    home = F.pmod(F.xxhash64("id"), F.lit(shards))
    packed = saved(_packed(rows, home))

    def beside(q: DataFrame, everywhere: bool) -> DataFrame:
        q = q.select("block", "dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("kths").alias("q_kths"))
        if everywhere:
            q = q.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
        return packed.select("block", "dim", "ids", "vecs").join(q, ["block", "dim"]).sortWithinPartitions("block", "dim")

    # the kth score in the query's own shard is a floor for the kth score of all
    start = _search(beside(_packed(queries.withColumn("kth", F.lit(lowest).cast("bigint")), home), False), k)
    floor = start.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    floor = floor.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    dealt = queries.join(floor, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(lowest)).cast("bigint"))
    found = _search(beside(_packed(dealt, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks))), True), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
