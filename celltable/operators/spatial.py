"""Distance and box joins on a grid: equi-joins on buckets, then the exact test.

A point is replicated to the few neighbouring buckets within reach, never to a
whole group, so the work follows the number of near pairs.  No side is
broadcast by hand; a crowded bucket is left to AQE's skew-join split.
While every group is small (measured), its points move once, to one task, and the
pairs are found there; they stay laid out by group, so what groups them by the
same keys, or by more, moves no edge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.operators.skew import has_hot_group, stable, stored

# Points of a group that is handled inside one task, and of one call there.
SMALL, CALL_POINTS = 2_000, 50_000

# Half of the 3x3 neighbourhood: each unordered pair of buckets meets once.
HALF = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
FULL = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _bucketed(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({"_bx": F.floor(F.col("x") / float(size)), "_by": F.floor(F.col("y") / float(size))})


# Width of a bucket of ``pairs_within`` in radii: wider buckets copy fewer points and compare more.
BUCKET_RADII = 4


def _reached(pairs: list[tuple[int, int]], radius: float, side: float) -> Column:
    """Those offsets (i, j) whose bucket (bx - i, by - j) has a border within the radius of the point."""
    # slightly more than the radius, so rounding of the borders loses no pair
    reach = float(radius) * (1 + 1e-9) + 1e-9

    def near(i: int, c: str, bucket: str) -> Column:
        if i == 0:
            return F.lit(True)
        low, high = F.col(bucket) * side, (F.col(bucket) + 1) * side
        return F.col(c) - low <= reach if i > 0 else high - F.col(c) <= reach

    return F.filter(F.array(*[F.when(near(i, "x", "_bx") & near(j, "y", "_by"), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")))
                              for i, j in pairs]), lambda o: o.isNotNull())


def _packed(nodes: DataFrame, keys: list[str], node: str, carry: tuple[str, ...], laid: bool) -> DataFrame:
    """One row per group: its points as an array ``_p`` of (_a, x, y, and ``_c_<c>`` for what is carried)."""
    d = nodes.select(*keys, F.col(node).alias("_a"), "x", "y", *[F.col(c).alias(f"_c_{c}") for c in carry]).na.drop(subset=[*keys, "_a", "x", "y"])
    d = d if laid else d.repartition(*keys)
    return d.groupBy(*keys).agg(F.collect_list(F.struct("_a", "x", "y", *[f"_c_{c}" for c in carry])).alias("_p"))


def _by_group(find: Callable, shape: str):
    """``find(group, x, y, code)`` -> group and columns of the rows found, for the groups of some ``CALL_POINTS`` points at
    a time; equal codes are equal ids.  Rows come back as an array per group, places counted inside the group."""
    names = [x.split(":")[0] for x in shape.split(",")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            xs, ys, again = (batch.field(i) for i in range(3))
            off = xs.offsets.to_numpy().astype(np.int64)
            x, y, same = (a.values.to_numpy(zero_copy_only=False) for a in (xs, ys, again))
            base = off[0]
            cuts = np.unique(np.append(np.searchsorted(off, np.arange(base, off[-1], CALL_POINTS)), len(off) - 1)) if off[-1] > base else np.array([0, len(off) - 1])
            cuts = np.unique(np.append(0, cuts))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                a, z = off[lo], off[hi]
                group = np.repeat(np.arange(hi - lo), np.diff(off[lo:hi + 1]))
                at, cols = find(group, x[a:z], y[a:z], np.cumsum(~same[a:z].astype(bool)))
                first = (off[lo:hi] - a)[at]
                cols = [c - first if c.dtype.kind == "i" else c for c in cols]
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=hi - lo))]).astype(np.int32)
                yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, pa.int32() if c.dtype.kind == "i" else pa.float64()) for c in cols], names))

    found = F.arrow_udf(run, f"array<struct<{shape}>>")
    again = F.transform("_p", lambda p, i: (i > 0) & (p["_a"] == F.get("_p", i - 1)["_a"]))
    return found(F.struct(F.col("_p.x").cast("array<double>").alias("x"), F.col("_p.y").cast("array<double>").alias("y"), F.coalesce(again, F.array()).alias("again")))


def _nearest_of(k: int) -> Callable:
    """Distinct pairs (a, b) with their distance, of which one is among the k nearest of the other; ties by id."""
    def find(group, x, y, code):
        at, nb, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        ends = np.concatenate([[0], np.cumsum(np.bincount(group))]) if len(group) else np.zeros(1, np.int64)
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            step = max(1, 2_000_000 // max(1, z - a))
            for s in range(a, z, step):
                t = min(z, s + step)
                dx, dy = x[s:t, None] - x[None, a:z], y[s:t, None] - y[None, a:z]
                d = np.sqrt(dx * dx + dy * dy)
                d[~np.isfinite(d) | (code[s:t, None] == code[None, a:z])] = np.inf
                most = np.partition(d, k - 1, axis=1)[:, k - 1] if z - a >= k else np.full(t - s, np.inf)
                i, j = np.nonzero((d <= most[:, None]) & (d < np.inf))
                at.append(i + s)
                nb.append(j + a)
                dist.append(d[i, j])
        at, nb, dist = np.concatenate(at), np.concatenate(nb), np.concatenate(dist)
        # rows of one id are one point
        order = np.lexsort((nb, dist, code[at]))
        at, nb, dist = at[order], nb[order], dist[order]
        own = code[at]
        take = np.arange(len(own)) - np.searchsorted(own, own, "left") < k
        at, nb, dist = at[take], nb[take], dist[take]
        lead = np.searchsorted(code, code)  # the first row of an id stands for it
        a, b = np.minimum(lead[at], lead[nb]), np.maximum(lead[at], lead[nb])
        order = np.lexsort((dist, b, a))
        a, b, dist = a[order], b[order], dist[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (dist[1:] != dist[:-1])
        a, b, dist = a[new], b[new], dist[new]
        return group[a], [a, b, dist]
    return find


def pairs_within(nodes: DataFrame, keys: list[str], node: str, radius: float, closed: bool = True,
                 carry: tuple[str, ...] = (), laid: bool = False, small: int = 0) -> DataFrame:
    """Unordered pairs (src < dst) of one group at most ``radius`` apart, with ``dist``.

    While no group has more than ``small`` points (measured), each is gathered in one row and compared there, all with all;
    ``laid`` says that the rows of a group lie together already.  Otherwise
    buckets are a few radii wide and a point is copied only to those neighbouring buckets
    whose border lies within the radius, so most points are sent once to either side.
    ``carry`` columns arrive as ``<c>_src`` and ``<c>_dst``."""
    if small and keys and not has_hot_group(nodes, keys, small):
        p = _packed(nodes, keys, node, carry, laid).select(*keys, "_p", F.explode("_p").alias("_l")).select(*keys, "_l", F.explode("_p").alias("_r"))
        dx, dy = F.col("_l.x") - F.col("_r.x"), F.col("_l.y") - F.col("_r.y")
        d2 = dx * dx + dy * dy
        near = d2 <= float(radius) ** 2 if closed else d2 < float(radius) ** 2
        return p.filter(near & (F.col("_l._a") < F.col("_r._a"))).select(
            *keys, F.col("_l._a").alias("src"), F.col("_r._a").alias("dst"), F.sqrt(d2).alias("dist"),
            *[F.col(f"_l._c_{c}").alias(f"{c}_src") for c in carry], *[F.col(f"_r._c_{c}").alias(f"{c}_dst") for c in carry])
    side = float(radius) * BUCKET_RADII
    base = _bucketed(nodes.select(*keys, F.col(node).alias("_a"), "x", "y", *carry), side)
    offsets = _reached(HALF, radius, side)
    right = (base.withColumn("_o", F.explode(offsets))
             .select(*keys, (F.col("_bx") - F.col("_o.i")).alias("_bx"), (F.col("_by") - F.col("_o.j")).alias("_by"),
                     ((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_same"), F.col("_a").alias("_b"),
                     F.col("x").alias("_x"), F.col("y").alias("_y"), *[F.col(c).alias(f"_{c}") for c in carry]))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    d2 = dx * dx + dy * dy
    near = d2 <= float(radius) ** 2 if closed else d2 < float(radius) ** 2
    a, b = F.col("_a"), F.col("_b")
    # the replicated side is several times its estimated size, so it is never broadcast
    j = base.join(right.hint("merge"), [*keys, "_bx", "_by"]).filter(near & (a != b) & (~F.col("_same") | (a < b)))
    first = a < b

    def pick(c: str, want_first: bool) -> Column:
        return F.when(first == want_first, F.col(c)).otherwise(F.col(f"_{c}"))

    return j.select(*keys, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.sqrt(d2).alias("dist"),
                    *[pick(c, True).alias(f"{c}_src") for c in carry], *[pick(c, False).alias(f"{c}_dst") for c in carry])


def edge_weight(dist: Column, weighted: bool = True, clip: float = 1e-3) -> Column:
    return F.lit(1.0) / F.greatest(dist, F.lit(float(clip))) if weighted else F.lit(1.0)


def radius_edges(cells: DataFrame, keys: list[str] = ["slide_id", "patch_id"], radius: float = 40.0,
                 weighted: bool = True, clip: float = 1e-3, node: str = "cell_id", carry: tuple[str, ...] = (),
                 laid: bool = False, small: int = 0) -> DataFrame:
    """Neighbour edges of each group: keys, src, dst, dist, weight, and ``carry`` of both ends."""
    return (pairs_within(cells, keys, node, radius, carry=carry, laid=laid, small=small)
            .withColumn("weight", edge_weight(F.col("dist"), weighted, clip)))


def knn_edges(cells: DataFrame, keys: list[str] = ["slide_id", "patch_id"], k: int = 6, node: str = "cell_id",
              start_radius: float = 64.0, weighted: bool = True, clip: float = 1e-3, small: int = SMALL) -> DataFrame:
    """k nearest neighbours (ties by id), made undirected and distinct.

    While no group has more than ``small`` points (measured), each is handled in one task.  Otherwise each round looks within one radius; a point with k neighbours inside it, or
    whose radius spans its whole group, is settled.  The rest go on with twice
    the radius, so no round compares all pairs of a large group."""
    if small and keys and not has_hot_group(cells, keys, small):
        p = _packed(cells, keys, node, (), False).withColumn("_p", F.sort_array("_p"))
        p = p.withColumn("_e", _by_group(_nearest_of(k), "a:int,b:int,dist:double"))
        p = p.select(*keys, "_p", F.inline("_e"))
        e = p.select(*keys, F.get("_p", F.col("a"))["_a"].alias("src"), F.get("_p", F.col("b"))["_a"].alias("dst"), "dist")
        return e.withColumn("weight", edge_weight(F.col("dist"), weighted, clip))
    pts = cells.select(*keys, F.col(node).alias("_id"), "x", "y")
    span = pts.groupBy(*keys).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_span"))
    todo, radius, done = pts.join(span, keys), float(start_radius), None
    while True:
        side = radius * BUCKET_RADII
        right = _bucketed(pts, side).withColumn("_o", F.explode(_reached(FULL, radius, side))).select(
            *keys, (F.col("_bx") - F.col("_o.i")).alias("_bx"), (F.col("_by") - F.col("_o.j")).alias("_by"),
            F.col("_id").alias("nb"), F.col("x").alias("_nx"), F.col("y").alias("_ny"))
        dx, dy = F.col("x") - F.col("_nx"), F.col("y") - F.col("_ny")
        d2 = dx * dx + dy * dy
        near = (_bucketed(todo, side).join(right.hint("merge"), [*keys, "_bx", "_by"])
                .filter((F.col("_id") != F.col("nb")) & (d2 <= radius ** 2))
                .select(*keys, "_id", "_span", "nb", F.sqrt(d2).alias("dist")))
        w = Window.partitionBy(*keys, "_id").orderBy("dist", "nb")
        # row_number <= k is pre-limited before the shuffle by the window group limit
        top = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
        # the counts need no further shuffle
        top = top.withColumn("_found", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_id")))
        settled_all = F.col("_span") <= radius
        top = stored(top)
        full = top.filter(F.col("_rn") == k).select(*keys, "_id")
        hits = top.filter((F.col("_found") == k) | settled_all).select(*keys, "_id", "nb", "dist")
        done = hits if done is None else done.unionByName(hits)
        todo = stable(todo.filter(~settled_all).join(full, [*keys, "_id"], "left_anti"))
        if todo.isEmpty():
            break
        radius *= 2
    e = done.select(*keys, F.least("_id", "nb").alias("src"), F.greatest("_id", "nb").alias("dst"), "dist").distinct()
    return e.withColumn("weight", edge_weight(F.col("dist"), weighted, clip))


def similar_pairs(bags: DataFrame, min_cosine: float = 0.7, reach: float = 2.9, patch: float = 256.0,
                  keys: list[str] = ["slide_id"], node: str = "vec_id") -> DataFrame:
    """Near patches with similar features: euclid <= reach*patch and cosine >= min_cosine."""
    from celltable.functions.columns import cosine
    p = pairs_within(bags, keys, node, reach * patch, carry=("feature",))
    return (p.withColumn("cos", cosine("feature_src", "feature_dst")).filter(F.col("cos") >= min_cosine)
            .select(*keys, "src", "dst", "dist", "cos"))


def radius_graph(nodes: DataFrame, radius: float, closed: bool = True, loops: bool = True,
                 keys: list[str] = ["slide_id"], node: str = "vec_id") -> DataFrame:
    """Directed radius graph: both directions, optionally one self-loop per node."""
    und = pairs_within(nodes, keys, node, radius, closed).select(*keys, "src", "dst")
    both = und.unionByName(und.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    if loops:
        both = both.unionByName(nodes.select(*keys, F.col(node).alias("src"), F.col(node).alias("dst")))
    return both


def normalise_edges(nodes: DataFrame, edges: DataFrame, keys: list[str] = ["slide_id"], node: str = "vec_id",
                    loops: bool = True) -> DataFrame:
    """Undirected edge set: both directions, distinct, old loops dropped, one loop per node."""
    e = edges.select(*keys, "src", "dst").filter(F.col("src") != F.col("dst"))
    e = e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if loops:
        e = e.unionByName(nodes.select(*keys, F.col(node).alias("src"), F.col(node).alias("dst")))
    return e


def join_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Points in half-open boxes [x0,x1) x [y0,y1) of the same group.

    Boxes are replicated to the grid cells they touch (choose ``cell`` near the
    usual box size); points are not replicated."""
    b = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))

    def steps(lo: str, hi: str) -> Column:
        a, z = F.floor(F.col(lo) / float(cell)), F.ceil(F.col(hi) / float(cell)) - 1
        return F.explode(F.sequence(a, F.greatest(a, z)))

    b = b.withColumn("_bx", steps("x0", "x1")).withColumn("_by", steps("y0", "y1"))
    return (_bucketed(points, cell).join(b, [*keys, "_bx", "_by"])
            .filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
                    & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
            .drop("_bx", "_by"))
