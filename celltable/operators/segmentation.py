"""Label maps as long tables (img, y, x, ...): regions, overlaps and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.operators.graph import components
from celltable.operators.skew import group_rows, in_blocks, prefix_agg, row_index, stable, stored
from celltable.operators.spatial import join_boxes


def overlaps(px: DataFrame, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """Intersection, areas, union and IoU of every overlapping (true, pred) pair."""
    inter = (px.filter((F.col(true) > 0) & (F.col(pred) > 0)).groupBy("img", F.col(true).alias("t"), F.col(pred).alias("p"))
             .agg(F.count(F.lit(1)).alias("inter")))
    a, b = areas(px, true, "t", "area_t"), areas(px, pred, "p", "area_p")
    o = inter.join(a, ["img", "t"]).join(b, ["img", "p"])
    union = F.col("area_t") + F.col("area_p") - F.col("inter")
    return o.withColumns({"union": union, "iou": F.col("inter") / union})


def overlaps_of(true_px: DataFrame, pred_px: DataFrame) -> DataFrame:
    """Overlaps of two separate label tables (img, y, x, id)."""
    t = true_px.select("img", "y", "x", F.col("id").alias("true_id"))
    p = pred_px.select("img", "y", "x", F.col("id").alias("pred_id"))
    both = t.join(p, ["img", "y", "x"], "full").na.fill(0, ["true_id", "pred_id"])
    return overlaps(both)


def areas(px: DataFrame, label: str, name: str, out: str = "area") -> DataFrame:
    return px.filter(F.col(label) > 0).groupBy("img", F.col(label).alias(name)).agg(F.count(F.lit(1)).alias(out))


def images(px: DataFrame) -> DataFrame:
    return px.select("img").distinct()


def best_pairs(o: DataFrame) -> DataFrame:
    """Best prediction of each true instance by IoU, smallest id first on ties."""
    best = o.groupBy("img", "t").agg(F.max(F.struct("iou", (-F.col("p")).alias("np"), "inter", "union")).alias("b"))
    return best.select("img", "t", (-F.col("b.np")).alias("p"), "b.iou", "b.inter", "b.union")


def _aji_from(px: DataFrame, paired: DataFrame, name: str) -> DataFrame:
    """Intersections over unions of the pairs plus the areas of everything unpaired."""
    a, b = areas(px, "true_id", "t"), areas(px, "pred_id", "p")
    lone = (a.join(paired, ["img", "t"], "left_anti").select("img", "area")
            .unionByName(b.join(paired, ["img", "p"], "left_anti").select("img", "area")))
    s = paired.groupBy("img").agg(F.sum("inter").alias("_i"), F.sum("union").alias("_u"))
    r = lone.groupBy("img").agg(F.sum("area").alias("_r"))
    z = F.lit(0)
    return images(px).join(s, "img", "left").join(r, "img", "left").select(
        "img", F.coalesce(F.try_divide(F.coalesce("_i", z), F.coalesce("_u", z) + F.coalesce("_r", z)), F.lit(0.0)).alias(name))


def aji(px: DataFrame) -> DataFrame:
    return _aji_from(px, best_pairs(overlaps(px)), "aji")


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-cost assignment of the shorter side (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    if n == 0:
        return np.zeros(0, int), np.zeros(0, int)
    # the first row whose least cost is a column starts there; only the others need a search
    u, v, owner = c.min(axis=1), np.zeros(m + 1), np.full(m + 1, -1)
    taken, starts = np.unique(c.argmin(axis=1), return_index=True)
    owner[taken] = starts
    for i in np.setdiff1d(np.arange(n), starts):
        owner[m], j0 = i, m
        dist, prev, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j0] != -1:
            done[j0] = True
            row = owner[j0]
            free = ~done[:m]
            alt = c[row] - u[row] - v[:m]
            better = free & (alt < dist)
            dist[better], prev[better] = alt[better], j0
            j1 = int(np.argmin(np.where(free, dist, np.inf)))
            step = dist[j1]
            seen = np.flatnonzero(done)
            u[owner[seen]] += step
            v[seen] -= step
            dist[free] -= step
            j0 = j1
        while j0 != m:
            owner[j0] = owner[prev[j0]]
            j0 = prev[j0]
    cols = np.flatnonzero(owner[:m] >= 0)
    rows = owner[cols]
    return (cols, rows) if flip else (rows, cols)


def unique_pairs(o: DataFrame, max_cells: int = 4_000_000) -> DataFrame:
    """One-to-one pairing with the largest total IoU.

    Pairs without overlap score zero, so the optimum splits over the connected
    parts of the overlap graph; each part, a handful of instances, is one task's
    problem instead of a whole image."""
    t, p = F.concat(F.lit("t"), F.col("t").cast("string")), F.concat(F.lit("p"), F.col("p").cast("string"))
    o = stable(o)
    e = o.select("img", t.alias("src"), p.alias("dst"))
    n = e.select("img", F.col("src").alias("id")).unionByName(e.select("img", F.col("dst").alias("id"))).distinct()
    comp = components(n, e, ["img"], "id").select("img", F.col("node").alias("_k"), "component")
    parts = stable(o.withColumn("_k", t).join(comp, ["img", "_k"]).select("img", "component", "t", "p", "iou"))
    big = parts.groupBy("img", "component").agg((F.countDistinct("t") * F.countDistinct("p")).alias("c")).agg(F.max("c")).first()[0]
    if (big or 0) > max_cells:
        raise ValueError(f"an overlap part needs a {big}-cell cost table, more than {max_cells}")
    types = dict(o.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = ["img", "component"]
        # the only pair of a part is its pairing; only parts of several pairs need a search
        alone = ~pdf.duplicated(by, keep=False) & (pdf["iou"] > 0)
        out = [pdf.loc[alone, ["img", "t", "p"]]]
        for _, g in pdf[pdf.duplicated(by, keep=False)].groupby(by, sort=False):
            ts, i = np.unique(g["t"].to_numpy(), return_inverse=True)
            ps, j = np.unique(g["p"].to_numpy(), return_inverse=True)
            gain = np.zeros((len(ts), len(ps)))
            gain[i, j] = g["iou"].to_numpy()
            i, j = hungarian(-gain)
            ok = gain[i, j] > 0
            out.append(pd.DataFrame({"img": g["img"].iloc[0], "t": ts[i[ok]], "p": ps[j[ok]]}))
        return pd.concat(out, ignore_index=True)

    got = in_blocks(parts.select("img", "component", "t", "p", "iou"), ["img", "component"], run,
                    f"img {types['img']}, t {types['t']}, p {types['p']}")
    return o.join(got, ["img", "t", "p"])


def aji_plus(px: DataFrame) -> DataFrame:
    return _aji_from(px, unique_pairs(overlaps(px)), "aji_plus")


def panoptic(px: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """DQ, SQ and PQ.  At 0.5 and above a match is unique by construction; below,
    the best one-to-one pairing is found first."""
    o = overlaps(px)
    m = (o if match_iou >= 0.5 else unique_pairs(o)).filter(F.col("iou") > match_iou)
    tp = m.groupBy("img").agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("s"))
    nt = areas(px, "true_id", "t").groupBy("img").agg(F.count(F.lit(1)).alias("nt"))
    np_ = areas(px, "pred_id", "p").groupBy("img").agg(F.count(F.lit(1)).alias("np"))
    d = images(px).join(tp, "img", "left").join(nt, "img", "left").join(np_, "img", "left").na.fill(0)
    d = d.select("img", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), "s")
    dq = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") * 0.5 + F.col("fn") * 0.5)
    sq = F.col("s") / (F.col("tp") + 1e-6)
    return d.select("img", "tp", "fp", "fn", F.coalesce(dq, F.lit(0.0)).alias("dq"), sq.alias("sq"),
                    F.coalesce(dq * sq, F.lit(0.0)).alias("pq"))


def dice(px: DataFrame) -> DataFrame:
    t, p = F.col("true_id") > 0, F.col("pred_id") > 0
    return px.groupBy("img").agg(F.coalesce(F.try_divide(
        F.count_if(t & p) * 2.0, (F.count_if(t) + F.count_if(p)).cast("double")), F.lit(0.0)).alias("dice"))


def ensemble_dice(px: DataFrame) -> DataFrame:
    s = overlaps(px).groupBy("img").agg((F.sum("inter") * 2.0 / F.sum(F.col("area_t") + F.col("area_p"))).alias("dice2"))
    return images(px).join(s, "img", "left").na.fill(0.0, ["dice2"])


def instance_scores(px: DataFrame) -> DataFrame:
    """Per image: dice, aji, dq, sq, pq, aji_plus."""
    out = dice(px)
    for part in (aji(px), panoptic(px).select("img", "dq", "sq", "pq"), aji_plus(px)):
        out = out.join(part, "img")
    return out


def match_points(a: DataFrame, b: DataFrame, radius: float = 12.0, image: str = "image",
                 max_cells: int = 50_000_000) -> DataFrame:
    """Least-distance one-to-one matching over all points of an image, then pairs up to ``radius``.

    The assignment is one problem per image; its cost table is measured first and an
    image beyond ``max_cells`` is refused rather than cut.  Small images share a task call."""
    na = a.groupBy(image).agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy(image).agg(F.count(F.lit(1)).alias("nb"))
    worst = na.join(nb, image).agg(F.max(F.col("na") * F.col("nb"))).first()[0] or 0
    if worst > max_cells:
        raise ValueError(f"an image needs a {worst}-cell cost table, more than {max_cells}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x, y, second = (pdf[k].to_numpy() for k in ("id", "x", "y", "_second"))
        rows, mate, dist = [], [], []
        for at in group_rows(pdf, ["image"]):
            i, j = at[~second[at]], at[second[at]]
            if len(i) == 0 or len(j) == 0:
                continue
            c = np.hypot(x[i][:, None] - x[j], y[i][:, None] - y[j])
            p, q = hungarian(c)
            ok = c[p, q] <= radius
            rows.append(i[p[ok]])
            mate.append(j[q[ok]])
            dist.append(c[p, q][ok])
        if not rows:
            return pd.DataFrame({"image": [], "a": [], "b": [], "dist": []})
        i, j = np.concatenate(rows), np.concatenate(mate)
        return pd.DataFrame({"image": pdf["image"].to_numpy()[i], "a": ids[i], "b": ids[j], "dist": np.concatenate(dist)})

    # ids of two types travel as text
    ta, tb = dict(a.dtypes)["id"], dict(b.dtypes)["id"]
    side = lambda d, second: d.select(F.col(image).alias("image"), F.col("id").cast(ta if ta == tb else "string").alias("id"),
                                      "x", "y", F.lit(second).alias("_second"))
    both = side(a, False).unionByName(side(b, True))
    t, kind = dict(both.dtypes)["image"], dict(both.dtypes)["id"]
    got = in_blocks(both, ["image"], run, f"image {t}, a {kind}, b {kind}, dist double")
    return got.select("image", F.col("a").cast(ta).alias("a"), F.col("b").cast(tb).alias("b"), "dist")


def type_scores(pairs: DataFrame, lone_true: DataFrame, lone_pred: DataFrame, types: list[int],
                exhaustive: bool = True) -> DataFrame:
    """Detection F1, type accuracy and per-type F1 from matched (true_type, pred_type) rows."""
    t, p = F.col("true_type"), F.col("pred_type")
    aggs = [F.count(F.lit(1)).alias("tp"), F.count_if(t == p).alias("same"), F.count_if(t == -1).alias("ign")]
    for k in types:
        rows = (t == k) | (p == k)
        aggs += [F.count_if(rows & (t == k) & (p == k)).alias(f"hit{k}"), F.count_if((t != k) & (p == k)).alias(f"fp{k}"),
                 F.count_if((t == k) & (p != k)).alias(f"fn{k}"), F.count_if(rows & (t == -1)).alias(f"ig{k}")]
    m = pairs.agg(*aggs)
    lt = lone_true.agg(F.count(F.lit(1)).alias("fn_d"), *[F.count_if(F.col("true_type") == k).alias(f"lt{k}") for k in types])
    lp = lone_pred.agg(F.count(F.lit(1)).alias("fp_d"), *[F.count_if(F.col("pred_type") == k).alias(f"lp{k}") for k in types])
    # three one-row tables
    one = lambda d: d.withColumn("_one", F.lit(1))
    d = one(m).join(one(lt), "_one").join(one(lp), "_one")
    differ = F.col("tp") - F.col("same") - (F.lit(0) if exhaustive else F.col("ign"))
    out = [F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2.0 + F.col("fp_d") + F.col("fn_d")).alias("f1_d"),
           F.try_divide(F.col("same").cast("double"), (F.col("same") + differ).cast("double")).alias("acc")]
    for k in types:
        fp = F.col(f"fp{k}") - (F.lit(0) if exhaustive else F.col(f"ig{k}"))
        # rows outside both types never enter the subset, so its "neither" count is zero
        hit = F.col(f"hit{k}") * 2.0
        out.append(F.try_divide(hit, hit + fp * 2 + F.col(f"fn{k}") * 2 + F.col(f"lp{k}") + F.col(f"lt{k}")).alias(f"f1_{k}"))
    return d.select(*out)


def type_score_job(true_pts: DataFrame, pred_pts: DataFrame, types: list[int], radius: float = 12.0,
                   exhaustive: bool = True) -> DataFrame:
    """Match points of all images, then score detection and types together."""
    m = stable(match_points(true_pts, pred_pts, radius))
    t = true_pts.select("image", F.col("id").alias("a"), F.col("type").alias("true_type"))
    p = pred_pts.select("image", F.col("id").alias("b"), F.col("type").alias("pred_type"))
    return type_scores(m.join(t, ["image", "a"]).join(p, ["image", "b"]),
                       t.join(m, ["image", "a"], "left_anti"), p.join(m, ["image", "b"], "left_anti"), types, exhaustive)


# ---- regions ------------------------------------------------------------------------

def region_runs(px: DataFrame, connectivity: int = 8, min_size: int = 0, keys: list[str] = ["img"],
                same: str | None = None, cell: int = 64) -> DataFrame:
    """Connected regions as runs of pixels: keys, y, x0, x1 (both inside), again (the x that occur more than once, for each
    repeat), region (named by its first pixel), size.

    A run is a row's unbroken stretch of pixels (of one label, with ``same``).  Runs of adjacent rows are linked where they
    meet, on grid cells of width ``cell``, so a link is made for each pair of runs, not of pixels.  A pixel without a place is in
    no region; one without a label is its own."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    extra = [same] if same else []
    row = [*keys, *extra, "y"]
    d = px.select(*keys, *extra, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).filter("y is not null and x is not null")
    w = Window.partitionBy(*row).orderBy("x")
    # x grows with its rank as long as no pixel is left out
    stretch = F.col("x") - F.dense_rank().over(w)
    d = d.withColumns({"_run": F.when(F.col(same).isNull(), F.col("x")).otherwise(stretch) if same else stretch,
                       "_again": F.when(F.lag("x").over(w) == F.col("x"), F.col("x"))})
    runs = stored(d.groupBy(*row, "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.collect_list("_again").alias("again"))
                  .withColumn("node", F.col("y") * F.lit(1 << 24) + F.col("x0")).drop("_run"))
    reach = 1 if connectivity == 8 else 0

    def laid(y: Column, lo: Column, hi: Column, end: str) -> DataFrame:
        return runs.select(*keys, *extra, y.alias("y"), lo.alias(f"lo_{end}"), hi.alias(f"hi_{end}"), F.col("node").alias(end),
                           F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))).alias("_at"))

    x0, x1 = F.col("x0"), F.col("x1")
    e = laid(F.col("y") + 1, x0 - reach, x1 + reach, "src").join(laid(F.col("y"), x0, x1, "dst"), [*row, "_at"])
    # two runs that meet in several cells are linked in the first
    start = F.greatest("lo_src", "lo_dst")
    e = e.filter((start <= F.least("hi_src", "hi_dst")) & (F.floor(start / cell) == F.col("_at"))).select(*keys, "src", "dst")
    nodes = runs.select(*keys, "node")
    comp = components(nodes.distinct() if same else nodes, e, keys, "node").withColumnRenamed("component", "region")
    named = stored(runs.join(comp, [*keys, "node"]).select(*keys, "y", "x0", "x1", "again", "region"))
    size = named.groupBy(*keys, "region").agg(F.sum(F.col("x1") - F.col("x0") + 1 + F.size("again")).alias("size"))
    return named.join(size.filter(F.col("size") >= min_size), [*keys, "region"]).select(*keys, "y", "x0", "x1", "again", "region", "size")


def label_regions(px: DataFrame, connectivity: int = 8, min_size: int = 0, keys: list[str] = ["img"],
                  same: str | None = None) -> DataFrame:
    """Connected regions of foreground pixels: keys, y, x, region (named by its first
    pixel), size.  ``same`` restricts links to pixels of one label, which splits a
    label into its connected parts."""
    runs = region_runs(px, connectivity, min_size, keys, same)
    return runs.select(*keys, "y", F.explode(F.concat(F.sequence("x0", "x1"), "again")).alias("x"), "region", "size")


def region_props(px: DataFrame, label: str, channels: list[str], offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """Area, centroid (truncated, shifted by offset), bbox (max exclusive) and per-channel mean and variance."""
    g = px.filter(F.col(label) > 0).groupBy("img", F.col(label).alias("label"))
    return g.agg(F.count(F.lit(1)).alias("area"),
                 (F.avg("y").cast("bigint") + offset[0]).alias("cy"), (F.avg("x").cast("bigint") + offset[1]).alias("cx"),
                 F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
                 *[e for c in channels for e in (F.avg(c).alias(c), F.var_pop(c).alias(f"{c}_var"))])


def vote_type(px: DataFrame, inst: str = "inst", type_: str = "type") -> DataFrame:
    """Majority class of an instance; ties go to the smaller class, and background gives
    way to the runner-up when there is one."""
    c = px.filter(F.col(inst) > 0).groupBy("img", inst, type_).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", (-F.col(type_)).alias("neg"))
    g = c.groupBy("img", inst).agg(F.sum("n").alias("area"), F.max(order).alias("top"),
                                   F.max(F.when(F.col(type_) != 0, order)).alias("fg"))
    pick = F.when((F.col("top.neg") == 0) & F.col("fg").isNotNull(), F.col("fg")).otherwise(F.col("top"))
    return g.select("img", inst, (-pick["neg"]).alias("type"), (pick["n"] / (F.col("area") + 1e-6)).alias("type_prob"))


def remap_labels(px: DataFrame, label: str, by_size: bool = False) -> DataFrame:
    """Contiguous labels 1..n per image, by id or by size (largest first)."""
    a = areas(px, label, "_l", "_n")
    order = [F.desc("_n"), "_l"] if by_size else ["_l"]
    num = row_index(a, ["img"], order, "_new").select("img", F.col("_l").alias(label), (F.col("_new") + 1).alias("new_label"))
    return px.join(num, ["img", label], "left").withColumn("new_label", F.coalesce("new_label", F.lit(0).cast("bigint")))


def offset_ids(df: DataFrame, group: str, local: str, out: str = "global_id") -> DataFrame:
    """Global id = local id + sum of the largest ids of all earlier groups."""
    top = df.groupBy(group).agg(F.max(local).alias("_m"))
    run = prefix_agg(top, [], [group], "_m", "_cum").select(group, (F.col("_cum") - F.col("_m")).alias("_off"))
    return df.join(run, group).withColumn(out, F.col(local) + F.col("_off")).drop("_off")


def offset_map(px: DataFrame, inst: str = "inst", min_size: int = 30) -> DataFrame:
    """Signed distance of each pixel to its instance's rounded centre, scaled to [-1, 1]
    on each side separately."""
    d = px.filter(F.col(inst) > 0)
    c = d.groupBy("img", inst).agg(F.count(F.lit(1)).alias("_n"), *[e for v in "xy" for e in (
        F.floor(F.avg(v) + 0.5).alias(f"_c{v}"), F.min(v).alias(f"_l{v}"), F.max(v).alias(f"_h{v}"))])
    d = d.join(c.filter(F.col("_n") >= min_size), ["img", inst])

    def scaled(v: str) -> Column:
        s, lo, hi = (F.col(k) + 1 - F.col(f"_c{v}") for k in (v, f"_l{v}", f"_h{v}"))
        return F.when(s < 0, -s / lo).when(s > 0, s / hi).otherwise(F.lit(0.0))

    return d.select("img", "y", "x", inst, scaled("x").alias("h"), scaled("y").alias("v"))


def reconcile(base: DataFrame, seam: DataFrame, boxes: DataFrame, cell: float = 64.0) -> DataFrame:
    """Merge re-segmented seam boxes into a base label table, one pass for all boxes.

    An existing instance wholly inside a box is dropped, one touching the box edge is
    kept; a new instance is added unless it overlaps a kept one.  New ids continue
    after the largest base id of the image.  Run once per tile set (boundary, then cross).
    Pixels meet boxes on grid cells of width ``cell`` (the usual box size)."""
    b = base.filter(F.col("inst") > 0)
    inside = join_boxes(b, boxes, ["img"], cell)
    edge = ((F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1") - 1)
            | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1") - 1))
    touch = inside.groupBy("img", "box", "inst").agg(F.max(edge).alias("edge"))
    drop = touch.filter(~F.col("edge")).select("img", "inst").distinct()
    # an anti join keeps the estimated size of its left side, here of exploded pixels
    kept = b.join(drop, ["img", "inst"], "left_anti").hint("merge")
    clash = (seam.filter(F.col("inst") > 0).join(kept.select("img", "y", "x"), ["img", "y", "x"], "left_semi")
             .select("img", "box", "inst").distinct())
    new = seam.filter(F.col("inst") > 0).join(clash, ["img", "box", "inst"], "left_anti")
    top = base.groupBy("img").agg(F.max("inst").alias("_top"))
    num = row_index(new.select("img", "box", "inst").distinct(), ["img"], ["box", "inst"], "_i").join(top, "img")
    new = new.join(num, ["img", "box", "inst"]).select("img", "y", "x", (F.col("_top") + F.col("_i") + 1).cast("bigint").alias("inst"))
    return kept.select("img", "y", "x", F.col("inst").cast("bigint").alias("inst")).unionByName(new)


def seg_scalars(px: DataFrame, types: list[int], keys: list[str] = ["img"], maps: list[str] = ["h"]) -> DataFrame:
    """Pixel accuracy, Dice and per-type Dice of label and type maps, and the mean squared error of offset maps.

    One row per ``keys``; without keys all images are pooled into one row.  The error is the mean over all pixels of
    all ``maps``, named after them."""
    t, p = F.col("true_id") > 0, F.col("pred_id") > 0

    def d(a: Column, b: Column) -> Column:
        return F.count_if(a & b) * 2.0 / (F.count_if(a) + F.count_if(b) + 1e-8)

    off = [F.avg(F.pow(F.col(f"true_{m}") - F.col(f"pred_{m}"), 2)) for m in maps]
    return px.groupBy(*keys).agg(
        F.avg((t == p).cast("int")).alias("pixel_acc"), d(t, p).alias("dice"),
        *[d(F.col("true_type") == k, F.col("pred_type") == k).alias(f"dice_{k}") for k in types],
        (sum(off[1:], off[0]) / len(off)).alias("mse_" + "".join(maps)))


def mean_scores(scores: DataFrame) -> DataFrame:
    """Number of images and the mean of every score over them; NULL scores do not count."""
    names = [c for c, t in scores.dtypes if t == "double"]
    return scores.agg(F.count(F.lit(1)).alias("n_images"), *[F.avg(c).alias(c) for c in names])
