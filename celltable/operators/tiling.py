"""Tile grids and polygon geometry as coordinate tables.

Grids are exploded from sequences per slide, row by row; no slide is crossed with
another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from celltable.functions.columns import col, scale_int
from celltable.operators.skew import row_index
from celltable.operators.spatial import join_boxes


def _steps(lo: Column, hi: Column, step: int) -> Column:
    """lo, lo+step, ... up to hi inclusive; empty when hi < lo."""
    return F.when(hi >= lo, F.sequence(lo.cast("bigint"), hi.cast("bigint"), F.lit(step).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))


def _cross(df: DataFrame, ys: Column, xs: Column, y: str = "y", x: str = "x") -> DataFrame:
    return df.withColumn(y, F.explode(ys)).withColumn(x, F.explode(xs))


def grid(slides: DataFrame, size: int, stride: int) -> DataFrame:
    """Whole tiles only."""
    z = F.lit(0)
    return _cross(slides, _steps(z, F.col("h") - size, stride), _steps(z, F.col("w") - size, stride))


def _valid(length: Column, win: int, step: int) -> Column:
    last = length - win
    edge = F.when((last >= 0) & (last % step != 0), F.array(last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(_steps(F.lit(0), last, step), edge)


def grid_valid(slides: DataFrame, win: int, step: int) -> DataFrame:
    """Grid plus one tile flush with the far edge where the grid does not end there."""
    return _cross(slides, _valid(F.col("h"), win, step), _valid(F.col("w"), win, step))


def grid_mirror(slides: DataFrame, win: int, step: int) -> DataFrame:
    """Valid grid on the image padded by win-step in total; positions in source pixels (may be negative)."""
    diff = win - step
    pad = diff // 2
    d = _cross(slides, _valid(F.col("h") + diff, win, step), _valid(F.col("w") + diff, win, step))
    return d.withColumns({"y": F.col("y") - pad, "x": F.col("x") - pad})


def reflect(c: Column, length: Column) -> Column:
    """Source pixel of a padded position, mirrored at the edge without repeating it."""
    a = F.abs(c)
    return F.when(a > length - 1, (length - 1) * 2 - a).otherwise(a)


def tile_corners(slides: DataFrame, size_in: int, size_out: int) -> DataFrame:
    """Input and output corners of tiles whose output is the centre of their input."""
    diff = size_in - size_out
    half = diff // 2

    def axis(length: Column) -> Column:
        n = F.floor((length - diff) / size_out) + 1
        return _steps(F.lit(half), F.lit(half) + (n - 1) * size_out, size_out)

    d = _cross(slides, axis(F.col("h")), axis(F.col("w")), "out_y", "out_x")
    return d.withColumns({"in_y": F.col("out_y") - half, "in_x": F.col("out_x") - half})


def seam_tiles(slides: DataFrame, tile: int = 2048, amb: int = 128) -> DataFrame:
    """Grid, boundary and cross tiles with ``kind``; boxes are y0,x0,y1,x1."""
    def starts(length: Column) -> Column:
        return _steps(F.lit(0), F.floor(length / tile) * tile, tile)

    d = slides.withColumns({"_ys": starts(F.col("h")), "_xs": starts(F.col("w"))})
    inner = lambda c: F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))

    def boxes(kind: str, ys: Column, xs: Column, dy: tuple[int, int], dx: tuple[int, int], clip: bool = False) -> DataFrame:
        b = _cross(d, ys, xs)
        y1, x1 = F.col("y") + dy[1], F.col("x") + dx[1]
        return b.select("slide_id", F.lit(kind).alias("kind"), (F.col("y") + dy[0]).alias("y0"), (F.col("x") + dx[0]).alias("x0"),
                        (F.least(y1, F.col("h")) if clip else y1).alias("y1"), (F.least(x1, F.col("w")) if clip else x1).alias("x1"))

    ys, xs = F.col("_ys"), F.col("_xs")
    whole, thin, wide = (0, tile), (-amb, amb), (-2 * amb, 2 * amb)
    return (boxes("grid", ys, xs, whole, whole, True)
            .unionByName(boxes("boundary", ys, inner("_xs"), whole, thin))
            .unionByName(boxes("boundary", inner("_ys"), xs, thin, whole))
            .unionByName(boxes("cross", inner("_ys"), inner("_xs"), wide, wide)))


def chunks(slides: DataFrame, chunk: int, size_in: int, size_out: int) -> DataFrame:
    """Patches with the chunk that owns them and the chunk's clipped input box.

    Chunk outputs tile the plane, so the owner is plain arithmetic, not a range join."""
    diff = size_in - size_out
    half = diff // 2
    step = (chunk - diff) // size_out * size_out
    d = tile_corners(slides, size_in, size_out)

    def box(c: str, length: str) -> tuple[Column, Column]:
        lo = F.floor((F.col(c) - half) / step) * step
        full = lo + step + diff
        cut = F.floor((F.col(length) - diff - lo) / size_out) * size_out + lo + diff
        return lo, F.when(full > F.col(length), cut).otherwise(full)

    (y0, y1), (x0, x1) = box("out_y", "h"), box("out_x", "w")
    return d.withColumns({"chunk_y0": y0, "chunk_x0": x0, "chunk_y1": y1, "chunk_x1": x1})


def grid_um(slides: DataFrame, patch: int, src_px: float, dst_px: float | None = None, overlap: int = 0) -> DataFrame:
    """Tiles of a physical size: source edge = round-half-even(patch * dst / src)."""
    size = round(patch * (1.0 if dst_px is None else dst_px / src_px))

    def axis(length: Column) -> Column:
        n = F.when(length <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil((length - overlap) / float(size - overlap))))
        return F.transform(_steps(F.lit(0), n - 1, 1), lambda i: i * size - F.greatest(i - 1, F.lit(0)) * overlap)

    return _cross(slides, axis(F.col("h")), axis(F.col("w"))).withColumn("size", F.lit(size))


def inside(tiles: DataFrame, w: int, h: int) -> DataFrame:
    """Tiles of w x h that do not leave the slide (slide size in columns w, h)."""
    return tiles.filter((F.col("x") + w <= F.col("w")) & (F.col("y") + h <= F.col("h")))


def thumb_step(h: Column, w: Column, ratio: float | None = None, min_side: int | None = None) -> Column:
    if ratio is not None:
        return F.lit(1 if ratio <= 1 else max(1, round(ratio)))
    if not min_side or min_side <= 0:
        return F.lit(1)
    return F.greatest(F.lit(1), F.floor(F.least(h, w) / min_side)).cast("int")


def micro_size(slides: DataFrame, share: float = 0.25) -> DataFrame:
    """Registration size (share of the smallest long side) and the slide with the largest area."""
    return slides.agg(F.floor(F.min(F.greatest("w", "h")) * share).alias("micro_size"),
                      F.max(F.struct((F.col("w") * F.col("h")).alias("a"), "slide_id"))["slide_id"].alias("largest"))


def cell_raster(cells: DataFrame, types: list[str], h: int, w: int, ratio: float = 32.0,
                clamp: tuple[float, float] = (0.5, 4.0)) -> DataFrame:
    """Thumbnail of typed cells: discs of the nucleus area, painted by type order; last wins.

    Cells of one type paint the same, so the largest type number of a pixel says all, and no cell id is read or sorted."""
    import math
    th, tw = max(1, math.ceil(h / ratio)), max(1, math.ceil(w / ratio))
    sy, sx = th / h, tw / w

    def pos(c: str, s: float, top: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(top - 1), F.rint(F.col(c) * s).cast("int")))

    rad = F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), F.sqrt(
        F.greatest(F.col("nucleus_area"), F.lit(1.0)) / 3.141592653589793) * (0.5 * (sx + sy))))
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("cell_type"))
    d = cells.select("slide_id", rank.alias("_t"), pos("y", sy, th).alias("cy"), pos("x", sx, tw).alias("cx"), rad.alias("_r"))
    reach = F.ceil("_r").cast("int")
    d = d.withColumn("_dy", F.explode(F.sequence(-reach, reach))).withColumn("_dx", F.explode(F.sequence(-reach, reach)))
    d = d.withColumns({"ty": F.col("cy") + F.col("_dy"), "tx": F.col("cx") + F.col("_dx")}).filter(
        (F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx") <= F.col("_r") * F.col("_r"))
        & F.col("ty").between(0, th - 1) & F.col("tx").between(0, tw - 1))
    # other types have number 0 and go last: a filter on the number would be moved down to the scan, with all of its typing in it
    top = d.groupBy("slide_id", "ty", "tx").agg(F.max("_t").alias("_t")).filter(F.col("_t") > 0)
    return top.select("slide_id", "ty", "tx", F.element_at(F.array(*[F.lit(t) for t in types]), F.col("_t").cast("int")).alias("cell_type"))


# ---- polygons -----------------------------------------------------------------------

def ring_area(pts: Column | str) -> Column:
    """Shoelace area of a closed ring given as array<struct<x,y>>."""
    p = col(pts)
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2.0


def contour_area(rings: DataFrame, pixel: float = 1.0) -> DataFrame:
    """Outer area minus hole areas of each contour, in squared units."""
    a = F.when(F.col("is_hole"), -ring_area("pts")).otherwise(ring_area("pts"))
    return rings.groupBy("slide_id", "tissue_id").agg((F.sum(a) * (pixel * pixel)).alias("area"))


def top_holes(rings: DataFrame, n: int = 5, min_area: float = 0.0, pixel: float = 1.0) -> DataFrame:
    """The n largest holes of each contour above a minimum area."""
    h = rings.filter("is_hole").withColumn("area", ring_area("pts") * (pixel * pixel)).filter(F.col("area") > min_area)
    return row_index(h, ["slide_id", "tissue_id"], [F.desc("area"), "ring"], "_i").filter(F.col("_i") < n).drop("_i")


def tissue_rings(rings: DataFrame, min_area: float, min_hole: float, n_holes: int = 5, pixel: float = 1.0,
                 scale: float = 1.0) -> DataFrame:
    """Contours of enough area with their largest holes, scaled back; ``slides_without_tissue`` names the slides left with none."""
    keep = contour_area(rings, pixel).filter(F.col("area") > min_area)
    holes = top_holes(rings, n_holes, min_hole, pixel).select(*rings.columns)
    out = rings.filter(~F.col("is_hole")).unionByName(holes).join(keep.select("slide_id", "tissue_id"), ["slide_id", "tissue_id"], "left_semi")
    out = out.withColumn("pts", F.transform("pts", lambda p: F.struct(
        scale_int(p["x"], scale).alias("x"), scale_int(p["y"], scale).alias("y"))))
    return out


def slides_without_tissue(rings: DataFrame, min_area: float, pixel: float = 1.0) -> DataFrame:
    """Error rows (slide_id, reason) of the slides whose contours are all too small."""
    keep = contour_area(rings, pixel).filter(F.col("area") > min_area).select("slide_id").distinct()
    lost = rings.select("slide_id").distinct().join(keep, "slide_id", "left_anti")
    return lost.withColumn("reason", F.lit("no tissue left"))


def segments(rings: DataFrame) -> DataFrame:
    p = F.col("pts")
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    return (rings.select("slide_id", "tissue_id", F.explode(F.arrays_zip(p.alias("a"), nxt.alias("b"))).alias("s"))
            .select("slide_id", "tissue_id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
                    F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")))


def points_in_polygons(points: DataFrame, rings: DataFrame, band: float = 256.0) -> DataFrame:
    """Points strictly inside the union of a slide's contours (even-odd per contour, holes
    count; the outline itself is outside).  Segments meet points in horizontal bands."""
    s = segments(rings)
    lo, hi = F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band)
    s = s.withColumn("_band", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("_band", F.floor(F.col("y") / band))
    px, py, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    on = (cross == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
    up = by > ay
    hit = ((ay > py) != (by > py)) & F.when(up, cross > 0).otherwise(cross < 0)
    j = p.join(s, ["slide_id", "_band"]).filter(hit | on)
    one = j.groupBy(*points.columns, "tissue_id").agg(F.count_if(hit).alias("_h"), F.max(on).alias("_on"))
    return one.filter((F.col("_h") % 2 == 1) & ~F.col("_on")).select(*points.columns).distinct()


def bbox_join(points: DataFrame, rings: DataFrame, margin: float, cell: float = 512.0) -> DataFrame:
    """Points within a contour's bounding box grown by a margin, each once."""
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    box = rings.groupBy("slide_id", "tissue_id").agg(
        (F.min(F.array_min(xs)) - margin).alias("x0"), (F.max(F.array_max(xs)) + margin).alias("x1"),
        (F.min(F.array_min(ys)) - margin).alias("y0"), (F.max(F.array_max(ys)) + margin).alias("y1")).drop("tissue_id")
    return join_boxes(points, box, ["slide_id"], cell).select(*points.columns).distinct()


def patches_in_tissue(tiles: DataFrame, rings: DataFrame, size: int) -> DataFrame:
    """Tiles with at least one corner inside the tissue, after a bounding-box cut."""
    near = bbox_join(tiles.select("slide_id", "y", "x"), rings, float(size))
    c = near.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                                                  for a in (0, size) for b in (0, size)])))
    c = c.select("slide_id", F.col("y").alias("ty"), F.col("x").alias("tx"),
                 (F.col("x") + F.col("_o.b")).cast("double").alias("x"), (F.col("y") + F.col("_o.a")).cast("double").alias("y"))
    hit = points_in_polygons(c, rings).select("slide_id", F.col("ty").alias("y"), F.col("tx").alias("x")).distinct()
    return tiles.join(hit, ["slide_id", "y", "x"], "left_semi")


def polygon_mask(slides: DataFrame, rings: DataFrame, scale: float) -> DataFrame:
    """Foreground pixels of the tissue on a grid of h/scale x w/scale, tested at pixel centres."""
    size = {c: F.floor(F.col(c) / scale) for c in "hw"}
    lines = (slides.select("slide_id", F.explode(_steps(F.lit(0), size["h"] - 1, 1)).alias("y"), size["w"].alias("w"))
             .groupBy("slide_id", "y").agg(F.max("w").alias("w")))
    # a pixel row meets the segments that reach its height; only those travel, never pixels
    s = segments(rings)
    lo, hi = F.ceil(F.least("ay", "by") / scale - 0.5), F.floor(F.greatest("ay", "by") / scale - 0.5)
    s = s.select("slide_id", "tissue_id", F.struct("ax", "ay", "bx", "by").alias("s"), F.explode(_steps(lo - 1, hi + 1, 1)).alias("y"))
    py, px = (F.col("y") + 0.5) * scale, (F.col("x") + 0.5) * scale

    def cross(s: Column) -> Column:
        return (s["bx"] - s["ax"]) * (py - s["ay"]) - (s["by"] - s["ay"]) * (px - s["ax"])

    def hit(s: Column) -> Column:
        return ((s["ay"] > py) != (s["by"] > py)) & F.when(s["by"] > s["ay"], cross(s) > 0).otherwise(cross(s) < 0)

    def on(s: Column) -> Column:
        return (cross(s) == 0) & px.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & py.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))

    tissue = s.groupBy("slide_id", "y", "tissue_id").agg(F.collect_list("s").alias("t")).groupBy("slide_id", "y").agg(F.collect_list("t").alias("ts"))
    inside = F.exists("ts", lambda t: (F.size(F.filter(t, hit)) % 2 == 1) & ~F.exists(t, on))
    return (lines.join(tissue, ["slide_id", "y"]).withColumn("x", F.explode(_steps(F.lit(0), F.col("w") - 1, 1)))
            .filter(inside).select("slide_id", "y", "x"))


def tiles_on_mask(tiles: DataFrame, mask: DataFrame, ratio: float, size: int) -> DataFrame:
    """Tiles with any foreground under their scaled, rounded box."""
    b = tiles.select("slide_id", F.col("y").alias("ty"), F.col("x").alias("tx"),
                     *[F.rint((F.col(c) + d) * ratio).alias(f"{c}{i}") for c in "xy" for i, d in ((0, 0), (1, size))])
    hit = join_boxes(mask.select("slide_id", "y", "x"), b, ["slide_id"], max(1.0, size * ratio))
    hit = hit.select("slide_id", F.col("ty").alias("y"), F.col("tx").alias("x")).distinct()
    return tiles.join(hit, ["slide_id", "y", "x"], "left_semi")


def flag_tiles(tiles: DataFrame, size: int, w: str = "w", h: str = "h") -> DataFrame:
    return tiles.withColumn("overlaps_edge", (F.col("x") + size > F.col(w)) | (F.col("y") + size > F.col(h)))
