"""Pixel tables: thresholds, blending and image quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.functions.columns import delta_e76, srgb_to_lab
from celltable.operators.skew import quantiles


def gate_dark(px: DataFrame, value: str, keys: list[str], limit: float = 5) -> DataFrame:
    """Keys whose mean value reaches the limit."""
    return px.groupBy(*keys).agg(F.avg(value).alias("mean")).filter(F.col("mean") >= limit)


def qc_patches(mask: DataFrame, dapi: DataFrame, keys: list[str] = ["img"], min_mask: float = 50, min_dapi: float = 50) -> DataFrame:
    """Keep flag per patch: enough mask pixels and a bright enough nuclear channel."""
    a = mask.groupBy(*keys).agg((F.sum("value") / 255.0).alias("mask_area"))
    b = dapi.groupBy(*keys).agg(F.max("value").alias("dapi_max"))
    d = a.join(b, keys)
    return d.withColumn("kept", ~((F.col("mask_area") < min_mask) | (F.col("dapi_max") < min_dapi)))


def otsu(px: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Otsu threshold of 8-bit values per group, from a histogram of at most 256 rows per group."""
    h = px.groupBy(*keys, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy(*keys).orderBy("v")
    up, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    s = F.col("n") * F.col("v")
    h = h.withColumns({"w1": F.sum("n").over(up), "w2": F.sum("n").over(rest), "s1": F.sum(s).over(up), "s2": F.sum(s).over(rest)})
    gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    var = F.when(F.col("w2") > 0, F.col("w1") * F.col("w2") * gap * gap)
    best = h.groupBy(*keys).agg(F.max(F.struct(F.coalesce(var, F.lit(-1.0)).alias("s"), (-F.col("v")).alias("neg")))["neg"].alias("neg"))
    return best.select(*keys, (-F.col("neg")).alias("threshold"))


def otsu_or_p60(px: DataFrame, value: str, keys: list[str], split: bool | None = None) -> DataFrame:
    """Otsu, or max(8, 60th percentile) when it leaves less than 0.1 % foreground."""
    t = otsu(px, value, keys)
    fg = px.join(t, keys).groupBy(*keys).agg(F.avg((F.col(value) > F.col("threshold")).cast("int")).alias("fg"))
    q = quantiles(px, keys, [value], [0.6], split=split)
    d = t.join(fg, keys).join(q, keys)
    return d.select(*keys, F.when(F.col("fg") < 0.001, F.greatest(F.lit(8.0), F.col(f"{value}_q")[0]))
                    .otherwise(F.col("threshold").cast("double")).alias("threshold"), "fg")


def center_crop(px: DataFrame, h: int, w: int, ch: int, cw: int, rule: str = "half") -> DataFrame:
    """Pixels of the centred window; ``half`` uses h//2 - ch//2, ``diff`` int((h - ch) / 2)."""
    if ch > h or cw > w:
        raise ValueError(f"crop {ch}x{cw} is larger than image {h}x{w}")
    y0, x0 = (h // 2 - ch // 2, w // 2 - cw // 2) if rule == "half" else (int((h - ch) * 0.5), int((w - cw) * 0.5))
    return px.filter((F.col("y") >= y0) & (F.col("y") < y0 + ch) & (F.col("x") >= x0) & (F.col("x") < x0 + cw))


def blend_tiles(px: DataFrame, keys: list[str] = ["slide_id", "ch"], invert: bool = False) -> DataFrame:
    """Mean of all tile values on a pixel, truncated to 8 bits."""
    m = F.floor(F.avg("value"))
    return px.groupBy(*keys, "y", "x").agg((255 - m if invert else m).cast("int").alias("value"))


def assemble_channels(px: DataFrame, keys: list[str], channel: str, value: str, channels: list[str]) -> DataFrame:
    """One row per pixel with all wanted channels; rows lacking any are dropped."""
    return (px.groupBy(*keys).pivot(channel, channels).agg(F.any_value(value)).na.drop(subset=channels))


def pair_quality(px: DataFrame, keys: list[str] = ["img"]) -> DataFrame:
    """PSNR, mean colour difference and Pearson correlation of (r,g,b) against (r2,g2,b2)."""
    pairs = [("r", "r2"), ("g", "g2"), ("b", "b2")]

    def total(f) -> Column:
        parts = [F.sum(f(F.col(a).cast("double"), F.col(b).cast("double"))) for a, b in pairs]
        return parts[0] + parts[1] + parts[2]

    n = F.count(F.lit(1)) * 3.0
    de = delta_e76(srgb_to_lab("r", "g", "b"), srgb_to_lab("r2", "g2", "b2"))
    d = px.groupBy(*keys).agg(total(lambda a, b: (a - b) * (a - b)).alias("se"), n.alias("n"), F.avg(de).alias("delta_e"),
                              total(lambda a, b: a).alias("sa"), total(lambda a, b: b).alias("sb"),
                              total(lambda a, b: a * a).alias("saa"), total(lambda a, b: b * b).alias("sbb"),
                              total(lambda a, b: a * b).alias("sab"))
    mse = F.col("se") / F.col("n")
    va, vb = (F.col(f"s{k}{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n") for k in "ab")
    r = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), F.sqrt(va * vb))
    return d.select(*keys, F.when(mse > 0, F.log10(F.lit(255.0 * 255.0) / mse) * 10.0).alias("psnr"), "delta_e", r.alias("pearson"))


def quality_by_group(px: DataFrame, groups: list[str], image: str = "img") -> DataFrame:
    """Number of image pairs and mean PSNR, colour difference, correlation and structural similarity of every group.

    All pairs count.  The PSNR of equal images is NULL and an image smaller than the window has no similarity; such
    values do not enter their mean."""
    of = px.groupBy(image).agg(*[F.min(g).alias(g) for g in groups])
    scores = pair_quality(px, [image]).join(ssim(px, [image]), image, "left").join(of, image)
    return scores.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_images"),
                                       *[F.avg(c).alias(c) for c in ("psnr", "delta_e", "pearson", "ssim")])


def box_mean(px: DataFrame, keys: list[str], values: list[str], radius: int = 3) -> DataFrame:
    """Sliding square means of dense images; only pixels with a complete window remain.

    Two passes of a short frame: along x inside one image row, then along y inside one
    image column, so no task holds a whole image."""
    frame = (-radius, radius)
    wx = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(*frame)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(*frame)
    d = px.select(*keys, "y", "x", *[F.sum(v).over(wx).alias(v) for v in values], F.count(F.lit(1)).over(wx).alias("_n"))
    d = d.select(*keys, "y", "x", *[F.sum(v).over(wy).alias(v) for v in values], F.sum("_n").over(wy).alias("_n"))
    full = (2 * radius + 1) ** 2
    return d.filter(F.col("_n") == full).select(*keys, "y", "x", *[(F.col(v) / float(full)).alias(v) for v in values])


def ssim(px: DataFrame, keys: list[str] = ["img"], radius: int = 3, data_range: float = 255.0) -> DataFrame:
    """Mean structural similarity of (r,g,b) against (r2,g2,b2), averaged over channels."""
    long = px.select(*keys, "y", "x", F.explode(F.array(*[
        F.struct(F.lit(c).alias("ch"), F.col(c).cast("double").alias("a"), F.col(f"{c}2").cast("double").alias("b"))
        for c in ("r", "g", "b")])).alias("e")).select(*keys, "y", "x", "e.*")
    long = long.withColumns({"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    m = box_mean(long, [*keys, "ch"], ["a", "b", "aa", "bb", "ab"], radius)
    n = (2 * radius + 1) ** 2
    k = n / (n - 1.0)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    a, b = F.col("a"), F.col("b")
    va, vb, cab = (F.col("aa") - a * a) * k, (F.col("bb") - b * b) * k, (F.col("ab") - a * b) * k
    s = ((a * b * 2.0 + c1) * (cab * 2.0 + c2)) / ((a * a + b * b + c1) * (va + vb + c2))
    return (m.groupBy(*keys, "ch").agg(F.avg(s).alias("s")).groupBy(*keys).agg(F.avg("s").alias("ssim")))


# Colour and weight of each channel, its percentile range and gain.
CHANNEL_STYLE = {
    "DAPI": (0.10, 0.10, 1.00, 0.15, 3, 99.0, 0.6),
    "Foxp3": (0.85, 0.25, 0.85, 0.55, 2, 99.4, 0.85),
    "CD19": (0.05, 0.90, 0.70, 0.70, 2, 99.4, 1.00),
    "CD68": (1.00, 0.50, 0.15, 0.85, 3, 99.8, 1.10),
    "CD4": (0.15, 0.95, 0.20, 0.85, 2, 99.8, 1.15),
    "CD3": (0.95, 0.15, 0.55, 0.65, 2, 99.6, 0.95),
    "CD8": (0.85, 0.10, 0.75, 0.60, 2, 99.6, 0.90),
    "SampleAF": (0.70, 0.95, 0.20, 0.08, 20, 99.9, 0.30),
}


def composite(px: DataFrame, channels: list[str], clip_q: float = 0.999, gain: float = 0.78, gamma: float = 1.12,
              contrast: float = 1.05, split: bool | None = None) -> DataFrame:
    """False-colour image from tiles (slide_id, tile, y, x, one column per channel): each
    channel is scaled per tile, coloured, summed, averaged over overlaps and toned."""
    d = px
    by_range: dict[tuple[float, float], list[str]] = {}
    for c in channels:
        by_range.setdefault(CHANNEL_STYLE[c][4:6], []).append(c)
    probs = sorted({p / 100.0 for r in by_range for p in r})
    q = quantiles(px, ["slide_id", "tile"], channels, probs, split=split)
    d = d.join(q, ["slide_id", "tile"])
    rgb = [F.lit(0.0)] * 3
    for c in channels:
        *color, weight, lo, hi, g = CHANNEL_STYLE[c]
        low, high = F.col(f"{c}_q")[probs.index(lo / 100.0)], F.col(f"{c}_q")[probs.index(hi / 100.0)]
        width = F.when(high <= low, F.lit(1.0)).otherwise(high - low)
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low) / width))
        rgb = [acc + v * (k * weight * g) for acc, k in zip(rgb, color)]
    names = ["r", "g", "b"]

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    d = d.select("slide_id", "y", "x", *[e.alias(n) for e, n in zip(rgb, names)]).groupBy("slide_id", "y", "x").agg(
        F.count(F.lit(1)).alias("_w"), *[F.sum(n).alias(n) for n in names])
    d = d.select("slide_id", "y", "x", *[unit(F.col(n) / (F.col("_w") + 1e-8)).alias(n) for n in names])
    top = quantiles(d, ["slide_id"], names, [clip_q], split=split)
    d = d.join(top, "slide_id")

    def tone(n: str) -> Column:
        t = F.col(f"{n}_q")[0]
        c = F.when(t > 0, unit(F.col(n) / F.when(t > 0, t))).otherwise(F.col(n))
        c = F.pow(unit(c * gain), F.lit(gamma))
        return F.floor(unit((c - 0.5) * contrast + 0.5) * 255).cast("int")

    return d.select("slide_id", "y", "x", *[tone(n).alias(n) for n in names])
