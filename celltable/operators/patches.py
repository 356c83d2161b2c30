"""Patch feature tables: one row per (slide, patch), all slides in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.functions import columns as C
from celltable.functions.columns import CELL_TYPES, COEXPRESSION_PAIRS, MARKERS
from celltable.operators.skew import deviation, group_mad, has_hot_group, join_same, pick, quantiles, stored

PATCH = ["slide_id", "patch_id"]
EPS = 1e-6
PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def with_patch(cells: DataFrame) -> DataFrame:
    return cells.withColumn("patch_id", C.patch_id("cell_id"))


def area_aggs() -> list[Column]:
    a = F.col("nucleus_area")
    return [F.sum(a).alias("nucleus_area_sum"), F.avg(a).alias("nucleus_area_mean"),
            F.stddev_samp(a).alias("nucleus_area_sd")]


def coefficient_of_variation(c: str) -> Column:
    """Sample sd over mean; sd counts as 0 for one row, NULL when the mean is 0."""
    return F.try_divide(F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0))), F.avg(c))


def safe_skew(c: str) -> Column:
    return F.when(F.count(c) > 2, F.skewness(c))


def safe_kurtosis(c: str) -> Column:
    return F.when(F.count(c) > 3, F.kurtosis(c))


def type_composition(typed: DataFrame, keys: list[str] = PATCH, types: list[str] = CELL_TYPES,
                     column: str = "cell_type_retyped") -> DataFrame:
    """Counts, fractions and entropy per group over a fixed type list, so the schema never varies."""
    counts = typed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.count_if(F.col(column) == t).alias(f"type_count__{t}") for t in types])
    return counts.select(
        *keys, "n_cells", *[F.col(f"type_count__{t}") for t in types],
        *[(F.col(f"type_count__{t}") / F.col("n_cells")).alias(f"type_frac__{t}") for t in types],
        C.entropy2([F.col(f"type_count__{t}") for t in types]).alias("type_entropy"))


def marker_moments(markers: list[str]) -> list[Column]:
    out = []
    for m in markers:
        out += [F.avg(m).alias(f"{m}__mean"), F.stddev_samp(m).alias(f"{m}__sd"),
                coefficient_of_variation(m).alias(f"{m}__cv"),
                safe_skew(m).alias(f"{m}__skew"), safe_kurtosis(m).alias(f"{m}__kurt")]
    return out


def positivity_rates(markers: list[str]) -> list[Column]:
    return [e for m in markers for e in (F.avg(f"{m}_pos").alias(f"{m}_pos_rate"),
                                         F.avg(f"{m}_strong").alias(f"{m}_strong_rate"))]


def coexpression(pairs: list[tuple[str, str]] = COEXPRESSION_PAIRS) -> list[Column]:
    return [F.avg(((F.col(f"{a}_pos") == 1) & (F.col(f"{b}_pos") == 1)).cast("int")).alias(f"coexp__{a}_{b}__rate")
            for a, b in pairs]


def quantile_features(cells: DataFrame, keys: list[str], cols: list[str], split: bool | None = None) -> DataFrame:
    """Median, IQR, p10/p25/p75/p90 and MAD of every column (two passes, both on the raw columns)."""
    if split is None:
        split = has_hot_group(cells, keys)
    q = quantiles(cells, keys, cols, PROBS, split=split)
    q = q.select(*keys, *[e for c in cols for e in (
        *[F.col(f"{c}_q")[i].alias(f"{c}_{n}") for i, n in enumerate(["p10", "p25", "med", "p75", "p90"])],)])
    mad = group_mad(cells, keys, cols, q, split=split)
    return join_same(q, mad, keys).select(*keys, *[e for c in cols for e in (
        F.col(f"{c}_med"), F.col(f"{c}_mad"), (F.col(f"{c}_p75") - F.col(f"{c}_p25")).alias(f"{c}_iqr"),
        F.col(f"{c}_p10"), F.col(f"{c}_p25"), F.col(f"{c}_p75"), F.col(f"{c}_p90"))])


def ratios(feats: DataFrame) -> DataFrame:
    """Lineage fractions and balance ratios; an absent type counts as zero."""
    def n(t: str) -> Column:
        c = f"type_count__{t}"
        return F.col(c) if c in feats.columns else F.lit(0)

    def rate(c: str) -> Column:
        return F.col(c) if c in feats.columns else F.lit(0.0)

    total = F.col("n_cells") + EPS
    cd4, cd8, treg, b, mac = (n(t) for t in ("CD4 T", "CD8 T", "Treg", "B cell", "Macrophage"))
    t_all = n("T cell") + cd4 + cd8 + treg
    return feats.withColumns({
        "frac_T_lineage": t_all / total, "frac_CD4T": cd4 / total, "frac_CD8T": cd8 / total,
        "frac_Treg": treg / total, "frac_Bcell": b / total, "frac_Myeloid": mac / total,
        "T_B_ratio": t_all / (b + EPS), "T_myeloid_ratio": t_all / (mac + EPS),
        "CD4_CD8_count_ratio": (cd4 + EPS) / (cd8 + EPS),
        "CD4_CD8_posratio": (rate("CD4_pos_rate") + EPS) / (rate("CD8_pos_rate") + EPS),
        "CD4_CD8_strongratio": (rate("CD4_strong_rate") + EPS) / (rate("CD8_strong_rate") + EPS),
        "CD8_to_suppressive_ratio": (cd8 + EPS) / (treg + mac + EPS)})


def immunoscore(feats: DataFrame, by_slide: bool = False) -> DataFrame:
    """Sum of the CD3 and CD8 positivity z-scores over the patches of a slide.

    Slide moments are aggregated (map-side combined) and joined back, so a slide with most patches is no hot task;
    ``by_slide`` takes a window instead, for slides that fit one task and lie together already."""
    rates = ["CD3_pos_rate", "CD8_pos_rate"]
    if by_slide:
        w = Window.partitionBy("slide_id")
        z = [(F.col(r) - F.avg(r).over(w)) / (F.stddev_samp(r).over(w) + EPS) for r in rates]
        return feats.withColumn("immunoscore_proxy", z[0] + z[1])
    m = feats.groupBy("slide_id").agg(*[e for r in rates for e in (
        F.avg(r).alias(f"{r}_m"), F.stddev_samp(r).alias(f"{r}_s"))])
    z = [(F.col(r) - F.col(f"{r}_m")) / (F.col(f"{r}_s") + EPS) for r in rates]
    return (join_same(feats, m, ["slide_id"]).withColumn("immunoscore_proxy", z[0] + z[1])
            .drop(*[f"{r}_{s}" for r in rates for s in "ms"]))


def composition_report(typed: DataFrame) -> DataFrame:
    """Per slide and patch: counts, fractions, entropy and density."""
    d = with_patch(typed)
    comp = d.groupBy(*PATCH).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("nucleus_area").alias("nucleus_area_sum"),
        *[F.count_if(F.col("cell_type_retyped") == t).alias(f"type_count__{t}") for t in CELL_TYPES])
    return comp.select(
        *PATCH, "n_cells", *[F.col(f"type_count__{t}") for t in CELL_TYPES],
        *[(F.col(f"type_count__{t}") / F.col("n_cells")).alias(f"type_frac__{t}") for t in CELL_TYPES],
        C.entropy2([F.col(f"type_count__{t}") for t in CELL_TYPES]).alias("type_entropy"),
        (F.col("n_cells") / (F.col("nucleus_area_sum") + EPS)).alias("cell_density_proxy"))


def patch_features(typed: DataFrame, markers: list[str] = MARKERS, split: bool | None = None) -> DataFrame:
    """The wide patch table: area, composition, marker statistics, co-positivity,
    per-cell variance summaries, immunoscore and ratios."""
    d = typed if "patch_id" in typed.columns else with_patch(typed)
    var = [f"{m}_var" for m in markers if f"{m}_var" in d.columns]
    # a slide that fits one task has no hot patch either
    by_slide = split is None and not has_hot_group(d, ["slide_id"])
    if split is None:
        split = not by_slide and has_hot_group(d, PATCH)
    cols = ["nucleus_area", *markers]
    raw = d.select(*PATCH, *cols, *var)
    # a hot patch is added up in a few slices; dealt at random, every task would send a row of sums for almost every patch
    base = d.repartition(*PATCH, F.pmod(F.xxhash64(*cols) + F.spark_partition_id(), F.lit(4))) if split else d if by_slide else d.repartition(*PATCH)
    # without a hot patch the values ride in the same aggregate as everything else
    inline = [] if split else [F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"{c}_v") for c in [*cols, *var]]
    base = base.groupBy(*PATCH).agg(
        F.count(F.lit(1)).alias("n_cells"), *area_aggs(),
        *[F.count_if(F.col("cell_type_retyped") == t).alias(f"type_count__{t}") for t in CELL_TYPES],
        *marker_moments(markers), *positivity_rates(markers), *coexpression(),
        *[e for v in var for e in (F.avg(v).alias(f"{v}__mean"), F.stddev_samp(v).alias(f"{v}__sd"))], *inline)
    if split:
        q = stored(quantiles(raw, PATCH, [*cols, *var], PROBS, split=True))
        med = q.select(*PATCH, *[F.col(f"{c}_q")[2].alias(f"{c}_med") for c in cols])
        f = join_same(join_same(base, q, PATCH), group_mad(raw.select(*PATCH, *cols), PATCH, cols, med, split=True), PATCH)
    else:
        f = base.withColumns({f"{c}_q": F.array(*[pick(F.col(f"{c}_v"), p) for p in PROBS]) for c in [*cols, *var]})
        f = f.withColumns({f"{c}_mad": deviation(F.col(f"{c}_v"), F.col(f"{c}_q")[2]) for c in cols}).drop(*[f"{c}_v" for c in [*cols, *var]])
    names = ["p10", "p25", "med", "p75", "p90"]
    f = f.withColumns({f"{c}_{n}": F.col(f"{c}_q")[i] for c in cols for i, n in enumerate(names)})
    f = f.withColumns({**{f"{c}_iqr": F.col(f"{c}_p75") - F.col(f"{c}_p25") for c in cols},
                       **{f"{v}__median": F.col(f"{v}_q")[2] for v in var}})
    f = f.withColumns({
        "cell_density_proxy": F.col("n_cells") / (F.col("nucleus_area_sum") + EPS),
        **{f"type_frac__{t}": F.col(f"type_count__{t}") / F.col("n_cells") for t in CELL_TYPES},
        "type_entropy": C.entropy2([F.col(f"type_count__{t}") for t in CELL_TYPES])})
    f = ratios(immunoscore(f, by_slide))
    order = ["n_cells", "nucleus_area_sum", "nucleus_area_mean", F.col("nucleus_area_med").alias("nucleus_area_median"),
             "nucleus_area_sd", "nucleus_area_mad", "nucleus_area_iqr", "cell_density_proxy"]
    for t in CELL_TYPES:
        order += [f"type_count__{t}", f"type_frac__{t}"]
    order += ["type_entropy"]
    for m in markers:
        order += [f"{m}__mean", F.col(f"{m}_med").alias(f"{m}__median"), f"{m}__sd", f"{m}__cv",
                  F.col(f"{m}_mad").alias(f"{m}__mad"), F.col(f"{m}_iqr").alias(f"{m}__iqr"),
                  f"{m}__skew", f"{m}__kurt",
                  *[F.col(f"{m}_{p}").alias(f"{m}__{p}") for p in ("p10", "p25", "p75", "p90")],
                  f"{m}_pos_rate", f"{m}_strong_rate"]
    order += [f"coexp__{a}_{b}__rate" for a, b in COEXPRESSION_PAIRS]
    order += [f"{v}__{s}" for v in var for s in ("mean", "median", "sd")]
    order += ["immunoscore_proxy", "frac_T_lineage", "frac_CD4T", "frac_CD8T", "frac_Treg", "frac_Bcell",
              "frac_Myeloid", "T_B_ratio", "T_myeloid_ratio", "CD4_CD8_count_ratio", "CD4_CD8_posratio",
              "CD4_CD8_strongratio", "CD8_to_suppressive_ratio"]
    return f.select(*PATCH, *order)


def slide_features(feats: DataFrame) -> DataFrame:
    """Mean of every numeric patch feature per slide."""
    num = [c for c, t in feats.dtypes if c not in PATCH and t in ("double", "bigint", "int", "float")]
    return feats.groupBy("slide_id").agg(*[F.avg(c).alias(c) for c in num])


def summary(df: DataFrame, keys: list[str], c: str, split: bool | None = None) -> DataFrame:
    """Mean, median, sd (0 for one row), IQR and max per group."""
    q = quantiles(df, keys, [c], [0.25, 0.5, 0.75], split=split)
    m = df.groupBy(*keys).agg(F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"),
                              F.max(c).alias("max"))
    return join_same(m, q, keys).select(*keys, "mean", F.col(f"{c}_q")[1].alias("median"), "sd",
                                  (F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0]).alias("iqr"), "max")


# ---- feature dictionary -------------------------------------------------------------

def feature_dictionary(feats: DataFrame) -> DataFrame:
    """Name and description of each feature column, built from the naming scheme."""
    stat = {"mean": "Mean", "median": "Median", "sd": "Standard deviation", "cv": "Coefficient of variation",
            "mad": "Median absolute deviation", "iqr": "Interquartile range", "skew": "Skewness", "kurt": "Kurtosis",
            "p10": "10th percentile", "p25": "25th percentile", "p75": "75th percentile", "p90": "90th percentile"}

    def describe(c: str) -> str:
        head, _, tail = c.rpartition("__")
        if c.startswith("type_count__"):
            return f"Number of {tail} cells"
        if c.startswith("type_frac__"):
            return f"Share of {tail} cells"
        if c.startswith("coexp__"):
            return f"Share of cells positive for both markers of {c.split('__')[1]}"
        if tail in stat and head:
            return f"{stat[tail]} of {head}"
        if c.endswith("_pos_rate"):
            return f"Share of cells at or above the weak cut of {c[:-9]}"
        if c.endswith("_strong_rate"):
            return f"Share of cells at or above the strong cut of {c[:-12]}"
        return c.replace("_", " ")

    rows = [(c, (feats.schema[c].metadata or {}).get("comment") or describe(c))
            for c in feats.columns if c not in PATCH]
    return feats.sparkSession.createDataFrame(rows, "feature string, description string")
