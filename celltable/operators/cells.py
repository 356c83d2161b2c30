"""Cell tables: cleaning, slide thresholds, marker flags and cell typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.functions import columns as C
from celltable.functions.columns import CELL_TYPES, MARKERS
from celltable.operators.skew import has_hot_group, join_same, quantiles

SLIDE = ["slide_id"]
CORE = ["cell_id", "x", "y", "nucleus_area"]


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_cells(df: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """Coerce numbers (unreadable, NaN, infinite -> NULL), keep ids as text and
    drop rows without position or area."""
    require(df, ["slide_id", *CORE, *markers])
    var = [f"{m}_var" for m in markers if f"{m}_var" in df.columns]
    num = {c: C.coerce_number(c) for c in ["x", "y", "nucleus_area", *markers, *var]}
    out = df.withColumns({"cell_id": F.col("cell_id").cast("string"), **num})
    return out.na.drop(subset=["x", "y", "nucleus_area"])


def select_used(df: DataFrame, used: list[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in used if c in df.columns])


def thresholds(cells: DataFrame, markers: list[str] = MARKERS, q_low: float = 0.6, q_high: float = 0.85,
               fixed: dict[str, dict[str, float]] | None = None, dapi_q: float = 0.2,
               split: bool | None = None) -> DataFrame:
    """Weak and strong cut per slide and marker (one row per slide), plus ``DAPI_low``.

    Fixed values win over quantiles and strong is never below weak."""
    q = quantiles(cells, SLIDE, markers, [q_low, q_high, dapi_q], split=split)
    return q.select("slide_id", *cut_columns(markers, fixed))


def cut_columns(markers: list[str], fixed: dict[str, dict[str, float]] | None = None) -> list[Column]:
    """Cut columns from the quantile arrays ``<m>_q``: low, high and the one for dim cells."""
    fixed, out = fixed or {}, []
    for m in markers:
        f = fixed.get(m, {})
        weak = F.lit(float(f["weak"])) if "weak" in f else F.col(f"{m}_q")[0]
        strong = F.lit(float(f["strong"])) if "strong" in f else F.col(f"{m}_q")[1]
        out += [weak.alias(f"{m}_weak"), F.greatest(weak, strong).alias(f"{m}_strong_cut")]
    return out + ([F.col("DAPI_q")[2].alias("DAPI_low")] if "DAPI" in markers else [])


def flag_markers(cells: DataFrame, cuts: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """Add 0/1 ``<m>_pos`` and ``<m>_strong``; a NULL value is negative.

    The cut table has one row per slide and is joined without a hint: AQE
    broadcasts it when its measured size is small and splits a hot slide if not."""
    return flagged(join_same(cells, cuts, SLIDE), markers)


def flagged(cells: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """The flags of cells that carry the cuts of their slide."""
    def flag(m: str, cut: str) -> Column:
        return F.coalesce(F.col(m) >= F.col(cut), F.lit(False)).cast("int")

    cols = {}
    for m in markers:
        cols[f"{m}_pos"] = flag(m, f"{m}_weak")
        cols[f"{m}_strong"] = flag(m, f"{m}_strong_cut")
    return cells.withColumns(cols).drop(*[f"{m}_weak" for m in markers], *[f"{m}_strong_cut" for m in markers])


def retype(flagged: DataFrame) -> DataFrame:
    """Rule-based type and confidence from flags and ``DAPI_low``."""
    pos = {m: F.col(f"{m}_pos") == 1 for m in C.POSITIVE_MARKERS}
    strong = {m: F.col(f"{m}_strong") for m in C.POSITIVE_MARKERS}
    t_lineage = F.when(pos["Foxp3"], "Treg").when(pos["CD4"], "CD4 T").when(pos["CD8"], "CD8 T").otherwise("T cell")
    b_and_t = pos["CD19"] & pos["CD3"]
    b_wins = b_and_t & (strong["CD19"] > strong["CD3"] + strong["CD4"] + strong["CD8"] + strong["Foxp3"])
    cell_type = (F.when(b_wins, "B cell").when(pos["CD3"], t_lineage).when(pos["CD68"], "Macrophage")
                 .when(pos["CD19"], "B cell").otherwise("Other"))
    # Confidence of each piece of evidence; the best one counts.
    t_conf = F.when(pos["Foxp3"], 0.75).when(pos["CD4"] | pos["CD8"], 0.7).otherwise(0.6)
    conf = F.greatest(
        F.lit(0.2),
        F.when(pos["CD19"], F.when(strong["CD19"] == 1, 0.7).otherwise(0.55)),
        F.when(pos["CD68"], F.when(strong["CD68"] == 1, 0.7).otherwise(0.55)),
        F.when(pos["CD3"], t_conf),
        F.when(b_and_t, 0.7))
    dim = F.coalesce(F.col("DAPI") < F.col("DAPI_low"), F.lit(False))
    conf = F.least(F.lit(1.0), F.round(F.when(dim, conf * 0.7).otherwise(conf), 3))
    return flagged.withColumns({"cell_type_retyped": cell_type, "cell_type_confidence": conf}).drop("DAPI_low")


def typed_cells(cells: DataFrame, **threshold_args) -> DataFrame:
    """Thresholds, flags and types of a cleaned cell table, all slides at once."""
    return retype(flag_markers(cells, thresholds(cells, **threshold_args)))


def typed_by_slide(cells: DataFrame, markers: list[str] = MARKERS, q_low: float = 0.6, q_high: float = 0.85,
                   fixed: dict[str, dict[str, float]] | None = None, dapi_q: float = 0.2) -> DataFrame:
    """``typed_cells`` while every slide fits one task: one shuffle brings a slide's rows together, and whatever groups
    them by slide, or by more, needs no other.  With a hot slide the cuts are joined instead."""
    if has_hot_group(cells, SLIDE):
        return typed_cells(cells, markers=markers, q_low=q_low, q_high=q_high, fixed=fixed, dapi_q=dapi_q)
    w = Window.partitionBy(*SLIDE)
    q = cells.withColumns({f"{m}_q": F.percentile(m, [float(q_low), float(q_high), float(dapi_q)]).over(w) for m in markers})
    return retype(flagged(q.select(*cells.columns, *cut_columns(markers, fixed)), markers))


def type_fixed(cells: DataFrame, cuts: dict[str, float] | None = None, out: str = "cell_type") -> DataFrame:
    """Type by fixed cuts (strictly greater, default 13 for every marker)."""
    cuts = cuts or {}
    hi = {m: F.coalesce(F.col(m) > float(cuts.get(m, 13)), F.lit(False)) for m in C.POSITIVE_MARKERS}
    lo = {m: F.coalesce(F.col(m) <= float(cuts.get(m, 13)), F.lit(False)) for m in C.POSITIVE_MARKERS}
    return cells.withColumn(
        out,
        F.when(hi["CD3"] & hi["CD8"] & lo["CD4"], "CD8+ T cell")
        .when(hi["CD3"] & hi["CD4"] & lo["CD8"], "CD4+ T cell")
        .when(hi["CD3"] & hi["CD4"] & hi["Foxp3"], "Treg")
        .when(hi["CD19"] & lo["CD3"], "B cell")
        .when(hi["CD68"], "Macrophage").otherwise("Other"))


def percentile_scale(df: DataFrame, keys: list[str], cols: list[str], lo: float = 1.0, hi: float = 99.5,
                     suffix: str = "_scaled", split: bool | None = None) -> DataFrame:
    """Min-max scale to [0,1] between two percentiles of each group; a flat group
    uses a width of one.  ``lo=0, hi=100`` gives plain min-max scaling."""
    q = quantiles(df, keys, cols, [lo / 100.0, hi / 100.0], split=split)
    q = q.select(*keys, *[v for c in cols for v in (
        F.col(f"{c}_q")[0].alias(f"{c}_plo"), F.col(f"{c}_q")[1].alias(f"{c}_phi"))])

    def scaled(c: str) -> Column:
        low, high = F.col(f"{c}_plo"), F.col(f"{c}_phi")
        width = F.when(high <= low, F.lit(1.0)).otherwise(high - low)
        return F.when(F.col(c).isNotNull(),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low) / width)))

    return (join_same(df, q, keys).withColumns({f"{c}{suffix}": scaled(c) for c in cols})
            .drop(*[f"{c}_plo" for c in cols], *[f"{c}_phi" for c in cols]))


# Labels of the score-based typing, in tie-break order.
SCORE_LABELS = ["CD8+ T cell", "CD4+ T cell", "Treg", "DN T cell", "B cell", "Macrophage"]


def type_scored(cells: DataFrame, qlow: float = 1.0, qhigh: float = 99.5, win: float = 0.33, af: float = 0.33,
                out: str = "cell_type", split: bool | None = None) -> DataFrame:
    """Type by the best of six linear scores on percentile-scaled markers; ``Other``
    when the best score stays below ``win``.  Adds ``best_score``."""
    s = percentile_scale(cells, SLIDE, MARKERS, qlow, qhigh, "__s", split)
    v = {m: F.col(f"{m}__s") for m in MARKERS}
    one = F.lit(1.0)
    # Score weights.
    raw = [
        v["CD8"] * 0.65 + v["CD3"] * 0.35,
        v["CD4"] * 0.55 + v["CD3"] * 0.30 + (one - v["Foxp3"]) * 0.15,
        v["Foxp3"] * 0.65 + v["CD4"] * 0.35,
        v["CD3"] * 0.70 + (one - F.greatest(v["CD4"], v["CD8"], v["Foxp3"])) * 0.30,
        v["CD19"] * 0.80 + (one - F.greatest(v["CD4"], v["CD8"])) * 0.20,
        v["CD68"] * 0.80 + (v["CD68"] - F.greatest(v["CD3"], v["CD4"], v["CD8"], v["CD19"], v["Foxp3"]) + 0.5) * 0.20,
    ]
    scores = F.array(*[r - v["SampleAF"] * float(af) for r in raw])
    s = s.withColumn("_scores", scores).withColumn("best_score", F.array_max("_scores"))
    pos = F.array_position("_scores", F.col("best_score")).cast("int")
    label = F.when(F.col("best_score") >= float(win),
                   F.try_element_at(F.array(*[F.lit(x) for x in SCORE_LABELS]), pos)).otherwise("Other")
    return s.withColumn(out, label).drop("_scores", *[f"{m}__s" for m in MARKERS])


def robust_scale(df: DataFrame, keys: list[str], cols: list[str], split: bool | None = None) -> DataFrame:
    """(x - median) / IQR per group, a zero IQR dividing by one; the input stays in ``<c>_orig``."""
    q = quantiles(df, keys, cols, [0.25, 0.5, 0.75], split=split)
    joined = join_same(df, q, keys)
    new = {}
    for c in cols:
        width = F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0]
        new[f"{c}_orig"] = F.col(c)
        new[c] = (F.col(c) - F.col(f"{c}_q")[1]) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    return joined.withColumns(new).drop(*[f"{c}_q" for c in cols])


def check_cells(df: DataFrame, keys: list[str] = ["slide_id", "cell_id"], min_rows: int = 1) -> DataFrame:
    """Error table of repeated keys and, when the table is too small, one ``too_few_rows`` line."""
    dup = (df.groupBy(*keys).count().filter("count > 1")
           .select(F.lit("duplicate_key").alias("rule"), F.concat_ws("/", *keys).alias("item"),
                   F.col("count").alias("n")))
    few = (df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_rows)
           .select(F.lit("too_few_rows").alias("rule"), F.lit("table").alias("item"), "n"))
    return dup.unionByName(few)
