"""Cell and patch queries."""

from pyspark.sql import functions as F

from celltable.functions import columns as C
from celltable.functions.columns import CELL_TYPES, COEXPRESSION_PAIRS, MARKERS
from celltable.operators import cells as K, patches as P
from celltable.operators.skew import quantiles
from celltable.plans.registry import query, r6, sql_r6
from celltable.plans.views import with_views

# ---- SQL building blocks ------------------------------------------------------------
PID = "regexp_replace(cell_id, '_[^_]*$', '')"


def q(c: str, p: float) -> str:
    return f'quantile_cont("{c}", {p})'


THR = ("select slide_id, " + ", ".join(
    f'{q(m, .6)} as "{m}_weak", greatest({q(m, .6)}, {q(m, .85)}) as "{m}_strong_cut"' for m in MARKERS)
    + f', {q("DAPI", .2)} as "DAPI_low" from cells group by slide_id')
FLAGGED = ("select c.*, t.\"DAPI_low\", " + ", ".join(
    f'coalesce(cast("{m}" >= "{m}_weak" as int), 0) as "{m}_pos", '
    f'coalesce(cast("{m}" >= "{m}_strong_cut" as int), 0) as "{m}_strong"' for m in MARKERS)
    + " from cells c join thr t using (slide_id)")
B_WINS = ('"CD19_pos"=1 and "CD3_pos"=1 and "CD19_strong" > "CD3_strong"+"CD4_strong"+"CD8_strong"+"Foxp3_strong"')
CONF = """greatest(0.2,
  case when "CD19_strong"=1 then 0.7 when "CD19_pos"=1 then 0.55 else 0 end,
  case when "CD68_strong"=1 then 0.7 when "CD68_pos"=1 then 0.55 else 0 end,
  case when "CD3_pos"=1 then case when "Foxp3_pos"=1 then 0.75 when "CD4_pos"=1 or "CD8_pos"=1 then 0.7 else 0.6 end else 0 end,
  case when "CD3_pos"=1 and "CD19_pos"=1 then 0.7 else 0 end)"""
TYPED = f"""select * exclude ("DAPI_low"), {PID} as patch_id,
  case when {B_WINS} then 'B cell'
       when "CD3_pos"=1 then case when "Foxp3_pos"=1 then 'Treg' when "CD4_pos"=1 then 'CD4 T'
                                  when "CD8_pos"=1 then 'CD8 T' else 'T cell' end
       when "CD68_pos"=1 then 'Macrophage' when "CD19_pos"=1 then 'B cell' else 'Other' end as cell_type_retyped,
  cast(least(1.0, round({CONF} * case when "DAPI" < "DAPI_low" then 0.7 else 1.0 end, 3)) as double) as cell_type_confidence
  from flagged"""
TYPED_CTES = {"thr": THR, "flagged": FLAGGED, "typed": TYPED}


def typed_sql(body: str, extra: dict[str, str] | None = None, views: str = "cells") -> str:
    return with_views(views, body, {**TYPED_CTES, **(extra or {})})


def cells(v):
    return K.clean_cells(v.cells)


def typed(v):
    return K.typed_cells(cells(v))


def patched(v):
    """Typed cells with their patch, each slide's rows together; the patch is read off first, so cell ids need not move."""
    return K.typed_by_slide(P.with_patch(cells(v)))


COMP = ", ".join(f"""count(*) filter (where cell_type_retyped = '{t}') as "type_count__{t}" """ for t in CELL_TYPES)
FRAC = ", ".join(f'"type_count__{t}"/n_cells as "type_frac__{t}"' for t in CELL_TYPES)
ENT = "-(" + "+".join(
    f"""case when "type_count__{t}">0 then ("type_count__{t}"/n_cells)*log2("type_count__{t}"/n_cells) else 0 end"""
    for t in CELL_TYPES) + ")"
FRACS = [f"type_frac__{t}" for t in CELL_TYPES]


COMPOSITION_SQL = sql_r6(typed_sql(
    f"""select slide_id, patch_id, n_cells, {', '.join(f'"type_count__{t}"' for t in CELL_TYPES)}, {FRAC},
        {ENT} as type_entropy, n_cells/(a+1e-6) as cell_density_proxy
        from (select slide_id, patch_id, count(*) as n_cells, sum(nucleus_area) as a, {COMP} from typed group by all)"""),
    [*FRACS, "type_entropy", "cell_density_proxy"])


@query("patch_composition", "AGG-01 AGG-08 AGG-09 AGG-10 PRJ-01 PRJ-04 PRJ-18 PRJ-19 AGG-16 AGG-17", COMPOSITION_SQL)
def patch_composition(v):
    return r6(P.composition_report(typed(v)))


@query("cell_ids", "PRJ-01 PRJ-02 UDF-01", with_views("cells", f"""
    select slide_id, cell_id, {PID} as patch_id, cast(split_part({PID},'_',1) as bigint) as py,
      cast(split_part({PID},'_',2) as bigint) as px,
      cast(split_part({PID},'_',1) as bigint)*256 as py_index from cells"""))
def cell_ids(v):
    p = C.patch_id("cell_id")
    return v.cells.select("slide_id", "cell_id", p.alias("patch_id"), C.patch_part(p, 1).alias("py"),
                          C.patch_part(p, 2).alias("px"), C.patch_part(p, 1, stride=256).alias("py_index"))


@query("coerced_numbers", "PRJ-03 PRJ-04", with_views("cohort", """
    select id, try_cast(recurrent as double) as recurrent, cast(try_cast(recurrent as double) is null as int) as missing
    from cohort"""))
def coerced_numbers(v):
    n = C.coerce_number("recurrent")
    return v.cohort.select("id", n.alias("recurrent"), n.isNull().cast("int").alias("missing"))


@query("used_columns", "PRJ-05 PRJ-06", with_views("cells", "select slide_id, cell_id, x, y, nucleus_area from cells"))
def used_columns(v):
    return K.select_used(K.require(v.cells, ["cell_id", "x", "y"]),
                         ["slide_id", "cell_id", "x", "y", "nucleus_area", "cell_type", "note"])


@query("slide_thresholds", "AGG-16 AGG-17 UDF-03", sql_r6(with_views("cells", THR), [
    *[f"{m}_{s}" for m in MARKERS for s in ("weak", "strong_cut")], "DAPI_low"]))
def slide_thresholds(v):
    return r6(K.thresholds(cells(v)))


@query("fixed_thresholds", "AGG-16 UDF-03 SRC-03", sql_r6(with_views("cells", f"""
    select slide_id, 5.0::double as "CD3_weak", greatest(5.0, {q("CD3", .85)}) as "CD3_strong_cut",
      {q("CD8", .6)} as "CD8_weak", greatest({q("CD8", .6)}, 3.0) as "CD8_strong_cut" from cells group by slide_id"""),
    ["CD3_weak", "CD3_strong_cut", "CD8_weak", "CD8_strong_cut"]))
def fixed_thresholds(v):
    return r6(K.thresholds(cells(v), ["CD3", "CD8"], fixed={"CD3": {"weak": 5}, "CD8": {"strong": 3}}))


@query("typed_cells", "PRJ-18 PRJ-19", typed_sql(
    "select slide_id, cell_id, " + ", ".join(f'"{m}_pos", "{m}_strong"' for m in MARKERS)
    + ", cell_type_retyped, floor(cell_type_confidence*1e6+0.5)/1e6 as cell_type_confidence from typed"))
def typed_cells(v):
    return r6(typed(v).select("slide_id", "cell_id", *[f"{m}_{s}" for m in MARKERS for s in ("pos", "strong")],
                              "cell_type_retyped", "cell_type_confidence"))


@query("fixed_rule_types", "PRJ-17", with_views("cells", """
    select slide_id, cell_id, case when "CD3">13 and "CD8">13 and "CD4"<=13 then 'CD8+ T cell'
      when "CD3">13 and "CD4">13 and "CD8"<=13 then 'CD4+ T cell'
      when "CD3">13 and "Foxp3">6 and "CD4">13 then 'Treg'
      when "CD19">5 and "CD3"<=13 then 'B cell' when "CD68">13 then 'Macrophage' else 'Other' end as cell_type
    from cells"""))
def fixed_rule_types(v):
    return K.type_fixed(cells(v), {"Foxp3": 6, "CD19": 5}).select("slide_id", "cell_id", "cell_type")


@query("coarse_types", "PRJ-07", typed_sql("""
    select slide_id, coarse, count(*) as n from (select slide_id, case
      when cell_type_retyped in ('CD4 T','CD8 T','Treg','T cell') then 'T' when cell_type_retyped = 'B cell' then 'B'
      when cell_type_retyped = 'Macrophage' then 'Myeloid' else cell_type_retyped end as coarse from typed) group by all"""))
def coarse_types(v):
    return (typed(v).groupBy("slide_id", C.coarse_type("cell_type_retyped").alias("coarse"))
            .agg(F.count(F.lit(1)).alias("n")))


def _pct_sql(lo: float, hi: float) -> dict[str, str]:
    lim = ", ".join(f'{q(m, lo)} as "{m}_lo", {q(m, hi)} as "{m}_hi"' for m in MARKERS)
    sc = ", ".join(f"""case when "{m}" is not null then greatest(0.0, least(1.0, ("{m}"-"{m}_lo")/
        case when "{m}_hi"<="{m}_lo" then 1.0 else "{m}_hi"-"{m}_lo" end)) end as "{m}_s" """ for m in MARKERS)
    return {"lim": f"select slide_id, {lim} from cells group by slide_id",
            "sc": f"select slide_id, cell_id, {sc} from cells join lim using (slide_id)"}


@query("percentile_scaled", "AGG-19", sql_r6(with_views("cells", "select * from sc", _pct_sql(.01, .995)),
                                             [f"{m}_s" for m in MARKERS]))
def percentile_scaled(v):
    return r6(K.percentile_scale(cells(v), ["slide_id"], MARKERS, suffix="_s")
              .select("slide_id", "cell_id", *[f"{m}_s" for m in MARKERS]))


SCORES = """select slide_id, cell_id, [0.65*"CD8_s"+0.35*"CD3_s"-p, 0.55*"CD4_s"+0.30*"CD3_s"+0.15*(1-"Foxp3_s")-p,
   0.65*"Foxp3_s"+0.35*"CD4_s"-p, 0.70*"CD3_s"+0.30*(1-greatest("CD4_s","CD8_s","Foxp3_s"))-p,
   0.80*"CD19_s"+0.20*(1-greatest("CD4_s","CD8_s"))-p,
   0.80*"CD68_s"+0.20*("CD68_s"-greatest("CD3_s","CD4_s","CD8_s","CD19_s","Foxp3_s")+0.5)-p] as s
   from (select *, 0.33*"SampleAF_s" as p from sc)"""


@query("scored_types", "PRJ-20", with_views("cells", """
    select slide_id, cell_type, count(*) as n from (select slide_id, case when best >= 0.33 then
      (['CD8+ T cell','CD4+ T cell','Treg','DN T cell','B cell','Macrophage'])[list_position(s, best)]
      else 'Other' end as cell_type from (select *, list_max(s) as best from scores)) group by all""",
    {**_pct_sql(.01, .995), "scores": SCORES}))
def scored_types(v):
    return (K.type_scored(cells(v)).groupBy("slide_id", "cell_type").agg(F.count(F.lit(1)).alias("n")))


@query("robust_scaled", "AGG-18", sql_r6(with_views("cells", """
    select slide_id, cell_id, ("CD3"-m3)/case when i3=0 then 1 else i3 end as "CD3",
      ("CD68"-m68)/case when i68=0 then 1 else i68 end as "CD68", "CD3" as "CD3_orig", "CD68" as "CD68_orig"
    from cells join (select slide_id, median("CD3") as m3, median("CD68") as m68,
      quantile_cont("CD3",.75)-quantile_cont("CD3",.25) as i3, quantile_cont("CD68",.75)-quantile_cont("CD68",.25) as i68
      from cells group by slide_id) using (slide_id)"""), ["CD3", "CD68", "CD3_orig", "CD68_orig"]))
def robust_scaled(v):
    return r6(K.robust_scale(cells(v), ["slide_id"], ["CD3", "CD68"])
              .select("slide_id", "cell_id", "CD3", "CD68", "CD3_orig", "CD68_orig"))


@query("cell_checks", "CHK-01", with_views("cells", """
    select 'duplicate_key' as rule, concat(slide_id, '/', cast(x as int), '/', cast(y as int)) as item, count(*) as n
    from cells group by slide_id, x, y having count(*) > 1"""))
def cell_checks(v):
    d = v.cells.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})
    return K.check_cells(d, ["slide_id", "x", "y"])


# ---- the wide patch table -----------------------------------------------------------

def _patch_sql() -> tuple[str, list[str], dict[str, str]]:
    agg = ["count(*) as n_cells", "sum(nucleus_area) as nucleus_area_sum", "avg(nucleus_area) as nucleus_area_mean",
           "median(nucleus_area) as nucleus_area_median", "stddev_samp(nucleus_area) as nucleus_area_sd",
           f"{q('nucleus_area', .75)}-{q('nucleus_area', .25)} as nucleus_area_iqr", COMP]
    for m in MARKERS:
        c = f'"{m}"'
        mean = f"(sum({c})/count({c}))"
        var = f"var_pop({c})"
        # moments about the mean, from the joined group mean
        d = f'({c}-"{m}_mu")'
        agg += [f'avg({c}) as "{m}__mean"', f'median({c}) as "{m}__median"', f'stddev_samp({c}) as "{m}__sd"',
                f'case when count({c})>0 and avg({c})<>0 then coalesce(stddev_samp({c}),0)/avg({c}) end as "{m}__cv"',
                f'quantile_cont({c},.75)-quantile_cont({c},.25) as "{m}__iqr"',
                f'case when count({c})>2 and avg({d}**2)>1e-9 then avg({d}**3)/avg({d}**2)**1.5 end as "{m}__skew"',
                f'case when count({c})>3 and avg({d}**2)>1e-9 then avg({d}**4)/avg({d}**2)**2-3 end as "{m}__kurt"',
                *[f'quantile_cont({c},{p / 100}) as "{m}__p{p}"' for p in (10, 25, 75, 90)],
                f'avg("{m}_pos") as "{m}_pos_rate"', f'avg("{m}_strong") as "{m}_strong_rate"',
                f'median(abs({c}-"{m}_md")) as "{m}__mad"']
    agg += ["median(abs(nucleus_area-nucleus_area_md)) as nucleus_area_mad"]
    agg += [f'avg(cast("{a}_pos"=1 and "{b}_pos"=1 as int)) as "coexp__{a}_{b}__rate"' for a, b in COEXPRESSION_PAIRS]
    agg += ['avg("CD3_var") as "CD3_var__mean"', 'median("CD3_var") as "CD3_var__median"',
            'stddev_samp("CD3_var") as "CD3_var__sd"']
    med = ("select slide_id, patch_id, median(nucleus_area) as nucleus_area_md, " + ", ".join(
        f'avg("{m}") as "{m}_mu", median("{m}") as "{m}_md"' for m in MARKERS) + " from typed group by all")
    base = (f"select slide_id, patch_id, {', '.join(agg)} from typed join med using (slide_id, patch_id) group by all")
    n = {t: f'"type_count__{t}"' for t in CELL_TYPES}
    tall = f"({n['T cell']}+{n['CD4 T']}+{n['CD8 T']}+{n['Treg']})"
    derived = {
        "cell_density_proxy": "n_cells/(nucleus_area_sum+1e-6)", "type_entropy": ENT,
        **{f"type_frac__{t}": f"{n[t]}/n_cells" for t in CELL_TYPES},
        "immunoscore_proxy": '("CD3_pos_rate"-i.m3)/(i.s3+1e-6)+("CD8_pos_rate"-i.m8)/(i.s8+1e-6)',
        "frac_T_lineage": f"{tall}/(n_cells+1e-6)", "frac_CD4T": f"{n['CD4 T']}/(n_cells+1e-6)",
        "frac_CD8T": f"{n['CD8 T']}/(n_cells+1e-6)", "frac_Treg": f"{n['Treg']}/(n_cells+1e-6)",
        "frac_Bcell": f"{n['B cell']}/(n_cells+1e-6)", "frac_Myeloid": f"{n['Macrophage']}/(n_cells+1e-6)",
        "T_B_ratio": f"{tall}/({n['B cell']}+1e-6)", "T_myeloid_ratio": f"{tall}/({n['Macrophage']}+1e-6)",
        "CD4_CD8_count_ratio": f"({n['CD4 T']}+1e-6)/({n['CD8 T']}+1e-6)",
        "CD4_CD8_posratio": '("CD4_pos_rate"+1e-6)/("CD8_pos_rate"+1e-6)',
        "CD4_CD8_strongratio": '("CD4_strong_rate"+1e-6)/("CD8_strong_rate"+1e-6)',
        "CD8_to_suppressive_ratio": f"({n['CD8 T']}+1e-6)/({n['Treg']}+{n['Macrophage']}+1e-6)"}
    body = ("select b.*, " + ", ".join(f'{e} as "{k}"' for k, e in derived.items())
            + ' from base b join (select slide_id, avg("CD3_pos_rate") as m3, stddev_samp("CD3_pos_rate") as s3, '
              'avg("CD8_pos_rate") as m8, stddev_samp("CD8_pos_rate") as s8 from base group by slide_id) i using (slide_id)')
    ints = {"n_cells", *[f"type_count__{t}" for t in CELL_TYPES]}
    import re
    names = [x for x in re.findall(r' as "?([A-Za-z0-9_ ]+?)"?(?=,|$| from)', base.split(" from typed join")[0])]
    doubles = [x for x in [*dict.fromkeys(names), *derived] if x not in ints and x not in ("slide_id", "patch_id", "int", "int))")]
    return body, [x for x in doubles if not x.startswith("int")], {"med": med, "base": base}


PATCH_BODY, PATCH_DOUBLES, PATCH_CTES = _patch_sql()


@query("patch_features", "AGG-02 AGG-03 AGG-04 AGG-05 AGG-06 AGG-07 AGG-08 AGG-11 AGG-12 AGG-13 AGG-14 AGG-15 SNK-03",
       sql_r6(typed_sql(PATCH_BODY, PATCH_CTES), PATCH_DOUBLES))
def patch_features(v):
    return r6(P.patch_features(patched(v)))


PATCH_INTS = ["n_cells", *[f"type_count__{t}" for t in CELL_TYPES]]


@query("slide_rollup", "AGG-40", sql_r6(
    typed_sql("select slide_id, " + ", ".join(f'avg("{c}") as "{c}"' for c in [*PATCH_INTS, *PATCH_DOUBLES])
              + f" from ({PATCH_BODY}) group by slide_id", PATCH_CTES), [*PATCH_INTS, *PATCH_DOUBLES]))
def slide_rollup(v):
    return r6(P.slide_features(P.patch_features(patched(v))))


@query("area_summary", "AGG-20 AGG-02", sql_r6(with_views("cells", f"""
    select slide_id, {PID} as patch_id, avg(nucleus_area) as mean, median(nucleus_area) as median,
      coalesce(stddev_samp(nucleus_area), 0) as sd, {q('nucleus_area', .75)}-{q('nucleus_area', .25)} as iqr,
      max(nucleus_area) as max from cells group by all"""), ["mean", "median", "sd", "iqr", "max"]))
def area_summary(v):
    return r6(P.summary(P.with_patch(cells(v)), P.PATCH, "nucleus_area"))


@query("marker_positivity", "AGG-11 AGG-12", sql_r6(typed_sql(
    "select slide_id, " + ", ".join(f'avg("{m}_pos") as "{m}_pos_rate", avg("{m}_strong") as "{m}_strong_rate"' for m in MARKERS)
    + ", " + ", ".join(f'avg(cast("{a}_pos"=1 and "{b}_pos"=1 as int)) as "coexp__{a}_{b}__rate"' for a, b in COEXPRESSION_PAIRS)
    + " from typed group by slide_id"),
    [*[f"{m}_{s}_rate" for m in MARKERS for s in ("pos", "strong")], *[f"coexp__{a}_{b}__rate" for a, b in COEXPRESSION_PAIRS]]))
def marker_positivity(v):
    return r6(typed(v).groupBy("slide_id").agg(*P.positivity_rates(MARKERS), *P.coexpression()))


@query("feature_dictionary", "SNK-03")
def feature_dictionary(v):
    return P.feature_dictionary(P.patch_features(typed(v), split=False))
