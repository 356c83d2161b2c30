"""Segmentation, imaging and tiling queries."""

from pyspark.sql import functions as F

from celltable.functions import columns as C
from celltable.functions.columns import MARKERS
from celltable.operators import cells as K, imaging as I, segmentation as S, tiling as T
from celltable.plans.q_cells import SCORES, _pct_sql, cells
from celltable.plans.registry import query, r6, sql_r6
from celltable.plans.views import with_views

OV = {"ta": "select img, true_id as t, count(*) as area_t from labels_px where true_id>0 group by all",
      "pa": "select img, pred_id as p, count(*) as area_p from labels_px where pred_id>0 group by all",
      "ov": """select img, t, p, area_t, area_p, n as inter, area_t+area_p-n as "union", n/(area_t+area_p-n) as iou
        from (select img, true_id as t, pred_id as p, count(*) as n from labels_px where true_id>0 and pred_id>0 group by all)
        join ta using (img, t) join pa using (img, p)"""}
AJI = """select img, coalesce(i,0)/(coalesce(u,0)+coalesce(lt,0)+coalesce(lp,0)) as aji from (select distinct img from labels_px)
  left join (select img, sum(inter) as i, sum("union") as u from best group by img) using (img)
  left join (select img, sum(area_t) as lt from ta where (img,t) not in (select (img,t) from best) group by img) using (img)
  left join (select img, sum(area_p) as lp from pa where (img,p) not in (select (img,p) from best) group by img) using (img)"""
BEST = {**OV, "best": "select * from (select *, row_number() over (partition by img, t order by iou desc, p) as rn from ov) where rn=1"}
PQ = """select img, tp, np-tp as fp, nt-tp as fn, tp/(tp+0.5*(np-tp)+0.5*(nt-tp)) as dq, s/(tp+1e-6) as sq,
  tp/(tp+0.5*(np-tp)+0.5*(nt-tp))*s/(tp+1e-6) as pq from (select distinct img from labels_px)
  join (select img, count(*) as nt from ta group by img) using (img) join (select img, count(*) as np from pa group by img) using (img)
  join (select img, count(*) filter (where iou>0.5) as tp, coalesce(sum(iou) filter (where iou>0.5),0) as s from ov group by img) using (img)"""
DICE = "select img, 2*count(*) filter (where true_id>0 and pred_id>0)/(count(*) filter (where true_id>0)+count(*) filter (where pred_id>0)) as dice from labels_px group by img"


@query("instance_overlaps", "JOI-17", sql_r6(with_views("labels_px", "select * from ov", OV), ["iou"]))
def instance_overlaps(v):
    px = v.labels_px
    t = px.select("img", "y", "x", F.col("true_id").alias("id"))
    p = px.select("img", "y", "x", F.col("pred_id").alias("id"))
    return r6(S.overlaps_of(t, p))


@query("best_overlap", "WIN-06", with_views("labels_px", "select img, t, p, inter from best", BEST))
def best_overlap(v):
    return S.best_pairs(S.overlaps(v.labels_px)).select("img", "t", "p", "inter")


@query("aji", "SEG-01", sql_r6(with_views("labels_px", AJI, BEST), ["aji"]))
def aji(v):
    return r6(S.aji(v.labels_px))


@query("panoptic_quality", "SEG-03", sql_r6(with_views("labels_px", PQ, OV), ["dq", "sq", "pq"]))
def panoptic_quality(v):
    return r6(S.panoptic(v.labels_px))


@query("panoptic_quality_low", "SEG-04")
def panoptic_quality_low(v):
    return r6(S.panoptic(v.labels_px, 0.3))


@query("dice", "SEG-05", sql_r6(with_views("labels_px", DICE), ["dice"]))
def dice(v):
    return r6(S.dice(v.labels_px))


@query("ensemble_dice", "SEG-06", sql_r6(with_views("labels_px",
    "select img, sum(2*inter)/sum(area_t+area_p) as dice2 from ov group by img", OV), ["dice2"]))
def ensemble_dice(v):
    return r6(S.ensemble_dice(v.labels_px))


@query("aji_plus", "SEG-02")
def aji_plus(v):
    return r6(S.aji_plus(v.labels_px))


@query("instance_scores", "SEG-07", sql_r6(with_views("labels_px", f"""
    select img, dice, aji, dq, sq, pq from ({DICE}) join ({AJI}) using (img) join ({PQ}) using (img)""", BEST),
    ["dice", "aji", "dq", "sq", "pq"]))
def instance_scores(v):
    return r6(S.instance_scores(v.labels_px).drop("aji_plus"))


TYPES = "cast(case when {i}=0 then 0 else 1+(y+x*2+nk)%3 end as int)"


def typed_px(v):
    return v.labels_px.withColumns({"inst": F.col("true_id"), "type": F.when(F.col("true_id") == 0, 0).otherwise(
        F.pmod(F.col("y") + F.col("x") * 2 + F.col("nk"), F.lit(3)))})


@query("instance_type_vote", "AGG-25", sql_r6(with_views("labels_px", """
    select img, inst, type, n/(area+1e-6) as type_prob from (select *, sum(n) over (partition by img, inst) as area,
      row_number() over (partition by img, inst order by n desc, type) as rn,
      count(*) over (partition by img, inst) as k from (
        select img, true_id as inst, cast((y+x*2+nk)%3 as int) as type, count(*) as n from labels_px where true_id>0 group by all))
    qualify row_number() over (partition by img, inst order by (type=0 and rn=1 and k>1)::int, rn) = 1"""), ["type_prob"]))
def instance_type_vote(v):
    d = typed_px(v).withColumn("type", F.col("type").cast("int"))
    return r6(S.vote_type(d))


@query("region_table", "AGG-22", sql_r6(with_views("labels_px", """
    select img, true_id as label, count(*) as area, cast(trunc(avg(y)) as bigint)+10 as cy, cast(trunc(avg(x)) as bigint)+20 as cx,
      min(y) as y0, min(x) as x0, max(y)+1 as y1, max(x)+1 as x1, avg(pred_id) as pred_id, var_pop(pred_id) as pred_id_var
    from labels_px where true_id>0 group by all"""), ["pred_id", "pred_id_var"]))
def region_table(v):
    return r6(S.region_props(v.labels_px, "true_id", ["pred_id"], (10, 20)))


@query("remapped_labels", "WIN-05", with_views("labels_px", """
    select img, y, x, case when pred_id>0 then rk else 0 end as new_label from labels_px left join (
      select img, pred_id, row_number() over (partition by img order by n desc, pred_id) as rk from
      (select img, pred_id, count(*) as n from labels_px where pred_id>0 group by all)) using (img, pred_id)"""))
def remapped_labels(v):
    return S.remap_labels(v.labels_px, "pred_id", by_size=True).select("img", "y", "x", "new_label")


@query("global_instance_ids", "WIN-12", with_views("labels_px", """
    select img, pred_id, pred_id+off as global_id from (select distinct img, pred_id from labels_px where pred_id>0)
    join (select img, coalesce(cast(sum(m) over (order by img rows between unbounded preceding and 1 preceding) as bigint),0) as off
      from (select img, max(pred_id) as m from labels_px group by img)) using (img)"""))
def global_instance_ids(v):
    d = v.labels_px.filter("pred_id > 0").select("img", "pred_id").distinct()
    return S.offset_ids(d, "img", "pred_id")


@query("offset_maps", "AGG-42", sql_r6(with_views("labels_px", """
    select img, y, x, inst, case when sx<0 then -sx/(lx) when sx>0 then sx/hx else 0.0 end as h,
      case when sy<0 then -sy/(ly) when sy>0 then sy/hy else 0.0 end as v from (
      select *, min(sx) over w as lx, max(sx) over w as hx, min(sy) over w as ly, max(sy) over w as hy, count(*) over w as n from (
        select img, y, x, pred_id as inst, x+1-floor(avg(x) over w+0.5) as sx, y+1-floor(avg(y) over w+0.5) as sy
        from labels_px where pred_id>0 window w as (partition by img, pred_id))
      window w as (partition by img, inst)) where n >= 30"""), ["h", "v"]))
def offset_maps(v):
    return r6(S.offset_map(v.labels_px.withColumn("inst", F.col("pred_id"))))


REGION_REACH = {"fg": "select img, y, x, y*16777216+x as pid from labels_px where true_id>0 and pred_id>0",
    "reach": """select img, pid, y, x, pid as label from fg union select f.img, f.pid, f.y, f.x, r.label from reach r join fg f
      on f.img=r.img and f.y=r.y and f.x=r.x+1 and r.label<f.pid union select f.img, f.pid, f.y, f.x, r.label from reach r join fg f
      on f.img=r.img and f.y=r.y+1 and f.x=r.x and r.label<f.pid"""}


@query("mask_regions", "GRF-23", with_views("labels_px", """
    select img, region, n as size, y0::bigint as y0, x0::bigint as x0 from (select img, t, p, min(y*16777216::bigint+x) as region, count(*) as n, min(y) as y0, min(x) as x0
      from (select img, y, x, true_id as t, pred_id as p from labels_px where true_id>0 and pred_id>0) group by all) where n >= 5"""))
def mask_regions(v):
    # gaps of two pixels separate the squares of either map, so an overlap is one region
    d = v.labels_px.filter("true_id > 0 and pred_id > 0").select("img", "y", "x")
    r = S.region_runs(d, connectivity=4, min_size=5)
    return r.groupBy("img", "region", "size").agg(F.min("y").alias("y0"), F.min("x0").alias("x0"))


BOXES = "select distinct img, 1 as box, 10+nk%7 as x0, 26+nk%7 as x1, 6 as y0, 34 as y1 from labels_px"


@query("seam_reconcile", "JOI-19 SET-02", with_views("labels_px", """
    select img, y, x, cast(inst as bigint) as inst from kept union all
    select n.img, n.y, n.x, cast(top+rk as bigint) from nw n join (select img, inst, row_number() over (partition by img order by inst) as rk
      from (select distinct img, inst from nw)) using (img, inst) join (select img, max(true_id) as top from labels_px group by img) using (img)""",
    {"bx": BOXES,
     "touch": """select l.img, true_id as inst, bool_or(x=x0 or x=x1-1 or y=y0 or y=y1-1) as edge from labels_px l join bx on bx.img=l.img
        where true_id>0 and x>=x0 and x<x1 and y>=y0 and y<y1 group by all""",
     "kept": "select img, y, x, true_id as inst from labels_px where true_id>0 and (img,true_id) not in (select (img,inst) from touch where not edge)",
     "seam": """select l.img, y, x, pred_id as inst from labels_px l join bx on bx.img=l.img where pred_id>0
        and x>=x0 and x<x1 and y>=y0 and y<y1""",
     "nw": """select * from seam where (img,inst) not in (select (s.img,s.inst) from seam s join kept k on k.img=s.img and k.y=s.y and k.x=s.x)"""}))
def seam_reconcile(v):
    px = v.labels_px
    n = F.col("nk") % 7
    boxes = px.select("img", F.lit(1).alias("box"), (n + 10).alias("x0"), (n + 26).alias("x1"),
                      F.lit(6).alias("y0"), F.lit(34).alias("y1")).distinct()
    seam = (px.select("img", "y", "x", F.col("pred_id").alias("inst")).join(boxes, "img")
            .filter("x >= x0 and x < x1 and y >= y0 and y < y1").select("img", "box", "y", "x", "inst"))
    return S.reconcile(px.select("img", "y", "x", F.col("true_id").alias("inst")), seam, boxes)


@query("segmentation_scalars", "AGG-32", sql_r6(with_views("labels_px", """
    select img, avg(cast((true_id>0)=(pred_id>0) as int)) as pixel_acc,
      2.0*count(*) filter (where true_id>0 and pred_id>0)/(count(*) filter (where true_id>0)+count(*) filter (where pred_id>0)+1e-8) as dice,
      2.0*count(*) filter (where true_id%3=1 and pred_id%3=1)/(count(*) filter (where true_id%3=1)+count(*) filter (where pred_id%3=1)+1e-8) as dice_1,
      2.0*count(*) filter (where true_id%3=2 and pred_id%3=2)/(count(*) filter (where true_id%3=2)+count(*) filter (where pred_id%3=2)+1e-8) as dice_2,
      avg((true_id/7-pred_id/11)**2) as mse_h from labels_px group by img"""), ["pixel_acc", "dice", "dice_1", "dice_2", "mse_h"]))
def segmentation_scalars(v):
    d = v.labels_px.withColumns({"true_type": F.col("true_id") % 3, "pred_type": F.col("pred_id") % 3,
                                 "true_h": F.col("true_id") / 7, "pred_h": F.col("pred_id") / 11})
    return r6(S.seg_scalars(d, [1, 2]))


@query("pooled_scalars", "AGG-32", sql_r6(with_views("labels_px", """
    select avg(cast((true_id>0)=(pred_id>0) as int)) as pixel_acc,
      2.0*count(*) filter (where true_id>0 and pred_id>0)/(count(*) filter (where true_id>0)+count(*) filter (where pred_id>0)+1e-8) as dice,
      2.0*count(*) filter (where true_id%3=1 and pred_id%3=1)/(count(*) filter (where true_id%3=1)+count(*) filter (where pred_id%3=1)+1e-8) as dice_1,
      2.0*count(*) filter (where true_id%3=2 and pred_id%3=2)/(count(*) filter (where true_id%3=2)+count(*) filter (where pred_id%3=2)+1e-8) as dice_2,
      (avg((true_id/7-pred_id/11)**2)+avg((true_id/5-pred_id/13)**2))/2 as mse_hv from labels_px"""),
    ["pixel_acc", "dice", "dice_1", "dice_2", "mse_hv"]))
def pooled_scalars(v):
    d = v.labels_px.withColumns({"true_type": F.col("true_id") % 3, "pred_type": F.col("pred_id") % 3,
                                 "true_h": F.col("true_id") / 7, "pred_h": F.col("pred_id") / 11,
                                 "true_v": F.col("true_id") / 5, "pred_v": F.col("pred_id") / 13})
    return r6(S.seg_scalars(d, [1, 2], keys=[], maps=["h", "v"]))


@query("mean_instance_scores", "SEG-07")
def mean_instance_scores(v):
    return r6(S.mean_scores(S.instance_scores(v.labels_px)))


def sided_points(v):
    """Cells of one line status against those of the other, as truth and prediction."""
    c = v.cells.select(F.concat_ws("|", "slide_id", C.patch_id("cell_id")).alias("image"), F.col("cell_id").alias("id"),
                       "x", "y", (F.col("CD4") % 3).cast("int").alias("type"), "status")
    return c.filter("status = 'F'").drop("status"), c.filter("status <> 'F'").drop("status")


@query("matched_points", "JOI-18")
def matched_points(v):
    return S.match_points(*sided_points(v))


@query("type_scores", "SEG-08 AGG-33")
def type_scores(v):
    return S.type_score_job(*sided_points(v), [0, 1, 2])


@query("merged_classes", "PRJ-12", with_views("labels_px", """
    select img, k, count(*) as n from (select img, case when true_id in (3,4) then 3 when true_id in (5,6,7) then 4
      else true_id end as k from labels_px) group by all"""))
def merged_classes(v):
    return v.labels_px.groupBy("img", C.merge_classes("true_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# ---- imaging ------------------------------------------------------------------------

@query("dark_gate", "AGG-24", sql_r6(with_views("rgb_px", "select img, avg(r) as mean from rgb_px group by img having avg(r) >= 120"), ["mean"]))
def dark_gate(v):
    return r6(I.gate_dark(v.rgb_px, "r", ["img"], 120))


@query("patch_quality", "AGG-23 JOI-12", sql_r6(with_views("rgb_px", """
    select img, mask_area, dapi_max, not (mask_area<280 or dapi_max<255) as kept from
    (select img, sum(r)/255.0::double as mask_area, max(g) as dapi_max from rgb_px group by img)"""), ["mask_area"]))
def patch_quality(v):
    px = v.rgb_px
    return r6(I.qc_patches(px.select("img", F.col("r").alias("value")), px.select("img", F.col("g").alias("value")),
                           min_mask=280, min_dapi=255))


OTSU = {"h": "select img, r as v, count(*)::double as n from rgb_px group by all",
        "o": """select img, v, w1*w2*(s1/w1-s2/w2)*(s1/w1-s2/w2) as var from (select *, sum(n) over u as w1, sum(n*v) over u as s1,
          sum(n) over d as w2, sum(n*v) over d as s2 from h window u as (partition by img order by v rows between unbounded preceding and current row),
          d as (partition by img order by v rows between 1 following and unbounded following)) where w2 > 0"""}


@query("otsu", "AGG-35", with_views("rgb_px", """
    select img, cast(first(v order by var desc, v) as int) as threshold from o group by img""", OTSU))
def otsu(v):
    return I.otsu(v.rgb_px, "r", ["img"])


@query("otsu_or_quantile", "AGG-36", sql_r6(with_views("rgb_px", """
    select img, case when fg<0.001 then greatest(8.0, p60) else t::double end as threshold, fg from
      (select img, t, avg(cast(r>t as int)) as fg, quantile_cont(r, .6) as p60 from rgb_px join
        (select img, first(v order by var desc, v) as t from o group by img) using (img) group by all)""", OTSU), ["threshold", "fg"]))
def otsu_or_quantile(v):
    return r6(I.otsu_or_p60(v.rgb_px, "r", ["img"]))


@query("center_crop", "PRJ-15", with_views("rgb_px", "select img, y, x, r from rgb_px where y>=12-7//2 and y<12-7//2+7 and x>=12-10//2 and x<12-10//2+10"))
def center_crop(v):
    return I.center_crop(v.rgb_px, 24, 24, 7, 10).select("img", "y", "x", "r")


@query("blended_tiles", "AGG-28 PRJ-10", with_views("rgb_px", """
    select cast(g%3 as bigint) as ch, slide_id, y, x, 255-cast(floor(avg(r)) as int) as value from
    (select cast(b%5 as varchar) as slide_id, * from rgb_px) group by all"""))
def blended_tiles(v):
    d = v.rgb_px.select((F.col("g") % 3).cast("bigint").alias("ch"), (F.col("b") % 5).cast("string").alias("slide_id"), "y", "x", F.col("r").alias("value"))
    return I.blend_tiles(d, invert=True)


@query("assembled_channels", "JOI-11", with_views("rgb_px", """
    select img, y, x, d::bigint as "DAPI", m::bigint as "CD3", a::bigint as "AF" from (select img, y, x, any_value(r) as d,
      any_value(case when g%4>0 then g end) as m, any_value(case when b%5>0 then b end) as a from rgb_px group by all)
    where d is not null and m is not null and a is not null"""))
def assembled_channels(v):
    e = v.rgb_px.select("img", "y", "x", F.explode(F.array(
        F.struct(F.lit("DAPI").alias("c"), F.col("r").alias("v")),
        F.struct(F.when(F.col("g") % 4 > 0, "CD3").alias("c"), F.col("g").alias("v")),
        F.struct(F.when(F.col("b") % 5 > 0, "AF").alias("c"), F.col("b").alias("v")))).alias("e")).select("img", "y", "x", "e.*")
    return I.assemble_channels(e.filter("c is not null"), ["img", "y", "x"], "c", "v", ["DAPI", "CD3", "AF"])


def _lab(r: str, g: str, b: str, s: str) -> str:
    lin = lambda c: f"(case when {c}/255.0::double>0.04045 then pow(({c}/255.0::double+0.055)/1.055, 2.4) else {c}/255.0::double/12.92 end)"
    x = f"(({lin(r)}*0.412453+{lin(g)}*0.357580+{lin(b)}*0.180423)/0.95047)"
    y = f"({lin(r)}*0.212671+{lin(g)}*0.715160+{lin(b)}*0.072169)"
    z = f"(({lin(r)}*0.019334+{lin(g)}*0.119193+{lin(b)}*0.950227)/1.08883)"
    f = lambda t: f"(case when {t}>0.008856 then pow({t}, 1.0/3) else {t}*7.787+16.0/116 end)"
    return f"116*{f(y)}-16 as l{s}, 500*({f(x)}-{f(y)}) as a{s}, 200*({f(y)}-{f(z)}) as b{s}"


DE = {"lab": f"select *, {_lab('r', 'g', 'b', '_1')}, {_lab('r2', 'g2', 'b2', '_2')} from rgb_px",
      "de": "select *, sqrt((l_1-l_2)**2+(a_1-a_2)**2+(b_1-b_2)**2) as delta_e from lab"}


@query("colour_difference", "PRJ-22", sql_r6(with_views("rgb_px", "select img, y, x, delta_e from de", DE), ["delta_e"]))
def colour_difference(v):
    d = C.delta_e76(C.srgb_to_lab("r", "g", "b"), C.srgb_to_lab("r2", "g2", "b2"))
    return r6(v.rgb_px.select("img", "y", "x", d.alias("delta_e")))


@query("image_pair_quality", "AGG-38 JOI-09", sql_r6(with_views("rgb_px", """
    select img, psnr, delta_e, pearson from (select img, avg(delta_e) as delta_e from de group by img) join (
      select img, 10*log10(255.0*255.0/avg((p-q)**2)) as psnr, corr(p, q) as pearson from (
        select img, r::double as p, r2::double as q from rgb_px union all select img, g, g2 from rgb_px union all select img, b, b2 from rgb_px)
      group by img) using (img)""", DE), ["psnr", "delta_e", "pearson"]))
def image_pair_quality(v):
    return r6(I.pair_quality(v.rgb_px))


BOX = {"lng": "select img, 'r' as ch, y, x, r::double as a, r2::double as b from rgb_px union all select img, 'g', y, x, g, g2 from rgb_px union all select img, 'b', y, x, b, b2 from rgb_px",
       "box": """select c.img, c.ch, c.y, c.x, avg(n.a) as a, avg(n.b) as b, avg(n.a*n.a) as aa, avg(n.b*n.b) as bb, avg(n.a*n.b) as ab
         from lng c join lng n on n.img=c.img and n.ch=c.ch and n.y between c.y-3 and c.y+3 and n.x between c.x-3 and c.x+3
         where c.y between 3 and 20 and c.x between 3 and 20 group by all"""}


@query("box_mean", "WIN-09", sql_r6(with_views("rgb_px", "select img, y, x, a as r from box where ch='r'", {
    **BOX, "lng": "select img, 'r' as ch, y, x, r::double as a, r2::double as b from rgb_px"}), ["r"]))
def box_mean(v):
    return r6(I.box_mean(v.rgb_px, ["img"], ["r"]))


@query("ssim", "AGG-39", sql_r6(with_views("rgb_px", """
    select img, avg(s) as ssim from (select img, ch, avg(((2*a*b+6.5025)*(2*(ab-a*b)*49/48+58.5225))/
      ((a*a+b*b+6.5025)*((aa-a*a)*49/48+(bb-b*b)*49/48+58.5225))) as s from box group by all) group by img""", BOX), ["ssim"]))
def ssim(v):
    return r6(I.ssim(v.rgb_px))


QUALITY_SQL = """select img, psnr, delta_e, pearson from (select img, avg(delta_e) as delta_e from de group by img) join (
      select img, 10*log10(255.0*255.0/avg((p-q)**2)) as psnr, corr(p, q) as pearson from (
        select img, r::double as p, r2::double as q from rgb_px union all select img, g, g2 from rgb_px union all select img, b, b2 from rgb_px)
      group by img) using (img)"""
SSIM_SQL = """select img, avg(s) as ssim from (select img, ch, avg(((2*a*b+6.5025)*(2*(ab-a*b)*49/48+58.5225))/
      ((a*a+b*b+6.5025)*((aa-a*a)*49/48+(bb-b*b)*49/48+58.5225))) as s from box group by all) group by img"""


@query("quality_by_marker", "AGG-38 AGG-39", sql_r6(with_views("rgb_px", f"""
    select slide, marker, count(*) as n_images, avg(psnr) as psnr, avg(delta_e) as delta_e, avg(pearson) as pearson, avg(ssim) as ssim
    from (select *, concat('s', img%7) as slide, case when img%3=0 then 'CD3' when img%3=1 then 'CD8' else 'CD20' end as marker
      from ({QUALITY_SQL}) join ({SSIM_SQL}) using (img)) group by slide, marker""", {**DE, **BOX}), ["psnr", "delta_e", "pearson", "ssim"]))
def quality_by_marker(v):
    d = v.rgb_px.withColumns({"slide": F.concat(F.lit("s"), (F.col("img") % 7).cast("string")),
                              "marker": F.when(F.col("img") % 3 == 0, "CD3").when(F.col("img") % 3 == 1, "CD8").otherwise("CD20")})
    return r6(I.quality_by_group(d, ["slide", "marker"]))


# Example stain matrix (haematoxylin, eosin, residual).
STAIN = [[1.88, -0.07, -0.60], [-1.02, 1.13, -0.48], [-0.55, -0.13, 1.57]]


def _dec(j: int) -> str:
    d = "+".join(f"ln(({c}+1.0::double)/256)*({STAIN[i][j]})" for i, c in enumerate("rgb"))
    return f"cast(floor(greatest(0.0, least(255.0, exp({d})*256-1))+0.5) as int) as s{j + 1}"


@query("stain_channels", "PRJ-26", with_views("rgb_px", f"select img, y, x, {_dec(0)}, {_dec(1)}, {_dec(2)} from rgb_px"))
def stain_channels(v):
    return v.rgb_px.select("img", "y", "x", C.deconvolve("r", "g", "b", STAIN).alias("s")).select("img", "y", "x", "s.*")


@query("packed_rgb", "PRJ-11", with_views("rgb_px", "select img, y, x, cast(r*65536+g*256+b as int) as rgb from rgb_px"))
def packed_rgb(v):
    return v.rgb_px.select("img", "y", "x", C.rgb_to_int("r", "g", "b").alias("rgb"))


@query("composite_image", "TIL-10")
def composite_image(v):
    px = v.rgb_px.select(F.col("img").cast("string").alias("slide_id"), F.floor(F.col("y") / 12).alias("tile"), "y", "x",
                         F.col("r").alias("DAPI"), F.col("g").alias("CD3"), F.col("b").alias("CD8"))
    return I.composite(px, ["DAPI", "CD3", "CD8"])


# ---- tiling -------------------------------------------------------------------------

def _seq(lo: str, hi: str, step: int) -> str:
    return f"unnest(range({lo}, {hi}, {step}))"


@query("grid_tiles", "TIL-01", with_views("slides", f"select slide_id, y, {_seq('0', 'w-256+1', 128)} as x from (select *, {_seq('0', 'h-256+1', 128)} as y from slides)"))
def grid_tiles(v):
    return T.grid(v.slides, 256, 128).select("slide_id", "y", "x")


def _valid(n: str, win: int, step: int) -> str:
    return f"list_concat(range(0, {n}-{win}+1, {step}), case when ({n}-{win})%{step}<>0 then [{n}-{win}] else [] end)"


@query("valid_tiles", "TIL-02", with_views("slides", f"select slide_id, y, unnest({_valid('w', 200, 90)}) as x from (select *, unnest({_valid('h', 200, 90)}) as y from slides)"))
def valid_tiles(v):
    return T.grid_valid(v.slides, 200, 90).select("slide_id", "y", "x")


@query("mirror_tiles", "TIL-03", with_views("slides", f"select slide_id, y-55 as y, unnest({_valid('(w+110)', 200, 90)})-55 as x from (select *, unnest({_valid('(h+110)', 200, 90)}) as y from slides)"))
def mirror_tiles(v):
    return T.grid_mirror(v.slides, 200, 90).select("slide_id", "y", "x")


CORNERS = """select slide_id, w, h, y as out_y, x as out_x, y-45 as in_y, x-45 as in_x from (select *, unnest(range(45, 45+(cast(floor((w-90)/164) as bigint)+1)*164, 164)) as x
  from (select *, unnest(range(45, 45+(cast(floor((h-90)/164) as bigint)+1)*164, 164)) as y from slides))"""


@query("tile_corners", "TIL-04", with_views("slides", f"select slide_id, out_y, out_x, in_y, in_x from ({CORNERS})"))
def tile_corners(v):
    return T.tile_corners(v.slides, 254, 164).select("slide_id", "out_y", "out_x", "in_y", "in_x")


@query("chunk_owners", "TIL-06", with_views("slides", f"""
    select slide_id, out_y, out_x, cy as chunk_y0, cx as chunk_x0,
      case when cy+328+90>h then floor((h-90-cy)/164)*164+cy+90 else cy+328+90 end::bigint as chunk_y1,
      case when cx+328+90>w then floor((w-90-cx)/164)*164+cx+90 else cx+328+90 end::bigint as chunk_x1
    from (select *, cast(floor((out_y-45)/328)*328 as bigint) as cy, cast(floor((out_x-45)/328)*328 as bigint) as cx from ({CORNERS}))"""))
def chunk_owners(v):
    return T.chunks(v.slides, 500, 254, 164).select("slide_id", "out_y", "out_x", "chunk_y0", "chunk_x0", "chunk_y1", "chunk_x1")


@query("seam_tile_sets", "TIL-05", with_views("slides", """
    select slide_id, kind, y0, x0, y1, x1 from (
      select slide_id, 'grid' as kind, y as y0, x as x0, least(y+256,h) as y1, least(x+256,w) as x1 from t
      union all select slide_id, 'boundary', y, x-32, y+256, x+32 from t where x>0
      union all select slide_id, 'boundary', y-32, x, y+32, x+256 from t where y>0
      union all select slide_id, 'cross', y-64, x-64, y+64, x+64 from t where x>0 and y>0)""",
    {"t": f"select *, {_seq('0', 'w+1', 256)} as x from (select *, {_seq('0', 'h+1', 256)} as y from slides)"}))
def seam_tile_sets(v):
    return T.seam_tiles(v.slides, 256, 32)


@query("physical_tiles", "TIL-07", with_views("slides", """
    select slide_id, j*230-greatest(j-1,0)*20 as y, i*230-greatest(i-1,0)*20 as x, 230 as size from (
      select *, unnest(range(0, greatest(1, cast(ceil((w-20)/210.0) as bigint)))) as i from (
      select *, unnest(range(0, greatest(1, cast(ceil((h-20)/210.0) as bigint)))) as j from slides))"""))
def physical_tiles(v):
    return T.grid_um(v.slides, 115, 0.25, 0.5, 20).select("slide_id", "y", "x", "size")


@query("tiles_inside", "PRJ-14", with_views("slides", f"""select slide_id, y, x from (select *, {_seq('0', 'w+1', 200)} as x from
    (select *, {_seq('0', 'h+1', 200)} as y from slides)) where x+256<=w and y+256<=h"""))
def tiles_inside(v):
    t = T.grid(v.slides.withColumns({"w0": F.col("w"), "h0": F.col("h")}), 0, 200)
    return T.inside(t, 256, 256).select("slide_id", "y", "x")


@query("thumbnail_steps", "TIL-09", with_views("slides", "select slide_id, cast(greatest(1, floor(least(w,h)/100)) as int) as step from slides"))
def thumbnail_steps(v):
    return v.slides.select("slide_id", T.thumb_step(F.col("h"), F.col("w"), min_side=100).alias("step"))


@query("registration_size", "TIL-13", with_views("slides", """
    select cast(floor(min(greatest(w,h))*0.25) as bigint) as micro_size, first(slide_id order by w*h desc, slide_id desc) as largest from slides"""))
def registration_size(v):
    return T.micro_size(v.slides)


RAST_TYPES = ["CD8+ T cell", "CD4+ T cell", "Treg", "DN T cell", "B cell", "Macrophage"]
DISC = """select c.slide_id, c.cell_id, s.cell_type, greatest(0, least(23, cast(round_even(y/32,0) as int))) as cy,
  greatest(0, least(23, cast(round_even(x/32,0) as int))) as cx, greatest(0.5, least(4.0, sqrt(greatest(nucleus_area,1.0)/3.141592653589793)*(1.0/32))) as r
  from cells c join st s using (slide_id, cell_id)"""


@query("cell_thumbnail", "TIL-08", with_views("cells", """
    select slide_id, ty, tx, first(cell_type order by rk desc, cell_id desc) as cell_type from (
      select slide_id, cell_id, cell_type, list_position(['CD8+ T cell','CD4+ T cell','Treg','DN T cell','B cell','Macrophage'], cell_type) as rk,
        cy+dy as ty, cx+dx as tx from (select *, unnest(range(-1,2)) as dx from (select *, unnest(range(-1,2)) as dy from disc))
      where dx*dx+dy*dy <= r*r) where rk is not null and ty between 0 and 23 and tx between 0 and 23 group by all""",
    {**_pct_sql(.01, .995), "scores": SCORES, "st": """select slide_id, cell_id, case when best >= 0.33 then
      (['CD8+ T cell','CD4+ T cell','Treg','DN T cell','B cell','Macrophage'])[list_position(s, best)] else 'Other' end as cell_type
      from (select *, list_max(s) as best from scores)""", "disc": DISC}))
def cell_thumbnail(v):
    return T.cell_raster(K.type_scored(cells(v)), RAST_TYPES, 768, 768).select(
        "slide_id", F.col("ty").cast("bigint").alias("ty"), F.col("tx").cast("bigint").alias("tx"), "cell_type")


# ---- polygons -----------------------------------------------------------------------
AREA = """select slide_id, tissue_id, ring, is_hole, abs(list_sum(list_transform(range(1, len(pts)+1),
   lambda i: pts[i].x*pts[i%len(pts)+1].y - pts[i%len(pts)+1].x*pts[i].y)))/2 as area from rings"""


@query("contour_areas", "AGG-37", sql_r6(with_views("rings", """
    select slide_id, tissue_id, sum(case when is_hole then -area else area end)*0.25 as area from ar group by all""", {"ar": AREA}), ["area"]))
def contour_areas(v):
    return r6(T.contour_area(v.rings, 0.5))


@query("largest_holes", "WIN-03", with_views("rings", """
    select slide_id, tissue_id, ring, area from (select *, row_number() over (partition by slide_id, tissue_id order by area desc, ring) as rn
      from ar where is_hole and area > 100) where rn <= 1""", {"ar": AREA}))
def largest_holes(v):
    return T.top_holes(v.rings, 1, 100.0).select("slide_id", "tissue_id", "ring", "area")


@query("tissue_rings", "TIL-12 PRJ-13", with_views("rings", """
    select slide_id, tissue_id, ring, unnest(range(len(pts))) as i, unnest(list_transform(pts, lambda p: cast(trunc(p.x*2.5) as bigint))) as x,
      unnest(list_transform(pts, lambda p: cast(trunc(p.y*2.5) as bigint))) as y from rings join ar using (slide_id, tissue_id, ring)
      where not ar.is_hole or ar.area > 1000""", {"ar": AREA}))
def tissue_rings(v):
    d = T.tissue_rings(v.rings, 1000.0, 1000.0, scale=2.5)
    return d.select("slide_id", "tissue_id", "ring", F.posexplode("pts").alias("i", "p")).select(
        "slide_id", "tissue_id", "ring", F.col("i").cast("bigint").alias("i"), "p.x", "p.y")


SEG = {"sg": """select slide_id, tissue_id, pts[i].x as ax, pts[i].y as ay, pts[i%len(pts)+1].x as cx, pts[i%len(pts)+1].y as cy
   from (select *, unnest(range(1, len(pts)+1)) as i from rings)"""}


def _inside(points: str, cols: str) -> str:
    return f"""select distinct {cols} from (select {', '.join('p.' + c.strip() for c in cols.split(','))}, sg.tissue_id,
      count(*) filter (where (ay>p.y)<>(cy>p.y) and p.x < (cx-ax)*(p.y-ay)/(cy-ay)+ax) as h,
      bool_or((cx-ax)*(p.y-ay)-(cy-ay)*(p.x-ax)=0 and p.x between least(ax,cx) and greatest(ax,cx) and p.y between least(ay,cy) and greatest(ay,cy)) as onb
      from ({points}) p join sg on sg.slide_id=p.slide_id group by all) where h%2=1 and not onb"""


@query("cells_in_tissue", "JOI-06", with_views("cells rings", _inside("select slide_id, cell_id, x, y from cells", "slide_id, cell_id"), SEG))
def cells_in_tissue(v):
    return T.points_in_polygons(v.cells.select("slide_id", "cell_id", "x", "y"), v.rings).select("slide_id", "cell_id")


@query("patches_in_tissue", "JOI-06 JOI-07", with_views("slides rings", "select distinct slide_id, ty as y, tx as x from (" + _inside(
    "select slide_id, ty, tx, ty+a as y, tx+b as x from tl, (values (0),(128)) o(a), (values (0),(128)) q(b)", "slide_id, ty, tx, x, y") + ")",
    {**SEG, "tl": f"select slide_id, ty, {_seq('0', 'w-128+1', 128)} as tx from (select *, {_seq('0', 'h-128+1', 128)} as ty from slides)"}))
def patches_in_tissue(v):
    return T.patches_in_tissue(T.grid(v.slides, 128, 128), v.rings, 128).select("slide_id", "y", "x")


@query("near_tissue_points", "JOI-07 SET-03", with_views("cells rings", """
    select distinct slide_id, cell_id from cells join (select slide_id, tissue_id, min(p.x)-20 as x0, max(p.x)+20 as x1, min(p.y)-20 as y0, max(p.y)+20 as y1
      from (select slide_id, tissue_id, unnest(pts) as p from rings) group by all) using (slide_id) where x>=x0 and x<x1 and y>=y0 and y<y1"""))
def near_tissue_points(v):
    return T.bbox_join(v.cells.select("slide_id", "cell_id", "x", "y"), v.rings, 20).select("slide_id", "cell_id")


@query("tissue_mask", "TIL-11", with_views("slides rings", "select distinct slide_id, my as y, mx as x from (" + _inside(
    "select slide_id, my, mx, (my+0.5)*16::double as y, (mx+0.5)*16::double as x from g", "slide_id, my, mx") + ")",
    {**SEG, "g": "select slide_id, my, unnest(range(cast(floor(w/16) as bigint))) as mx from (select *, unnest(range(cast(floor(h/16) as bigint))) as my from slides)"}))
def tissue_mask(v):
    return T.polygon_mask(v.slides, v.rings, 16)


@query("tiles_on_mask", "JOI-08", with_views("slides raster", """
    select slide_id, y, x from tl where exists (select 1 from raster r where r.slide_id=tl.slide_id and r.value > 0.99
      and r.ax >= round_even(tl.x/16.0,0) and r.ax < round_even((tl.x+100)/16.0,0) and r.ay >= round_even(tl.y/16.0,0) and r.ay < round_even((tl.y+100)/16.0,0))""",
    {"tl": f"select slide_id, y, {_seq('0', 'w-100+1', 100)} as x from (select *, {_seq('0', 'h-100+1', 100)} as y from slides)"}))
def tiles_on_mask(v):
    mask = v.raster.filter("value > 0.99").select("slide_id", F.col("ay").alias("y"), F.col("ax").alias("x"))
    return T.tiles_on_mask(T.grid(v.slides, 100, 100), mask, 1 / 16, 100).select("slide_id", "y", "x")
