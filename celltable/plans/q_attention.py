"""Attention, survival, embedding and learning queries."""

from pyspark.sql import functions as F

from celltable.functions import columns as C
from celltable.operators import attention as A, embeddings as E, learning as L, patches as P, survival as S
from celltable.operators.skew import avg_rank, has_hot_group, row_index
from celltable.plans.q_cells import PID, cells, typed, typed_sql
from celltable.plans.registry import query, r6, sql_r6
from celltable.plans.views import with_views

PT = {"pt": f"""select slide_id, patch_id, n_cells, a, cd3, cd8, cast(split_part(patch_id,'_',1) as int) as py,
    cast(split_part(patch_id,'_',2) as int) as px from (select slide_id, {PID} as patch_id, count(*) as n_cells,
    sum(nucleus_area) as a, avg("CD3") as cd3, avg("CD8") as cd8 from cells group by all)""",
    "att": """select p.slide_id, p.patch_id, avg(value) as attn_mean, median(value) as attn_median,
    max(value) as attn_max, quantile_cont(value, .9) as attn_p90 from pt p join raster r on r.slide_id=p.slide_id
    and r.ax >= floor((p.px-40)/16) and r.ax < ceil((p.px+256-40)/16)
    and r.ay >= floor((p.py-40)/16) and r.ay < ceil((p.py+256-40)/16) group by all"""}
ATT = ["attn_mean", "attn_median", "attn_max", "attn_p90"]


def patch_table(v):
    d = P.with_patch(cells(v)).groupBy("slide_id", "patch_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("nucleus_area").alias("a"), F.avg("CD3").alias("cd3"),
        F.avg("CD8").alias("cd8"))
    return A.patch_xy(d)


@query("attention_stats", "AGG-26 JOI-05 PRJ-02 UDF-02", sql_r6(with_views("cells raster", f"""
    select pt.slide_id, pt.patch_id, {', '.join(ATT)} from pt left join att using (slide_id, patch_id)""", PT), ATT))
def attention_stats(v):
    return r6(A.attention_stats(patch_table(v), v.raster, 16, (40, 40)).select("slide_id", "patch_id", *ATT))


@query("feature_attention_correlation", "AGG-27 WIN-01 WIN-11", sql_r6(with_views("cells raster", """
    select feature, count(*) as n, corr(rx, ry) as spearman_r, corr(x, y) as pearson_r from (
      select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x)-1)/2 as rx,
        rank() over (partition by feature order by y) + (count(*) over (partition by feature, y)-1)/2 as ry
      from (unpivot (select n_cells::double as n_cells, a::double as a, cd3::double as cd3, cd8::double as cd8, floor(attn_mean*1e6+0.5)/1e6 as y
        from pt join att using (slide_id, patch_id)) on n_cells, a, cd3, cd8 into name feature value x))
    group by feature""", PT), ["spearman_r", "pearson_r"]))
def feature_attention_correlation(v):
    p = patch_table(v)
    d = A.attention_stats(p, v.raster, 16, (40, 40), reductions=("mean",))
    c = A.correlate(r6(d, "attn_mean"), features=["n_cells", "a", "cd3", "cd8"])
    return r6(c.select("feature", "n", "spearman_r", "pearson_r"))


@query("correlation_p_values", "AGG-27")
def correlation_p_values(v):
    d = A.attention_stats(patch_table(v), v.raster, 16, (40, 40), reductions=("mean",))
    return A.correlate(d, features=["n_cells", "a", "cd3", "cd8"])


@query("average_ranks", "WIN-01", with_views("cells", """
    select slide_id, cell_id, rank() over (partition by slide_id order by "CD3") +
      (count(*) over (partition by slide_id, "CD3")-1)/2 as rank from cells"""))
def average_ranks(v):
    return avg_rank(cells(v), ["slide_id"], "CD3").select("slide_id", "cell_id", "rank")


@query("patch_preview", "TIL-14 WIN-11", with_views("cells", """
    select slide_id, patch_id, px, py, px+256 > 700 as overlaps from pt order by slide_id, patch_id limit 10""", PT))
def patch_preview(v):
    p = patch_table(v).withColumn("overlaps", F.col("px") + 256 > 700)
    return A.preview(p.select("slide_id", "patch_id", F.col("px").cast("int").alias("px"),
                              F.col("py").cast("int").alias("py"), "overlaps"))


SCALES = [0.8, 0.9, 1.0, 1.1, 1.2]


@query("grid_register", "JOI-22 WIN-06", sql_r6(with_views("raster cells", """
    select slide_id, scale, off_x, off_y, score, n from (select *, row_number() over (partition by slide_id order by score desc, ord) as rn
    from (select p.slide_id, c.ord, c.scale, any_value(c.tx) as off_x, any_value(c.ty) as off_y, -avg(r.value) as score, count(*) as n
      from (select slide_id, floor(x/16) as x, floor(y/16) as y from cells) p, cand c, raster r
      where p.x*c.scale+c.tx >= 0 and p.x*c.scale+c.tx < 48 and p.y*c.scale+c.ty >= 0 and p.y*c.scale+c.ty < 48
        and r.slide_id=p.slide_id and r.ax = cast(trunc(p.x*c.scale+c.tx) as int) and r.ay = cast(trunc(p.y*c.scale+c.ty) as int)
      group by p.slide_id, c.ord, c.scale having count(*) >= 100)) where rn = 1""",
    {"cand": "select cast(s.i*5+k.i as int) as ord, s.s::double as scale, 24-48*s.s::double/2+k.dx::double*0.15*48 as tx, "
             "24-48*s.s::double/2+k.dy::double*0.15*48 as ty from (values (0,0.8),(1,0.9),(2,1.0),(3,1.1),(4,1.2)) s(i,s), "
             "(values (0,0,0),(1,-1,0),(2,1,0),(3,0,-1),(4,0,1)) k(i,dx,dy)"}),
    ["scale", "off_x", "off_y", "score"]))
def grid_register(v):
    pts = v.cells.select("slide_id", F.floor(F.col("x") / 16).alias("x"), F.floor(F.col("y") / 16).alias("y"))
    d = v.raster.select("slide_id", F.col("ax").alias("x"), F.col("ay").alias("y"), "value")
    return r6(A.grid_register(pts, d, (48, 48), (48, 48), 1.0, SCALES))


# ---- survival -----------------------------------------------------------------------
EDGES = """select min(t)-1e-6 as lo, max(t)+1e-6 as hi, quantile_cont(t, .25) filter (where event=1) as e1,
    quantile_cont(t, .5) filter (where event=1) as e2, quantile_cont(t, .75) filter (where event=1) as e3 from tt"""
TT = {"tt": "select id, days::double as t, event, risk from cohort", "e": EDGES}
BIN = "(cast(t>=e1 as int)+cast(t>=e2 as int)+cast(t>=e3 as int))"


def cohort(v):
    return v.cohort.withColumn("t", F.col("days").cast("double"))


@query("survival_bins", "WIN-07 LBL-01", with_views("cohort", f"""
    select id, {BIN} as bin, {BIN}*2+event as label from tt, e""", TT))
def survival_bins(v):
    d = S.discretize_time(cohort(v), "t", "event")
    return d.select("id", "bin", S.survival_label("bin", "event").alias("label"))


@query("class_weights", "SMP-05 LBL-02", sql_r6(with_views("cohort", f"""
    select id, label, n_all/count(*) over (partition by label) as weight from
    (select id, {BIN}*2+event as label, count(*) over () as n_all from tt, e)""", TT), ["weight"]))
def class_weights(v):
    d = S.discretize_time(cohort(v), "t", "event").select("id", S.survival_label("bin", "event").alias("label"))
    return r6(S.balance_weights(d).select("id", "label", "weight"))


@query("class_sizes", "LBL-02", with_views("cohort", f"""
    select label, count(*) as n, min(id) as first_id from (select id, {BIN}*2+event as label from tt, e) group by label""", TT))
def class_sizes(v):
    d = S.discretize_time(cohort(v), "t", "event").select("id", S.survival_label("bin", "event").alias("label"))
    return S.class_index(d)


HZ = "select *, list_transform(logits, lambda z: 1/(1+exp(-z))) as h from logits"


@query("hazard_risk", "PRJ-23", sql_r6(with_views("logits", """
    select id, -((1-h[1]) + (1-h[1])*(1-h[2]) + (1-h[1])*(1-h[2])*(1-h[3]) + (1-h[1])*(1-h[2])*(1-h[3])*(1-h[4])) as risk
    from hz""", {"hz": HZ}), ["risk"]))
def hazard_risk(v):
    return r6(v.logits.select("id", C.hazard_to_risk("logits").alias("risk")))


@query("survival_loss", "LOS-01", sql_r6(with_views("logits", """
    select avg(0.6*(event*dead+(1-event)*alive)+0.4*event*dead) as loss, count(*) as n from (select event,
      -(ln(greatest(s[bin+1],1e-7)) + ln(greatest(h[bin+1],1e-7))) as dead, -ln(greatest(s[bin+2],1e-7)) as alive
      from (select *, [1.0::double, 1-h[1], (1-h[1])*(1-h[2]), (1-h[1])*(1-h[2])*(1-h[3]),
        (1-h[1])*(1-h[2])*(1-h[3])*(1-h[4])] as s from hz))""", {"hz": HZ}), ["loss"]))
def survival_loss(v):
    return r6(S.nll_survival(v.logits))


@query("concordance", "JOI-23", sql_r6(with_views("cohort", """
    select comparable, concordant, tied, (concordant+0.5*tied)/comparable as c_index from (
      select count(*) as comparable, count(*) filter (where b.risk < a.risk-1e-8) as concordant,
        count(*) filter (where abs(b.risk-a.risk) <= 1e-8) as tied
      from tt a join tt b on a.event=1 and (b.t>a.t or (b.t=a.t and b.event=0)))""", TT), ["c_index"]))
def concordance(v):
    return r6(S.c_index(cohort(v), "t", "event", "risk"))


LOG = {"mlog": "select user_id as run, row_number() over (partition by user_id order by ts, event_id)-1 as epoch, value as metric from events"}


def metric_log(v):
    d = v.events.select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("metric"))
    return row_index(d, ["run"], ["ts", "event_id"], "epoch").select("run", "epoch", "metric")


@query("early_stopping", "WIN-10", "WITH " + ", ".join(f"{k} as ({s})" for k, s in LOG.items()) + """
    select run, epoch, best, epoch-best_epoch as wait, epoch-best_epoch >= 5 and epoch > 20 as stop from (
      select *, max(case when metric >= best then epoch end) over (partition by run order by epoch) as best_epoch from (
        select *, max(metric) over (partition by run order by epoch) as best from mlog where epoch >= 2))""")
def early_stopping(v):
    return S.early_stop(metric_log(v), ["run"]).select("run", "epoch", "best", "wait", "stop")


@query("moving_average", "WIN-08", sql_r6("WITH RECURSIVE " + ", ".join(f"{k} as ({s})" for k, s in LOG.items()) + """,
    r as (select run, epoch, metric::double as ema from mlog where epoch = 0 union all
      select r.run, r.epoch+1, 0.95*r.ema+0.05*m.metric from r join mlog m on m.run=r.run and m.epoch=r.epoch+1)
    select * from r""", ["ema"], "1000003.0"))
def moving_average(v):
    return r6(S.ema(metric_log(v), ["run"], ["epoch"], "metric").select("run", "epoch", "ema"), scale="1000003.0D")


# ---- embeddings ---------------------------------------------------------------------

@query("mean_embedding", "AGG-21", sql_r6("""
    select slide_id, i, avg(x::double) as v, count(*) as n_members from (
      select cast(label as varchar) as slide_id, unnest(embedding) as x, unnest(range(64)) as i from embeddings) group by all""", ["v"]))
def mean_embedding(v):
    m = E.mean_vectors(v.bags, ["slide_id"])
    return r6(m.select("slide_id", "n_members", F.posexplode("feature").alias("i", "v"))
              .withColumn("i", F.col("i").cast("bigint")))


@query("vector_norms", "PRJ-24", sql_r6("""
    select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))) as norm,
      embedding[1]::double/sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))) as first_unit from embeddings""",
    ["norm", "first_unit"]))
def vector_norms(v):
    return r6(v.embeddings.select("vec_id", C.norm2("embedding").alias("norm"), C.l2norm("embedding")[0].alias("first_unit")))


@query("vector_moments", "AGG-29", sql_r6("""
    select (list_transform(range(64), lambda i: i::bigint))[k] as i, avg(e[k]) as mean, var_samp(e[k]) as variance,
      covar_samp(e[k], e[1]) as cov_first from (select embedding::double[] as e, unnest(range(1,65)) as k from embeddings) group by k""",
    ["mean", "variance", "cov_first"]))
def vector_moments(v):
    mu, c = E.moments(v.embeddings, "embedding")
    rows = [(i, float(mu[i]), float(c[i, i]), float(c[i, 0])) for i in range(len(mu))]
    return r6(v.spark.createDataFrame(rows, "i bigint, mean double, variance double, cov_first double"))


@query("frechet_distance", "AGG-30")
def frechet_distance(v):
    e = v.embeddings
    low = e.filter(F.col("label") < 5)
    d = E.frechet(low, e.join(low.select("vec_id"), "vec_id", "left_anti"), "embedding")
    return v.spark.createDataFrame([(float(d),)], "frechet double")


@query("smooth_rank", "AGG-31")
def smooth_rank(v):
    return v.spark.createDataFrame([(E.smooth_rank(v.embeddings, "embedding"),)], "smooth_rank double")


BATCH = {"d": "select cast(floor(vec_id/50) as bigint) as batch, vec_id, feature::double[] as q from bags",
         "sim": """select a.batch, a.vec_id as i, b.vec_id as j, list_cosine_similarity(a.q, list_transform(range(1,65),
            lambda k: b.q[k] + 0.1*b.q[65-k]))/0.1 as s from d a join d b on a.batch=b.batch"""}


@query("contrastive_loss", "JOI-24", sql_r6(with_views("bags", """
    select batch, (li+lj)/2 as loss from (select batch, avg(l) as li from (select batch, i, ln(sum(exp(s)))-max(s) filter (where i=j) as l from sim group by all) group by batch)
    join (select batch, avg(l) as lj from (select batch, j, ln(sum(exp(s)))-max(s) filter (where i=j) as l from sim group by all) group by batch) using (batch)""",
    BATCH), ["loss"]))
def contrastive_loss(v):
    d = v.bags.select(F.floor(F.col("vec_id") / 50).alias("batch"), "vec_id",
                      F.transform("feature", lambda x: x.cast("double")).alias("q"))
    d = d.withColumn("p", F.zip_with("q", F.reverse("q"), lambda a, b: a + b * 0.1))
    return r6(E.info_nce(d, "batch", "vec_id", "q", "p", symmetric=True))


# ---- sampling and scores ------------------------------------------------------------

@query("half_sample", "SMP-01")
def half_sample(v):
    return L.half_sample(v.bags, seed=7).select("slide_id", "vec_id")


@query("repeat_sample", "SMP-02")
def repeat_sample(v):
    return L.repeat_sample(v.image_names.select("p_partkey"), 1000, 5, 1, "p_partkey")


@query("bag_sample", "SMP-03")
def bag_sample(v):
    return L.bag_sample(v.bags.select("slide_id", "vec_id"), 50, seed=3)


@query("k_shot", "SMP-04")
def k_shot(v):
    return L.k_shot(v.task_labels, 10, 0, "er")


@query("weighted_draw", "SMP-06")
def weighted_draw(v):
    return L.weighted_draw(v.part.select("p_partkey", "p_size"), "p_size", 5000, 11, "p_partkey")


@query("split_rows", "JOI-13 SRC-09", with_views("cohort", "select id, risk from cohort where split = 'train'"))
def split_rows(v):
    c = v.cohort
    return c.select("id", "risk").join(c.filter("split = 'train'").select("id"), "id", "left_semi")


@query("labelled_embeddings", "JOI-14", with_views("bags task_labels", """
    select cast(b.vec_id as varchar) as slide_id, t.her2 as label from bags b join task_labels t
    on t.slide_id = cast(b.vec_id as varchar) where t.her2 <> -1"""))
def labelled_embeddings(v):
    emb = v.bags.select(F.col("vec_id").cast("string").alias("slide_id"), F.col("feature").alias("embedding"))
    return L.labelled(emb, v.task_labels, "her2").select("slide_id", "label")


@query("holdout_rows", "JOI-15", with_views("cohort", "select id from cohort where split <> 'train'"))
def holdout_rows(v):
    c = v.cohort
    return L.holdout(c, c.filter("split = 'train'"), "id").select("id")


@query("standardized", "EVL-01", sql_r6("""
    select c_custkey, (c_acctbal-avg(c_acctbal) over ())/stddev_pop(c_acctbal) over () as c_acctbal from customer""", ["c_acctbal"]))
def standardized(v):
    return r6(L.standardize(v.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("roc_auc", "EVL-03", sql_r6(with_views("cohort", """
    select segment, (sum(rk) filter (where event=1) - p*(p+1)/2)/(p*n) as auc, p as n_pos, n as n_neg from (
      select segment, event, rank() over (partition by segment order by risk)+(count(*) over (partition by segment, risk)-1)/2 as rk,
      count(*) filter (where event=1) over (partition by segment) as p, count(*) filter (where event=0) over (partition by segment) as n
      from cohort) group by segment, p, n"""), ["auc"]))
def roc_auc(v):
    return r6(L.roc_auc(v.cohort, "event", "risk", ["segment"]))


@query("roc_auc_multiclass", "EVL-03", sql_r6("""
    select avg(auc) as auc_macro from (select cls, (sum(rk) filter (where y=1)-p*(p+1)/2)/(p*n) as auc from (
      select cls, y, rank() over (partition by cls order by s)+(count(*) over (partition by cls, s)-1)/2 as rk,
        count(*) filter (where y=1) over (partition by cls) as p, count(*) filter (where y=0) over (partition by cls) as n
      from (select k as cls, cast(o_custkey%3=k as int) as y, case k when 0 then o_totalprice when 1 then -o_totalprice
        else o_totalprice*((o_orderkey%7)-3) end as s from (select *, unnest([0,1,2]) as k from orders))) group by cls, p, n)""", ["auc_macro"]))
def roc_auc_multiclass(v):
    d = v.orders.select((F.col("o_custkey") % 3).alias("y"), F.col("o_totalprice").alias("s0"),
                        (-F.col("o_totalprice")).alias("s1"),
                        (F.col("o_totalprice") * (F.col("o_orderkey") % 7 - 3)).alias("s2"))
    return r6(L.roc_auc_ovr(d, "y", {0: "s0", 1: "s1", 2: "s2"}))


CONF = "select c_nationkey%5 as true, cast(c_custkey%5 as int) as pred, count(*) as value from customer group by all"


def conf(v):
    d = v.customer.select((F.col("c_nationkey") % 5).alias("t"), (F.col("c_custkey") % 5).cast("int").alias("p"))
    return L.confusion(d, "t", "p")


@query("confusion", "EVL-07", CONF)
def confusion(v):
    return conf(v)


@query("balanced_accuracy", "EVL-04", sql_r6(f"""
    select avg(r) as balanced_accuracy from (select "true", sum(value) filter (where "true"=pred)/sum(value) as r
    from ({CONF}) group by "true")""", ["balanced_accuracy"]))
def balanced_accuracy(v):
    return r6(L.balanced_accuracy(conf(v)))


@query("quadratic_kappa", "EVL-05", sql_r6(f"""
    with c as ({CONF}), t as (select "true" as i, sum(value) as n from c group by 1), p as (select pred as j, sum(value) as n from c group by 1)
    select 1-(select sum(value*("true"-pred)**2) from c)/(select sum(t.n*p.n*(i-j)**2)/(select sum(value) from c) from t, p) as q_kappa""", ["q_kappa"]))
def quadratic_kappa(v):
    return r6(L.quadratic_kappa(conf(v)))


@query("repeat_summary", "AGG-34", sql_r6("""
    select event_type, n, mean, sd, case when n<3 then mean-2*sd else q1 end as lo, case when n<3 then mean+2*sd else q2 end as hi from (
      select event_type, count(value) as n, avg(value) as mean, coalesce(stddev_samp(value),0) as sd,
        quantile_cont(value,.025) as q1, quantile_cont(value,.975) as q2 from events group by event_type)""", ["mean", "sd", "lo", "hi"]))
def repeat_summary(v):
    return r6(L.repeat_summary(v.events, ["event_type"], "value"))


def probe_data(v):
    return v.embeddings.select(F.col("vec_id").cast("string").alias("slide_id"), "embedding")


@query("linear_probe", "EVL-02")
def linear_probe(v):
    d = L.labelled(probe_data(v), v.task_labels, "er")
    train = L.k_shot(d, 25, 0, "label")
    return L.linear_probe(train, L.holdout(d, train)).select("slide_id", "label", "pred", "score")


@query("probe_grid", "EVL-06")
def probe_grid(v):
    return L.probe_grid(probe_data(v), v.task_labels, ["er", "pr"], [1, 10, 25], 10)
