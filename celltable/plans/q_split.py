"""The same queries with every group spread over many tasks, under the same SQL, and spread statistics with NULL keys."""

from pyspark.sql import functions as F

from celltable.operators import cells as K, graph as G, learning as L, patches as P, records as R, spatial as S, survival as V
from celltable.operators.skew import avg_rank, prefix_agg, quantiles
from celltable.plans import q_attention, q_cells, q_graph, q_records  # noqa: F401  their SQL is registered first
from celltable.plans.registry import ORACLES, query, r6, sql_r6


@query("slide_thresholds_spread", "AGG-16 AGG-17", ORACLES["slide_thresholds"])
def slide_thresholds_spread(v):
    return r6(K.thresholds(q_cells.cells(v), split=True))


@query("patch_features_spread", "AGG-02 AGG-03 AGG-04", ORACLES["patch_features"])
def patch_features_spread(v):
    return r6(P.patch_features(q_cells.patched(v), split=True))


@query("file_parts_spread", "WIN-04", ORACLES["file_parts"])
def file_parts_spread(v):
    return R.chunk(v.image_names.select("brand", "path", "p_partkey"), ["brand"], ["path", "p_partkey"], 20, split=True)


@query("early_stopping_spread", "WIN-10", ORACLES["early_stopping"])
def early_stopping_spread(v):
    return V.early_stop(q_attention.metric_log(v), ["run"], split=True).select("run", "epoch", "best", "wait", "stop")


@query("moving_average_spread", "WIN-08", ORACLES["moving_average"])
def moving_average_spread(v):
    return r6(V.ema(q_attention.metric_log(v), ["run"], ["epoch"], "metric", split=True).select("run", "epoch", "ema"), scale="1000003.0D")


@query("roc_auc_spread", "EVL-03", ORACLES["roc_auc"])
def roc_auc_spread(v):
    return r6(L.roc_auc(v.cohort, "event", "risk", ["segment"], split=True))


@query("components_spread", "GRF-04 GRF-05", ORACLES["components"])
def components_spread(v):
    n = q_graph.nodes(v)
    return r6(G.component_stats(G.components(n, q_graph.near(n), small=0)))


_GAPS = """select nullif(event_type, 'click') as k, event_id, case when event_type = 'view' or event_id % 3 = 0 then null else value end as x from events"""


def gaps(v):
    """Events with a NULL key, a key of NULL values only, and NULL values."""
    kind = F.col("event_type")
    return v.events.select(F.when(kind != "click", kind).alias("k"), "event_id", F.when((kind != "view") & (F.col("event_id") % 3 != 0), F.col("value")).alias("x"))


@query("null_key_quantiles", "AGG-03 AGG-16", sql_r6(f"""with g as ({_GAPS}), ways(way) as (values ('one task'), ('spread'))
    select way, k, q[1] as q25, q[2] as q50, q[3] as q75 from (select k, quantile_cont(x, [0.25, 0.5, 0.75]) as q from g group by k), ways""", ["q25", "q50", "q75"]))
def null_key_quantiles(v):
    def way(name, split):
        return quantiles(gaps(v), ["k"], ["x"], [0.25, 0.5, 0.75], split=split).select(F.lit(name).alias("way"), "k", *[F.col("x_q")[i].alias(f"q{q}") for i, q in enumerate((25, 50, 75))])

    return r6(way("one task", False).unionByName(way("spread", True)))


@query("null_key_totals", "WIN-03 WIN-05", sql_r6(f"""with g as ({_GAPS}), ways(way) as (values ('one task'), ('spread'))
    select way, k, event_id, sum(x) over w as total, max(x) over w as most,
      case when x is not null then rank() over (partition by k, x is null order by x) + (count(*) over (partition by k, x) - 1) / 2.0 end as rank
    from g, ways window w as (partition by way, k order by event_id rows unbounded preceding)""".replace("partition by k, x", "partition by way, k, x"), ["total", "most", "rank"], scale="1e3"))
def null_key_totals(v):
    def way(name, split):
        d = prefix_agg(gaps(v), ["k"], ["event_id"], "x", "total", "sum", split)
        d = prefix_agg(d, ["k"], ["event_id"], "x", "most", "max", split)
        return avg_rank(d, ["k"], "x", "rank", split).select(F.lit(name).alias("way"), "k", "event_id", "total", "most", "rank")

    return r6(way("one task", False).unionByName(way("spread", True)), scale="1e3")
