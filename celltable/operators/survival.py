"""Survival labels, losses and concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from celltable.functions.columns import sigmoid
from celltable.operators.skew import prefix_agg, quantiles


def time_edges(df: DataFrame, time: str, event: str, n_bins: int = 4, eps: float = 1e-6) -> list[float]:
    """Quantile edges of the event times; the outer two are the global range widened by eps.

    Only the n_bins+1 edges reach the driver."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = quantiles(df.filter(F.col(event) == 1).select(F.lit(1).alias("_g"), F.col(time).cast("double").alias("_t")),
                  ["_g"], ["_t"], probs).first()
    if q is None:
        raise ValueError("no events to learn time bins from")
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    return [float(lo) - eps, *q["_t_q"][1:-1], float(hi) + eps]


def discretize_time(df: DataFrame, time: str = "time", event: str = "event", n_bins: int = 4, eps: float = 1e-6,
                    out: str = "bin") -> DataFrame:
    """Bin number, left-closed, by edges learned on the event rows."""
    inner = time_edges(df, time, event, n_bins, eps)[1:-1]
    n = sum((F.when(F.col(time) >= e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(out, n.cast("int"))


def survival_label(bin_: Column | str, event: Column | str) -> Column:
    return (F.col(bin_) if isinstance(bin_, str) else bin_) * 2 + (F.col(event) if isinstance(event, str) else event)


def class_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Size of each class that occurs, with its smallest id."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def balance_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """N / n_c per row.  Class counts are a short aggregate joined back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c")).first()[0]
    return df.join(counts, label).withColumn(out, F.lit(float(total or 0)) / F.col("_c")).drop("_c")


def nll_terms(logits: str = "logits", y: str = "bin", event: str = "event", alpha: float = 0.4,
              eps: float = 1e-7) -> Column:
    """Discrete-time negative log-likelihood of one row; censored part weighted by 1-alpha."""
    h = F.transform(F.col(logits), lambda z: sigmoid(z.cast("double")))

    def surv(k: Column) -> Column:
        return F.aggregate(F.slice(h, F.lit(1), k), F.lit(1.0), lambda s, x: s * (F.lit(1.0) - x))

    def log(c: Column) -> Column:
        return F.log(F.greatest(c, F.lit(eps)))

    k = F.col(y).cast("int")
    dead = -(log(surv(k)) + log(F.element_at(h, k + 1)))
    alive = -log(surv(k + 1))
    e = F.col(event).cast("double")
    full = e * dead + (F.lit(1.0) - e) * alive
    return (1.0 - alpha) * full + alpha * e * dead


def nll_survival(df: DataFrame, **kw) -> DataFrame:
    return df.agg(F.avg(nll_terms(**kw)).alias("loss"), F.count(F.lit(1)).alias("n"))


def c_index(df: DataFrame, time: str = "time", event: str = "event", risk: str = "risk", tied_tol: float = 1e-8,
            split: bool | None = None) -> DataFrame:
    """Concordance counts and index without listing pairs.

    A pair counts when i has an event and j lives longer, or the same time censored.
    Rows get a rank g of (time, censored).  Two different ranks differ first at
    exactly one bit, so every comparable pair meets in exactly one (bit, prefix)
    block, i on the 0 side and j on the 1 side.  Inside a block the partners of
    lower and of tied risk are counted by running totals over the risk order:
    n log n rows, no pair join."""
    d = df.select(F.col(time).cast("double").alias("t"), (F.col(event) == 1).cast("int").alias("e"),
                  F.col(risk).cast("double").alias("r"))
    d = d.filter(F.col("t").isNotNull() & F.col("r").isNotNull())
    points = d.groupBy("t", "e").agg(F.count(F.lit(1)).alias("c"))
    ranks = prefix_agg(points, [], ["t", F.desc("e")], F.lit(1).cast("bigint"), "g", split=split)
    top = ranks.agg(F.max("g")).first()[0] or 0
    bits = max(1, int(top).bit_length())
    d = d.join(ranks.select("t", "e", "g"), ["t", "e"])
    b = d.select("e", "r", "g", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    b = b.withColumns({"block": F.expr("shiftright(g, bit + 1)"), "one": F.expr("shiftright(g, bit) & 1")})
    # marker order at one value: low query (strictly below), point, high query (up to)
    tol = float(tied_tol)
    marks = b.filter((F.col("one") == 1) | (F.col("e") == 1)).select("bit", "block", F.explode(
        F.when(F.col("one") == 1, F.array(F.struct(F.col("r").alias("v"), F.lit(1).alias("kind"))))
        .otherwise(F.array(F.struct((F.col("r") - tol).alias("v"), F.lit(0).alias("kind")),
                           F.struct((F.col("r") + tol).alias("v"), F.lit(2).alias("kind"))))).alias("m"))
    hist = marks.groupBy("bit", "block", "m.v", "m.kind").agg(F.count(F.lit(1)).alias("c"))
    run = prefix_agg(hist, ["bit", "block"], ["v", "kind"],
                     F.when(F.col("kind") == 1, F.col("c")).otherwise(F.lit(0).cast("bigint")), "seen", split=split)
    all_j = hist.filter("kind = 1").groupBy("bit", "block").agg(F.sum("c").alias("all_j"))
    run = run.join(all_j, ["bit", "block"])
    below = F.sum(F.when(F.col("kind") == 0, F.col("c") * F.col("seen")))
    upto = F.sum(F.when(F.col("kind") == 2, F.col("c") * F.col("seen")))
    pairs = F.sum(F.when(F.col("kind") == 0, F.col("c") * F.col("all_j")))
    s = run.agg(pairs.alias("comparable"), below.alias("concordant"), (upto - below).alias("tied"))
    return s.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") * 0.5, F.col("comparable")))


def early_stop(log: DataFrame, keys: list[str], epoch: str = "epoch", metric: str = "metric", patience: int = 5,
               warmup: int = 2, stop_epoch: int = 20, split: bool | None = None) -> DataFrame:
    """Best metric so far, epochs since it last improved (a tie improves) and the stop flag.

    Epochs before ``warmup`` are ignored."""
    d = log.filter(F.col(epoch) >= warmup)
    d = prefix_agg(d, keys, [epoch], metric, "best", "max", split)
    hit = F.when(F.col(metric) >= F.col("best"), F.col(epoch))
    d = prefix_agg(d, keys, [epoch], hit, "best_epoch", "max", split)
    wait = F.col(epoch) - F.col("best_epoch")
    return d.withColumns({"wait": wait, "stop": (wait >= patience) & (F.col(epoch) > stop_epoch)})


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.95, out: str = "ema",
        split: bool | None = None) -> DataFrame:
    """Exponential moving average seeded by the first value.

    Rows are numbered and cut into blocks after which older terms weigh less than
    1e-5; a block needs its own rows and the sums of the blocks before it, as far back
    as a weight is not zero in double precision, so long runs spread over tasks."""
    import math

    from pyspark.sql import Window
    from celltable.operators.skew import row_index
    size = max(1, math.ceil(-11.6 / math.log(alpha))) if 0 < alpha < 1 else 1
    d = row_index(df, keys, order, "_i", split)
    d = d.withColumns({"_b": F.floor(F.col("_i") / size), "_p": F.col("_i") % size,
                       "_w": F.when(F.col("_i") == 0, F.col(value)).otherwise(F.col(value) * (1 - alpha))})
    a = F.lit(float(alpha))
    w = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.sum(F.col("_w") * F.pow(a, -F.col("_p"))).over(w) * F.pow(a, F.col("_p")))
    tail = d.groupBy(*keys, "_b").agg(F.sum(F.col("_w") * F.pow(a, (size - 1) - F.col("_p"))).alias("_t"))
    reach = 1
    while (alpha ** size) ** reach > 0.0 and 0 < alpha < 1:
        reach += 1
    carry = (tail.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(reach))))
             .select(*keys, (F.col("_b") + F.col("_k")).alias("_b"),
                     (F.col("_t") * F.pow(a, (F.col("_k") - 1) * size)).alias("_t"))
             .groupBy(*keys, "_b").agg(F.sum("_t").alias("_in")))
    d = d.join(carry, [*keys, "_b"], "left")
    return (d.withColumn(out, F.col("_own") + F.coalesce("_in", F.lit(0.0)) * F.pow(a, F.col("_p") + 1))
            .drop("_i", "_b", "_p", "_w", "_own", "_in"))
