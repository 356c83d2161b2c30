"""Sampling, splits, probes and classification scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from celltable.operators.skew import avg_rank, has_hot_group, prefix_agg, row_index, stable


def order_key(seed: int | Column, *ids: str) -> Column:
    """Reproducible shuffle order: a hash of the row id and the seed."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.xxhash64(*[F.col(i) for i in ids], s)


def half_sample(bags: DataFrame, seed: int, keys: list[str] = ["slide_id"], item: str = "vec_id") -> DataFrame:
    """max(1, n // 2) rows of each bag without replacement."""
    d = row_index(bags.withColumn("_h", order_key(seed, *keys, item)), keys, ["_h", item], "_i")
    n = bags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (d.join(n, keys).filter(F.col("_i") < F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
            .drop("_h", "_i", "_n"))


def repeat_sample(df: DataFrame, k: int, repeats: int, seed: int, item: str, offset: int = 0) -> DataFrame:
    """``repeats`` independent samples of k rows (all rows when there are fewer), with ``repeat``."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("_h", order_key(F.col("repeat") + F.lit(seed + offset), item))
    return row_index(d, ["repeat"], ["_h", item], "_i").filter(F.col("_i") < k).drop("_h", "_i")


def bag_sample(bags: DataFrame, n: int, seed: int, keys: list[str] = ["slide_id"], item: str = "vec_id") -> DataFrame:
    """Exactly n rows per bag: without replacement when the bag is large enough, else n draws with it."""
    d = row_index(bags.withColumn("_h", order_key(seed, *keys, item)), keys, ["_h", item], "_i")
    size = bags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(size, keys)
    big = d.filter((F.col("_n") >= n) & (F.col("_i") < n)).withColumn("draw", F.col("_i"))
    draws = (size.filter(F.col("_n") < n).withColumn("draw", F.explode(F.expr(f"sequence(0L, {n - 1}L)")))
             .withColumn("_i", F.pmod(F.xxhash64(*keys, "draw", F.lit(seed)), F.col("_n"))).drop("_n"))
    small = d.filter(F.col("_n") < n).join(draws, [*keys, "_i"])
    return big.unionByName(small).drop("_h", "_i", "_n")


def k_shot(labels: DataFrame, k: int, fold: int, label: str, item: str = "slide_id") -> DataFrame:
    """k rows per class; the fold number is the seed."""
    d = labels.withColumn("_h", order_key(fold, item))
    return row_index(d, [label], ["_h", item], "_i").filter(F.col("_i") < k).drop("_h", "_i")


def holdout(df: DataFrame, train: DataFrame, item: str = "slide_id") -> DataFrame:
    return df.join(train.select(item), item, "left_anti")


def weighted_draw(df: DataFrame, weight: str, n: int, seed: int, item: str) -> DataFrame:
    """n draws with replacement, probability proportional to weight.

    Cumulative weights cut [0, total) into intervals; draws are uniform numbers
    from a hash, matched to intervals through a shared bucket.  There are as many
    buckets as items, and the total is the last running total, so every draw has
    its interval."""
    cum = prefix_agg(df.withColumn("_w", F.col(weight).cast("double")), [], [item], "_w", "_hi")
    cum = stable(cum.filter("_w > 0"))
    total, buckets = cum.agg(F.max("_hi"), F.count(F.lit(1))).first()
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    width = float(total) / buckets
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("_w"))
    cum = cum.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_lo") / width), F.greatest(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)))))
    u = (F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)) * float(total)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_u", u)
    draws = draws.withColumn("_b", F.floor(F.col("_u") / width))
    return (draws.join(cum, "_b").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
            .drop("_u", "_b", "_lo", "_hi", "_w"))


def labelled(emb: DataFrame, labels: DataFrame, task: str, item: str = "slide_id") -> DataFrame:
    """Embeddings with a known label of the task (-1 means missing)."""
    return emb.join(labels.select(item, F.col(task).alias("label")), item).filter(F.col("label") != -1)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population sd over the table; a constant column divides by one."""
    stats = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).first()
    new = {c: (F.col(c) - stats[f"{c}_m"]) / (stats[f"{c}_s"] or 1.0) for c in cols}
    return df.withColumns(new)


def linear_probe(train: DataFrame, test: DataFrame, vec: str = "embedding", label: str = "label", c: float = 1.0,
                 max_iter: int = 10000) -> DataFrame:
    """Logistic regression probe; returns test rows with ``pred`` and ``score`` (last class probability)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    def as_vec(d):
        return d.withColumn("_v", array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))))
    n = train.count()
    model = LogisticRegression(featuresCol="_v", labelCol=label, predictionCol="pred", probabilityCol="_p",
                               regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                               maxIter=max_iter, tol=1e-6).fit(as_vec(train))
    out = model.transform(as_vec(test)).withColumn("score", F.element_at(vector_to_array("_p"), -1))
    return out.withColumn("pred", F.col("pred").cast("int")).drop("_v", "_p", "rawPrediction")


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] = [], split: bool | None = None) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula; NULL with one class only."""
    r = avg_rank(df, keys, score, "_r", split)
    pos = F.col(label) == 1
    p, n = F.count_if(pos), F.count_if(~pos)
    auc = F.try_divide(F.sum(F.when(pos, F.col("_r"))) - p * (p + 1) / 2.0, (p * n).cast("double"))
    g = r.groupBy(*keys) if keys else r
    return g.agg(auc.alias("auc"), p.alias("n_pos"), n.alias("n_neg"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict[int, str], split: bool | None = None) -> DataFrame:
    """Macro mean of one-vs-rest areas; the classes are a short fixed list."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("cls"), (F.col(label) == k).cast("int").alias("y"), F.col(c).alias("s"))
        for k, c in scores.items()])).alias("e")).select("e.*")
    return roc_auc(long, "y", "s", ["cls"], split).agg(F.avg("auc").alias("auc_macro"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("value"))


def balanced_accuracy(conf: DataFrame) -> DataFrame:
    rec = conf.groupBy("true").agg((F.sum(F.when(F.col("true") == F.col("pred"), F.col("value")).otherwise(0))
                                    / F.sum("value")).alias("recall"))
    return rec.agg(F.avg("recall").alias("balanced_accuracy"))


def quadratic_kappa(conf: DataFrame) -> DataFrame:
    """Quadratic weighted kappa from confusion counts.

    With squared-distance weights the expected disagreement only needs the first two
    moments of both margins, so the class-by-class outer product is never built."""
    t, p, n = F.col("true").cast("double"), F.col("pred").cast("double"), F.col("value").cast("double")
    s = conf.agg(F.sum(n).alias("n"), F.sum(n * (t - p) * (t - p)).alias("o"), F.sum(n * t).alias("t1"),
                 F.sum(n * p).alias("p1"), F.sum(n * t * t).alias("t2"), F.sum(n * p * p).alias("p2"))
    exp = F.col("t2") + F.col("p2") - F.lit(2.0) * F.col("t1") * F.col("p1") / F.col("n")
    return s.select((F.lit(1.0) - F.try_divide(F.col("o"), exp)).alias("q_kappa"))


def repeat_summary(df: DataFrame, keys: list[str], value: str, ddof: int = 1) -> DataFrame:
    """Mean, sd and 95 % interval over repeats; below three repeats mean +- 2 sd."""
    sd = F.coalesce((F.stddev_samp if ddof else F.stddev_pop)(value), F.lit(0.0))
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"),
                              F.percentile(value, [0.025, 0.975]).alias("_q"))
    few = F.col("n") < 3
    return g.select(*keys, "n", "mean", "sd",
                    F.when(few, F.col("mean") - F.col("sd") * 2).otherwise(F.col("_q")[0]).alias("lo"),
                    F.when(few, F.col("mean") + F.col("sd") * 2).otherwise(F.col("_q")[1]).alias("hi"))


def k_shot_folds(labels: DataFrame, ks: list[int], folds: int, label: str = "label", keys: list[str] = ["task"], item: str = "slide_id") -> DataFrame:
    """Training rows of every (keys, k, fold): the k first rows per class in the fold's hash order, as ``k_shot`` takes them."""
    d = labels.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    d = d.withColumn("_h", order_key(F.col("fold"), item))
    d = row_index(d, [*keys, label, "fold"], ["_h", item], "_i").filter(F.col("_i") < max(ks))
    d = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("_i") < F.col("k"))
    return d.drop("_h", "_i")


def fit_probes(train: DataFrame, keys: list[str], vec: str = "embedding", label: str = "label", c: float = 1.0, max_iter: int = 10000,
               tol: float = 1e-6, max_weights: int = 4_000_000) -> dict[tuple, np.ndarray]:
    """Logistic regressions for all values of ``keys`` in one loop of rounds: weights, the intercept last.

    Minimises |w|^2 / 2 + c * log loss, intercept free, by L-BFGS with step halving.  A round is one job: tasks add up loss and
    gradient of all open fits over their rows, and one aggregate per fit brings a vector each to the driver, which holds no
    rows.  A fit closes when no gradient entry exceeds ``tol`` times its start (or 1).  Labels are 0 and 1; fits with
    one class only are left out."""
    from celltable.operators.skew import stable
    both = train.groupBy(*keys).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    rows = stable(train.join(both, keys).select(*keys, F.col(label).cast("double").alias("_y"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("_v")))
    fits = sorted(tuple(r) for r in rows.select(*keys).distinct().collect())
    if not fits:
        return {}
    size = rows.select(F.size("_v")).first()[0] + 1
    if len(fits) * size > max_weights:
        raise ValueError(f"{len(fits)} fits of {size} weights are more than max_weights={max_weights}: fit them in groups")
    number = {f: i for i, f in enumerate(fits)}

    def losses(w: np.ndarray, open_fits: list[int]) -> tuple[np.ndarray, np.ndarray]:
        live = set(open_fits)

        def run(batches):
            import pandas as pd
            total: dict[int, np.ndarray] = {}
            for pdf in batches:
                for name, part in pdf.groupby(keys, sort=False):
                    i = number[tuple(x.item() if hasattr(x, "item") else x for x in (name if isinstance(name, tuple) else (name,)))]
                    if i not in live:
                        continue
                    x, y = np.array(part["_v"].tolist()), part["_y"].to_numpy()
                    z = x @ w[i, :-1] + w[i, -1]
                    lack = 1 / (1 + np.exp(-z)) - y
                    total[i] = total.get(i, 0) + np.concatenate([[np.logaddexp(0, z).sum() - y @ z], lack @ x, [lack.sum()]])
            if total:
                yield pd.DataFrame({"fit": list(total), "g": [v.tolist() for v in total.values()]})

        found = rows.mapInPandas(run, "fit int, g array<double>").select("fit", F.posexplode("g")).groupBy("fit", "pos").agg(F.sum("col").alias("x"))
        sums = np.zeros((len(fits), size + 1))
        for fit, pos, x in found.collect():
            sums[fit, pos] = x
        value = c * sums[:, 0] + 0.5 * (w[:, :-1] ** 2).sum(1)
        grad = c * sums[:, 1:]
        grad[:, :-1] += w[:, :-1]
        return value, grad

    w, open_fits = np.zeros((len(fits), size)), list(range(len(fits)))
    value, grad = losses(w, open_fits)
    start = np.maximum(1.0, np.abs(grad).max(1))
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in fits]
    way, step = np.zeros_like(w), np.ones(len(fits))
    for i in open_fits:
        way[i] = -grad[i] / max(1.0, np.abs(grad[i]).sum())
    for _ in range(max_iter):
        open_fits = [i for i in open_fits if np.abs(grad[i]).max() > tol * start[i]]
        if not open_fits:
            break
        trial = w.copy()
        for i in open_fits:
            trial[i] += step[i] * way[i]
        new_value, new_grad = losses(trial, open_fits)
        for i in list(open_fits):
            if not new_value[i] <= value[i] + 1e-4 * step[i] * (grad[i] @ way[i]):
                step[i] /= 2
                if step[i] < 1e-12:  # rounding ends the descent
                    open_fits.remove(i)
                continue
            s, y = trial[i] - w[i], new_grad[i] - grad[i]
            if s @ y > 1e-12 * (y @ y):
                past[i] = [*past[i][-9:], (s, y)]
            w[i], value[i], grad[i], step[i] = trial[i], new_value[i], new_grad[i], 1.0
            way[i] = _descent(grad[i], past[i])
    return {f: w[i] for f, i in number.items()}


def _descent(grad: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction from the last steps and gradient changes."""
    q, kept = grad.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def probe_scores(rows: DataFrame, weights: dict[tuple, np.ndarray], keys: list[str], keep: list[str], vec: str = "embedding") -> DataFrame:
    """The ``keep`` columns of every row with ``score``, the probability of class 1 under the fit that its keys name.

    Rows of keys without a fit are left out."""
    types = dict(rows.dtypes)
    order = sorted(weights)
    number, table = {f: i for i, f in enumerate(order)}, np.array([weights[f] for f in order])

    def run(batches):
        for pdf in batches:
            names = [number.get(tuple(x)) for x in pdf[keys].itertuples(index=False, name=None)]
            known = np.array([n is not None for n in names], bool)
            pdf, at = pdf[known], np.array([n for n in names if n is not None], int)
            x = np.array(pdf[vec].tolist(), float).reshape(len(pdf), -1)
            z = (x * table[at, :-1]).sum(1) + table[at, -1] if len(pdf) else np.zeros(0)
            yield pdf[keep].assign(score=1 / (1 + np.exp(-z)))

    return rows.select(*dict.fromkeys([*keys, *keep, vec])).mapInPandas(run, ", ".join([f"`{k}` {types[k]}" for k in keep] + ["score double"]))


def every_score(rows: DataFrame, weights: dict[tuple, np.ndarray], keys: list[str], by: str, keep: list[str], vec: str = "embedding") -> DataFrame:
    """The ``keep`` columns and ``score`` of every row under every fit whose ``by`` key is the row's; the other keys say which fit.

    A vector goes to Python once; only numbers are multiplied by the fits."""
    types, at = dict(rows.dtypes), keys.index(by)
    own: dict = {}
    for f in sorted(weights):
        own.setdefault(f[at], []).append(f)
    table = {k: np.array([weights[f] for f in fits]) for k, fits in own.items()}

    def run(batches):
        for pdf in batches:
            for value, part in pdf.groupby(by, sort=False):
                if value in table:
                    z = np.array(part[vec].tolist(), float) @ table[value][:, :-1].T + table[value][:, -1]
                    yield part[keep].assign(_s=(1 / (1 + np.exp(-z))).tolist())

    found = rows.select(*dict.fromkeys([by, *keep, vec])).mapInPandas(run, ", ".join([f"`{k}` {types[k]}" for k in keep] + ["_s array<double>"]))
    rest = [k for k in keys if k != by]
    named = [(k, i, *[x for j, x in enumerate(f) if j != at]) for k, fits in own.items() for i, f in enumerate(fits)]
    fits = rows.sparkSession.createDataFrame(named, f"`{by}` {types[by]}, _i int, " + ", ".join(f"`{k}` int" for k in rest))
    return found.select(*keep, F.posexplode("_s").alias("_i", "score")).join(fits, [by, "_i"]).drop("_i")


def probe_table(emb: DataFrame, labels: DataFrame, tasks: list[str], item: str = "slide_id") -> DataFrame:
    """Labelled embeddings of all tasks in one table: item, task, label and the embedding; -1 means missing."""
    long = labels.select(item, F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("int").alias("label")) for t in tasks])).alias("_t"))
    return emb.join(long.select(item, "_t.task", "_t.label").filter("label <> -1"), item)


def probe_grid(emb: DataFrame, labels: DataFrame, tasks: list[str], ks: list[int], folds: int, item: str = "slide_id", vec: str = "embedding",
               split: bool | None = None) -> DataFrame:
    """Mean and sd of the probes' AUC per task and k over folds; all fits share the rounds of one loop.

    A fold tests on the rows that it did not train on."""
    from celltable.operators.skew import stable
    data = stable(probe_table(emb, labels, tasks, item))
    keys = ["task", "k", "fold"]
    train = stable(k_shot_folds(data.select(item, "task", "label"), ks, folds, item=item).select(*keys, item, "label"))
    weights = fit_probes(train.join(data.drop("label"), [item, "task"]), keys, vec)
    if not weights:
        raise ValueError("no task has two classes")
    scored = every_score(data, weights, keys, "task", [item, "task", "label"], vec).join(train.select(*keys, item), [*keys, item], "left_anti")
    return repeat_summary(roc_auc(scored, "label", "score", keys, split), ["task", "k"], "auc")
