"""Mixing by iterative proportional fitting.

Token counts per cell (source, language, topic) are raked: each margin in turn is scaled to its target until all
margins hold.  A cell's weight is its raked share over its own share; documents are drawn with probabilities
proportional to their cell's weight, the largest being 1, so the expected token mix has the target margins.

Targets are shares of tokens per margin value.  Without given ones, a margin is tempered: share ** alpha, scaled to one.
Up to ``FEW_CELLS`` cells (counted first) are raked on the driver; more stay in a table, where a round is one
aggregation and one join per margin.  Both ways give the same shares.

The topic is the given column, else the table's own ``topic``; a table without one is mixed by form of text
(``form_topic``) instead, which balances no subjects.

Rules: NULL is a value of its own in every margin.  Target values without tokens are left out and the rest scaled up;
margin values without a target get none of the mix, so probability 0.  Documents without tokens take their cell's
probability.  A cell with no tokens at all has probability 1.  Draws hash the id, the text and the seed: repeated rows
fall together, and the sample is the same every time.  Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from celltable.llm.sampling import uniform
from celltable.llm.store import saved, with_own

MARGINS = ("source", "lang", "topic")
FEW_CELLS, TOLERANCE, MOST_ROUNDS = 100_000, 1e-9, 10_000
#: results blended into the next start; a fit has ceased to improve when its least error stays above this share; least share in logarithms
BLENDED, CEASED, LEAST = 6, 1 - 1e-6, 1e-300


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def form_topic(text: Column) -> Column:
    """A stand-in for tables without a topic column: the form of a text, not its subject."""
    size = F.coalesce(F.length(text), F.lit(0))
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (F.when(bars * 40 > size, "table").when(F.coalesce(text.rlike(r"(?s)[%&$#*]{3}"), F.lit(False)), "marked")
            .when(size < 500, "note").when(size < 3000, "article").otherwise("long"))


def tempered(cells: DataFrame, margin: str, alpha: float) -> DataFrame:
    """Target shares of one margin: (value, target), proportional to tokens ** alpha."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).filter("t > 0").select(margin, F.pow("t", F.lit(alpha)).alias("target"))
    return _to_one(own, margin)


def _to_one(target: DataFrame, margin: str) -> DataFrame:
    total = target.agg(F.sum("target").alias("all"))
    return target.join(F.broadcast(total)).select(margin, (F.col("target") / F.col("all")).alias("target"))  # one row


def blend_weights(products: np.ndarray) -> np.ndarray:
    """Weights that add up to one and make the weighted sum of the changes smallest, from the changes' scalar products."""
    n = len(products)
    step = np.eye(n)[:, 1:] - np.eye(n)[:, :-1]
    shares = np.linalg.lstsq(step.T @ products @ step, step.T @ products[:, -1], rcond=1e-13)[0]
    return np.eye(n)[-1] - step @ shares


def settle(turn: Callable[[int, dict[int, float], list[int]], tuple[float, np.ndarray]], tolerance: float, most_rounds: int) -> float:
    """Run rounds until the error is within the tolerance or has ceased to fall; the error left.

    ``turn(i, blend, kept)`` is round i: it starts from the blend of the results of earlier rounds (from the own shares if
    there is none) and returns the error and the scalar products of the changes of the rounds ``kept`` and of its own.
    A blend of logarithms is again own shares times a factor per margin value, so it has the same exact fit; where
    plain rounds take 1% off the error, blended ones get there in tens of rounds.  If they do not get there, plain
    rounds start afresh, so that contradictory margins end where plain rounds end."""
    left = math.inf
    for most_kept, patience in ((BLENDED, 30), (0, 100)):
        blend: dict[int, float] = {}
        kept: list[int] = []
        best: list[float] = []
        for i in range(most_rounds):
            left, products = turn(i, blend, kept)
            if left <= tolerance:
                return left
            if len(blend) > 1 and not left <= 2 * best[-1]:  # too far; also when not a number
                blend, kept = {kept[-1]: 1.0}, []
            elif most_kept:
                kept = [*kept, i][-most_kept:]
                blend = dict(zip(kept, blend_weights(products[-len(kept):, -len(kept):]), strict=True))
            else:
                blend = {i: 1.0}
            best.append(min([left, *best[-1:]]) if left == left else best[-1])
            if i >= patience and best[-1] >= CEASED * best[-1 - patience]:
                break
    return left


def rake_spread(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """``cells`` (margins and tokens) with ``raked``, the fitted token share, and the largest margin error left.

    Rounds go on until the error is within the tolerance.  Margins that contradict each other (a combination of values
    that never occurs) have no exact fit; then the rounds end once the error has not fallen for a hundred plain rounds,
    and the error is returned."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fit = saved(cells.withColumn("raked", F.col("tokens") / F.lit(float(max(total, 1)))))
    if not total:
        return fit, 0.0
    for m, t in targets.items():
        live = cells.filter("tokens > 0").select(F.col(m).alias("_v")).distinct()
        goal = _to_one(t.join(live, F.col(m).eqNullSafe(F.col("_v")), "left_semi"), m).select(F.col(m).alias("_v"), F.col("target").alias(f"_t_{m}"))
        fit = fit.join(goal, F.col(m).eqNullSafe(F.col("_v")), "left").drop("_v").fillna(0.0, [f"_t_{m}"])
    start = saved(fit)
    own, now = start.columns, start
    folder, numbers = f"{cells.sparkSession.conf.get('spark.checkpoint.dir')}/raking-{uuid.uuid4().hex}", itertools.count()

    def log(share: Column) -> Column:
        return F.ln(F.greatest(share, F.lit(LEAST)))

    def turn(i: int, blend: dict[int, float], kept: list[int]) -> tuple[float, np.ndarray]:
        nonlocal now
        step = now if blend else start
        if len(blend) > 1:
            mixed_log = sum((F.lit(float(w)) * F.col(f"_to{j}") for j, w in blend.items()), F.lit(0.0))
            step = step.withColumn("raked", F.when(F.col("raked") > 0, F.exp(mixed_log)).otherwise(0.0))
        elif blend and (j := next(iter(blend))) != i - 1:
            step = step.withColumn("raked", F.when(F.col("raked") > 0, F.exp(f"_to{j}")).otherwise(0.0))
        step = step.withColumn(f"_from{i}", log(F.col("raked")))
        for m in targets:
            sums = step.groupBy(F.col(m).alias("_k")).agg(F.sum("raked").alias(f"_s_{m}"))
            factor = F.when(F.col(f"_s_{m}") > 0, F.col(f"_t_{m}") / F.col(f"_s_{m}")).otherwise(0.0)
            step = step.join(sums, F.col(m).eqNullSafe(F.col("_k"))).drop("_k").withColumn("raked", F.col("raked") * factor)
        seen = [*kept, i]
        # written, not checkpointed: a checkpoint keeps what the planner inferred, which grows with every round
        path = f"{folder}/{next(numbers)}"
        step.withColumn(f"_to{i}", log(F.col("raked"))).write.parquet(path)
        step = cells.sparkSession.read.parquet(path)
        # the error that each margin had when its turn came
        gap = F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(f"_t_{m}") - F.col(f"_s_{m}"))) for m in targets])
        change = {j: F.when(F.col("raked") > 0, F.col(f"_to{j}") - F.col(f"_from{j}")).otherwise(0.0) for j in seen}
        pairs = [(a, b) for a in range(len(seen)) for b in range(a + 1)]
        found = step.agg(gap.alias("gap"), *[F.sum(change[seen[a]] * change[seen[b]]).alias(f"p{a}_{b}") for a, b in pairs]).first()
        now = step.select(*own, *[f"_{w}{j}" for j in seen for w in ("from", "to")])
        products = np.zeros((len(seen), len(seen)))
        for a, b in pairs:
            products[a, b] = products[b, a] = found[f"p{a}_{b}"]
        return found["gap"], products

    left = settle(turn, tolerance, most_rounds)
    return now.select(*cells.columns, "raked"), left


def rake_few(cells: DataFrame, targets: dict[str, DataFrame] | None, alpha: float, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """The same for a table whose size has been checked: its rounds need no jobs."""
    rows = cells.collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    own = raked = tokens / max(tokens.sum(), 1.0)
    code, goal = {}, {}
    for m in MARGINS if targets is None else targets:
        values = {v: i for i, v in enumerate(dict.fromkeys(r[m] for r in rows))}
        code[m] = np.array([values[r[m]] for r in rows], int)
        have = np.bincount(code[m], tokens, len(values))
        if targets is None:
            want = have**alpha * (have > 0)
        else:
            known = targets[m].join(F.broadcast(cells.select(F.col(m).alias("_v")).distinct()), F.col(m).eqNullSafe(F.col("_v")), "left_semi").collect()
            want = np.zeros(len(values))
            for r in known:
                want[values[r[m]]] = r["target"]
            want *= have > 0
        goal[m] = want / want.sum() if want.sum() else want
    done: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by round: logarithms before and after, shares after

    def turn(i: int, blend: dict[int, float], kept: list[int]) -> tuple[float, np.ndarray]:
        nonlocal raked
        if not blend:
            raked = own
        elif len(blend) == 1:
            raked = done[next(iter(blend))][2]
        else:
            with np.errstate(over="ignore"):
                raked = np.where(raked > 0, np.exp(sum(w * done[j][1] for j, w in blend.items())), 0.0)
        before, left = np.log(np.maximum(raked, LEAST)), 0.0
        with np.errstate(invalid="ignore"):
            for m, k in code.items():
                held = np.bincount(k, raked, len(goal[m]))
                left = max(float(np.abs(held - goal[m]).max()), left)
                raked = raked * np.divide(goal[m], held, out=np.zeros_like(held), where=held > 0)[k]
        for j in set(done) - set(kept):
            del done[j]
        done[i] = before, np.log(np.maximum(raked, LEAST)), raked
        change = np.array([np.where(raked > 0, done[j][1] - done[j][0], 0.0) for j in [*kept, i]])
        return left, change @ change.T

    left = settle(turn, tolerance, most_rounds) if tokens.sum() else 0.0
    out = [(*[r[m] for m in MARGINS], r["tokens"], float(x)) for r, x in zip(rows, raked, strict=True)]
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"{m} {kinds[m]}" for m in MARGINS], "tokens bigint", "raked double"])
    return cells.sparkSession.createDataFrame(out, schema), left


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = 0.7, few: int = FEW_CELLS) -> tuple[DataFrame, float]:
    """Fitted cells and the largest margin error left; a table of more than ``few`` cells stays spread."""
    if cells.count() <= few:
        return rake_few(cells, targets, alpha)
    return rake_spread(cells, targets or {m: tempered(cells, m, alpha) for m in MARGINS})


def probabilities(fit: DataFrame) -> DataFrame:
    """Cells with ``weight`` (raked share over own share) and ``chance`` (weight over the largest weight)."""
    totals = fit.agg(F.sum("tokens").alias("_all"))
    weighed = fit.join(F.broadcast(totals)).withColumn("weight", F.col("raked") * F.col("_all") / F.when(F.col("tokens") > 0, F.col("tokens")))
    top = weighed.agg(F.max("weight").alias("_top"))
    return weighed.join(F.broadcast(top)).withColumn("chance", F.when(F.col("tokens") > 0, F.col("weight") / F.col("_top")).otherwise(F.lit(1.0))).drop("_all", "_top")


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = 0.7, topic: Column | None = None, seed: int = 8, few: int = FEW_CELLS) -> DataFrame:
    """Every document as ``own`` (a struct of its columns) with doc_id, source, lang, ``topic``, ``n_tokens``,
    ``weight``, ``chance`` and ``sampled``, and ``margin_error``: how far the expected mix stays off a target at most.

    Targets that the cells cannot meet also give a warning."""
    if topic is None:
        topic = F.col("topic") if "topic" in docs.columns else form_topic(F.col("text"))
    rows = with_own(docs.withColumn("_topic", topic), "doc_id", "source", "lang", "text", "_topic").withColumnRenamed("_topic", "topic")
    rows = rows.withColumn("own", F.col("own").dropFields("_topic")).withColumn("n_tokens", n_tokens(F.col("text")))
    cells = saved(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    fit, left = rake(cells, targets, alpha, few)
    if left > TOLERANCE:
        warnings.warn(f"the mix stays up to {left:.3g} off its target margins", stacklevel=2)
    chances = saved(probabilities(fit).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "chance"))
    if chances.count() <= few:
        chances = F.broadcast(chances)
    match = F.lit(True)
    for m in MARGINS:
        match = match & F.col(m).eqNullSafe(F.col(f"_{m}"))
    out = rows.join(chances, match, "left").drop(*[f"_{m}" for m in MARGINS])
    return out.withColumn("sampled", uniform(F.col("doc_id"), F.col("text"), seed) < F.col("chance")).withColumn("margin_error", F.lit(left)).drop("text")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = 0.7) -> DataFrame:
    """The sampled documents with their own columns."""
    return mixed(docs, targets, alpha).filter("sampled").select("own.*")
