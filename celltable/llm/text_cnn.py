"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to buckets with an embedding each, and so are their first 5 and 7 bytes, which inflected forms share;
a word's vector is the sum of the three.  Filters of several widths slide over the text, their largest
response anywhere in the text is kept, and a logistic unit reads those maxima.  The network is fitted with Adam on a
bounded sample of labelled rows, in one task.

The scale of the scores and the thresholds come from all labelled rows that may be learnt from, texts of any size
included: Spark scores them and counts them in histograms by language, label and score.  No row is judged by a network
fitted on it: rows of the sample are scored by networks fitted on the other folds of the sample, a task each.  A language with
``least`` rows of each label gets the cut with the largest F1 on its own rows, all others the cut of all rows together.  A cut lies
above the score of a text without known words: nothing is rejected without evidence.

``FitLimits`` are the bounds of the sample: rows per label, and the size up to which a document is used for fitting.
Scoring reads whole texts of any size.

Rules: words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z.  NULL and empty texts get the score
of a text without known words.  Rows without labels are not learnt from; without any labelled rows, or with one label
only, every score is the share of label 1 (0.5 without rows) and nothing is flagged.  Repeated rows count each.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from celltable.llm.sampling import balanced
from celltable.llm.store import quoted, saved, spread
from celltable.llm.words import byte_classes, lower_table, pieces, prefixes, split_words, text_bytes

BUCKET_BITS, DIM, FILTERS, WIDTHS = 16, 8, 8, (1, 2, 3)
PREFIXES = (5, 7)
VIEWS = 1 + len(PREFIXES)
PAD = max(WIDTHS) - 1
FOLDS = 3
BINS = 64  # histogram bins for each unit of the logit
WIDEST = 40.0


@dataclass(frozen=True)
class FitLimits:
    rows_per_label: int = 3000
    document_bytes: int = 1 << 16


def bucket_ids(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word and of its beginnings, first word of every row)."""
    words = split_words(data, off, byte_classes("alnum"), lower_table())
    views = [words.hash, *[prefixes(data, words, size, lower_table()) for size in PREFIXES]]
    return np.stack([(v >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16) for v in views], axis=1), words.first


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with empty words behind each, and where the windows of a row start and end.

    The last windows of a row begin at its first PAD empty words; as many more stand behind, so that none reads the
    next row and empty rows have windows too."""
    n = np.diff(first)
    start = first[:-1] - first[0] + 2 * PAD * np.arange(len(n))
    out = np.zeros((int(first[-1] - first[0]) + 2 * PAD * len(n), VIEWS), np.int32)
    out[np.arange(len(ids)) + 2 * PAD * np.repeat(np.arange(len(n)), n)] = ids
    return out, start, start + n + PAD


def largest(responses: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest response of every filter in the windows of each row."""
    return np.maximum.reduceat(responses, np.stack([start, end], axis=1).reshape(-1), axis=0)[::2]


@dataclass
class TextCnn:
    """``row_of`` maps a bucket to its embedding; buckets in too few documents share the zero row 0."""

    row_of: np.ndarray
    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    base: float | None = None

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter responses at every place: places x (widths * filters)."""
        x = self.emb[ids[:, 0]]
        for v in range(1, VIEWS):
            x += self.emb[ids[:, v]]
        x = np.concatenate([x, np.zeros((PAD, DIM), x.dtype)])
        n = len(ids)
        parts = []
        for w, k, b in zip(WIDTHS, self.conv, self.bias, strict=True):
            r = x[:n] @ k[:DIM]
            for j in range(1, w):
                r += x[j:j + n] @ k[j * DIM:(j + 1) * DIM]
            parts.append(np.maximum(r + b, 0))
        return np.concatenate(parts, axis=1)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Output of the network, before it is set on the scale of the labelled rows."""
        if self.base is not None or len(first) < 2:
            return np.zeros(len(first) - 1)
        laid, start, end = padded(self.row_of[ids], first)
        pooled = largest(self.responses(laid), start, end)
        return np.clip((pooled @ self.out + self.out_bias[0]).astype(np.float64), -WIDEST, WIDEST)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(first) - 1, self.base)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, first) + self.shift, -WIDEST, WIDEST)))

    def score_of(self, logit: Column) -> Column:
        """``scores`` for a column of logits."""
        if self.base is not None:
            return F.lit(float(self.base))
        z = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), logit * self.scale + self.shift))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit_network(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01,
                min_share: float = 0.003, decay: float = 1e-4, seed: int = 7) -> TextCnn:
    """Gradient descent on cross-entropy; the gradient flows through the place of each maximum."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(1 << BUCKET_BITS, np.int64)  # documents that hold a bucket
    for d in docs:
        seen[np.unique(d)] += 1
    known = np.flatnonzero(seen >= max(3, min_share * len(docs)))
    row_of = np.zeros(1 << BUCKET_BITS, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    f = np.float32
    emb = rng.normal(0, 0.3, (len(known) + 1, DIM)).astype(f)
    emb[0] = 0
    conv = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(f) for w in WIDTHS]
    bias = [np.zeros(FILTERS, f) for _ in WIDTHS]
    out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f)
    net = TextCnn(row_of, emb, conv, bias, out, np.zeros(1, f))
    dense = [emb, *conv, *bias, out, net.out_bias]
    adam = _Adam(dense, rate)
    # some empty texts with the share of label 1 as their target, so that text without known words is no evidence either way
    rows = [row_of[d] for d in docs] + [np.zeros((0, VIEWS), np.int32)] * (1 + len(docs) // 50)
    labels = np.concatenate([labels, np.full(len(rows) - len(docs), labels.mean())]).astype(f)
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in pick])])
            laid, start, end = padded(np.concatenate([rows[i] for i in pick]), first)
            r = net.responses(laid)
            place = np.stack([s + r[s:e].argmax(axis=0) for s, e in zip(start, end, strict=True)])
            pooled = np.take_along_axis(r, place, axis=0)
            drop = (rng.random(pooled.shape) > 0.2).astype(f) / f(0.8)
            logit = (pooled * drop) @ net.out + net.out_bias[0]
            err = ((1 / (1 + np.exp(-logit)) - labels[pick]) / len(pick)).astype(f)
            g_pool = np.outer(err, net.out) * drop * (pooled > 0)
            g_emb = np.zeros_like(emb)
            g_conv, g_bias = [], []
            long = np.concatenate([laid, np.zeros((PAD, VIEWS), laid.dtype)])
            for i, w in enumerate(WIDTHS):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                at, g = place[:, part], g_pool[:, part]
                ids = np.stack([long[at + j] for j in range(w)], axis=2)
                x = emb[ids].sum(axis=3).reshape(*at.shape, w * DIM)
                g_conv.append(np.einsum("df,dfx->xf", g, x).astype(f) + decay * conv[i])
                g_bias.append(g.sum(axis=0))
                back = (g[:, :, None] * conv[i].T[None]).reshape(-1, DIM)
                for v in range(VIEWS):
                    np.add.at(g_emb, ids[..., v].reshape(-1), back)
            g_emb[0] = 0
            adam.step([g_emb, *g_conv, *g_bias, ((pooled * drop).T @ err).astype(f) + f(decay) * out, np.array([err.sum()], f)])
            emb[0] = 0
    return net


def _platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with row weights, by Newton steps with a small ridge."""
    a = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * (a - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a[0], 1e-3)), float(a[1])


@dataclass
class Fitted:
    """A network and the logits of its own sample rows, by networks of other folds."""

    net: TextCnn
    ids: list[str]
    unseen: np.ndarray


def _fold(doc_id: str, seed: int) -> int:
    return zlib.crc32(f"{seed}:{doc_id}".encode()) % FOLDS


def fit_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, limits: FitLimits = FitLimits(), seed: int = 7) -> Fitted:
    """The network of a bounded sample of the labelled rows for which ``learn_from`` holds."""
    sample, _ = balanced(_usable(labels, learn_from), "toxic", limits.rows_per_label, F.col("doc_id"), seed)
    # the sample has at most 4 x rows_per_label narrow rows, whatever the size of the tables
    texts = (docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= limits.document_bytes)
             .join(F.broadcast(sample), "doc_id"))

    def to_ids(batches):
        for b in batches:
            ids, first = bucket_ids(*text_bytes(b["text"]))
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([ids[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                "toxic": b["toxic"].cast(pa.int32()), "doc_id": b["doc_id"].cast(pa.string())})

    got = texts.select("text", "toxic", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(to_ids, "ids binary, toxic int, doc_id string").toArrow().sort_by("doc_id")
    y = got["toxic"].to_numpy().astype(np.float32)
    if len(set(y)) < 2:
        net = TextCnn(np.zeros(1 << BUCKET_BITS, np.int32), np.zeros((1, DIM), np.float32), [], [], np.zeros(0), np.zeros(1))
        net.base, net.threshold = (float(y[0]) if len(y) else 0.5), 2.0
        return Fitted(net, [], np.zeros(0))
    ids = [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, VIEWS) for x in got["ids"]]
    names = got["doc_id"].to_pylist()
    fold = np.array([_fold(n, seed) for n in names])

    def run(batches):
        for b in batches:
            for k in b["id"].to_pylist():
                net, logits = _fit_without(ids, y, fold, k, seed)
                yield pa.RecordBatch.from_pydict({"fold": [k], "net": [pickle.dumps(net)], "logits": [logits.tolist()]})

    # the sample is bounded, so is each fit; they run side by side, one task each
    fits = docs.sparkSession.range(-1, FOLDS, numPartitions=FOLDS + 1).mapInArrow(run, "fold bigint, net binary, logits array<double>")
    net, unseen = None, np.zeros(len(y))
    for r in fits.toArrow().to_pylist():
        if r["fold"] < 0:
            net = pickle.loads(r["net"])
        else:
            unseen[fold == r["fold"]] = r["logits"]
    return Fitted(net, names, unseen)


def _fit_without(ids: list[np.ndarray], y: np.ndarray, fold: np.ndarray, k: int, seed: int) -> tuple[TextCnn, np.ndarray]:
    """The network of all rows but those of fold ``k``, and its logits of these; -1 is no row's fold.

    With one label only in the other folds there is nothing to fit on; the whole sample's network must do."""
    mine, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
    rest = rest if len(set(y[rest])) == 2 else np.arange(len(y))
    net = fit_network([ids[i] for i in rest], y[rest], seed=seed)
    first = np.concatenate([[0], np.cumsum([len(ids[i]) for i in mine])]).astype(np.int64)
    return net, net.logits(np.concatenate([np.zeros((0, VIEWS), np.uint16), *[ids[i] for i in mine]]), first)


def _usable(labels: DataFrame, learn_from: Column) -> DataFrame:
    return labels.filter(learn_from & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")


def calibrate(fitted: Fitted, scored: DataFrame, labels: DataFrame, learn_from: Column, least: int = 20) -> TextCnn:
    """The network with its scale and thresholds, from all labelled rows of ``scored`` (doc_id, lang, logit)."""
    net = fitted.net
    if net.base is not None:
        return net
    spark = scored.sparkSession
    own: dict[str, list[float]] = {}
    for n, x in zip(fitted.ids, fitted.unseen.tolist(), strict=True):
        own.setdefault(n, []).append(x)
    # as many rows as the sample has, hence the same bound
    unseen = spark.createDataFrame([(n, sum(x) / len(x)) for n, x in own.items()], "_id string, _unseen double")
    rows = scored.join(spread(_usable(labels, learn_from)), "doc_id").join(F.broadcast(unseen), F.col("doc_id").cast("string") == F.col("_id"), "left")
    hist = saved(rows.groupBy("lang", F.floor(F.coalesce("_unseen", "logit") * BINS).alias("bin")).agg(
        F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("good")))
    common = hist.groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("bin").toPandas()
    at = (common["bin"].to_numpy() + 0.5) / BINS
    n = len(at)
    net.scale, net.shift = _platt(np.concatenate([at, at]), np.repeat([1.0, 0.0], n),
                                  np.concatenate([common["bad"].to_numpy(), common["good"].to_numpy()]))
    blank = float(np.nextafter(net.scores(np.zeros((0, VIEWS), np.uint16), np.zeros(2, np.int64))[0], 1))

    def cut(t: float) -> float:
        return max(blank, float(1 / (1 + np.exp(-np.clip(net.scale * t + net.shift, -WIDEST, WIDEST)))))

    net.threshold = cut(best_cuts(hist.withColumn("lang", F.lit("")), least=1).first()["cut"])
    net.thresholds = {r["lang"]: cut(r["cut"]) for r in best_cuts(hist.filter(F.col("lang").isNotNull()), least).collect()}
    return net


def best_cuts(hist: DataFrame, least: int) -> DataFrame:
    """lang, cut: the logit with the largest F1 of each language that has ``least`` rows of each label.

    A cut lies midway between the lowest bin above it and the next bin in use; of equal ones the highest counts."""
    bins = hist.groupBy("lang", "bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    whole = Window.partitionBy("lang")  # at most 2 * WIDEST * BINS + 1 rows for each language
    down = whole.orderBy(F.desc("bin"))
    hit, taken = F.sum("bad").over(down), F.sum(F.col("bad") + F.col("good")).over(down)
    below = F.coalesce(F.lead("bin").over(down) + 1, F.col("bin"))
    f1 = bins.select("lang", F.sum("bad").over(whole).alias("all_bad"), F.sum("good").over(whole).alias("all_good"),
                     (hit * 2.0 / (taken + F.sum("bad").over(whole))).alias("f1"), "bin", ((F.col("bin") + below) / (2.0 * BINS)).alias("cut"))
    return (f1.filter((F.col("all_bad") >= least) & (F.col("all_good") >= least)).groupBy("lang")
            .agg(F.max(F.struct("f1", "bin", "cut"))["cut"].alias("cut")))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, limits: FitLimits = FitLimits(), least: int = 20, seed: int = 7) -> TextCnn:
    """Network, scale and thresholds from the labelled rows for which ``learn_from`` holds."""
    fitted = fit_sample(docs, labels, learn_from, limits, seed)
    return calibrate(fitted, with_logit(docs, fitted.net, ["doc_id", "lang"]), labels, learn_from, least)


def scored_with(docs: DataFrame, labels: DataFrame, learn_from: Column, keep: list[str], limits: FitLimits = FitLimits(), least: int = 20,
                seed: int = 7) -> tuple[DataFrame, TextCnn]:
    """The ``keep`` columns (with doc_id and lang), score and threshold of every text; texts are read by the network once."""
    fitted = fit_sample(docs, labels, learn_from, limits, seed)
    scored = saved(with_logit(docs, fitted.net, keep))
    net = calibrate(fitted, scored.select("doc_id", "lang", "logit"), labels, learn_from, least)
    return scored.select(*keep, net.score_of(F.col("logit")).alias("score"), threshold_of(net, F.col("lang")).alias("threshold")), net


def _read(docs: DataFrame, keep: list[str], text_col: str, out: str, judge) -> DataFrame:
    # a text that is kept travels once
    text = text_col if text_col in keep else "_text"
    df = docs.select(*[F.col(c) for c in keep], *([] if text in keep else [F.col(text_col).alias(text)]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        for b in batches:
            data, off = text_bytes(b[text])
            for lo, hi in pieces(off, 1 << 20):
                ids, first = bucket_ids(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array(judge(ids, first), pa.float64())], [*keep, out])

    return df.mapInArrow(run, schema)


def with_score(docs: DataFrame, net: TextCnn, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The ``keep`` columns and the toxicity score of every whole text."""
    return _read(docs, keep, text_col, out, net.scores)


def with_logit(docs: DataFrame, net: TextCnn, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and the raw ``logit`` of every whole text."""
    return _read(docs, keep, text_col, "logit", net.logits)


def threshold_of(net: TextCnn, lang: Column) -> Column:
    """The threshold of a language, or the common one."""
    out = F.lit(net.threshold)
    for name, t in net.thresholds.items():
        out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out


def without_toxic(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """The documents, with their own columns, whose score is below the threshold of their language."""
    rest = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*rest).alias("own"), "doc_id", "text", "lang")
    scored, _ = scored_with(own, labels, learn_from, ["own", "doc_id", "lang", "text"])
    return scored.filter(F.col("score") < F.col("threshold")).select(*[F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])
