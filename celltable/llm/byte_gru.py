"""Language identification by a bidirectional gated recurrent network over bytes.

One small recurrent layer reads the bytes forwards, another backwards; a linear layer on both states labels every
position, and a document's probabilities are the mean over its positions.  Gates use clipped linear functions.  The
network is fitted on the driver by backpropagation through time on windows of a bounded sample of labelled rows.

``FitLimits`` are the bounds of the sample: rows per language and characters of the window taken from each, at a place
picked by a hash of the text.  Labelling reads every byte of every text, in stretches of ``STRETCH`` bytes that each
start from a zero state, many stretches side by side.

Rules: NULL texts and texts without a letter are ``und`` with score 0.  Rows without a language are not learnt from.
With no labelled rows every text is ``und``; with one language every other text gets it.  Repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from celltable.llm.sampling import GRAIN, balanced
from celltable.llm.words import pieces, text_bytes

HIDDEN, STRETCH, LANES = 8, 128, 4096
UNKNOWN = "und"
FIELDS = ("emb", "u", "b", "v")


@dataclass(frozen=True)
class FitLimits:
    rows_per_language: int = 1500
    window_chars: int = 160


def _gates(a: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * a + 0.5, 0, 1)


@dataclass
class ByteGru:
    """Per direction: input table (3H x 256), recurrent weights (3H x H), candidate bias (H), read-out (K x H).

    Rows of the stacked weights: update gate, reset gate, candidate."""

    names: list[str]
    emb: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: list[np.ndarray]
    c: np.ndarray

    @classmethod
    def new(cls, names: list[str], rng: np.random.Generator) -> ByteGru:
        f, k = np.float32, len(names)
        return cls(names, [rng.normal(0, 0.5, (3 * HIDDEN, 256)).astype(f) for _ in range(2)],
                   [rng.normal(0, 0.4, (3 * HIDDEN, HIDDEN)).astype(f) for _ in range(2)], [np.zeros((HIDDEN, 1), f) for _ in range(2)],
                   [rng.normal(0, 0.5, (k, HIDDEN)).astype(f) for _ in range(2)], np.zeros((k, 1), f))

    def params(self) -> list[np.ndarray]:
        return [*self.emb, *self.u, *self.b, *self.v, self.c]

    def ready(self) -> list[tuple]:
        """Weights with the gates' slope and offset folded in."""
        out = []
        for e, u, b, v in zip(self.emb, self.u, self.b, self.v, strict=True):
            e, u = e.copy(), u.copy()
            e[:2 * HIDDEN] = 0.25 * e[:2 * HIDDEN] + 0.5
            u[:2 * HIDDEN] *= 0.25
            out.append((e, u, b, v))
        return out


def label_positions(net: ByteGru, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probabilities (positions x languages x lanes) of stretches x (positions x lanes), longest lane first.

    A lane of fewer bytes joins only for its own positions; the places behind it stay zero."""
    steps, lanes = x.shape
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes with more than t bytes
    logits = np.zeros((steps, len(net.names), lanes), np.float32)
    for backward, (e, u, b, v) in enumerate(net.ready()):
        h = np.zeros((HIDDEN, lanes), np.float32)
        for t in (range(steps - 1, -1, -1) if backward else range(steps)):
            n = live[t]
            a = np.take(e, x[t, :n], axis=1)
            own = h[:, :n]
            g = u @ own
            gate = a[:2 * HIDDEN]
            gate += g[:2 * HIDDEN]
            np.clip(gate, 0, 1, out=gate)
            cand = g[2 * HIDDEN:]
            cand += b
            cand *= gate[HIDDEN:]
            cand += a[2 * HIDDEN:]
            np.clip(cand, -1, 1, out=cand)
            own -= cand
            own *= gate[:HIDDEN]
            own += cand
            logits[t, :, :n] += v @ own
    logits += net.c
    np.subtract(logits, logits.max(axis=1, keepdims=True), out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    logits *= (np.arange(steps)[:, None] < size)[:, None, :]
    return logits


def document_probabilities(net: ByteGru, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean position probabilities of every row (rows x languages); rows without bytes are zero."""
    n = np.diff(off)
    count = -(-n // STRETCH)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][row] + nth * STRETCH
    size = np.minimum(STRETCH, off[1:][row] - start)
    order = np.argsort(-size, kind="stable")
    total = np.zeros((len(n), len(net.names)))
    padded = np.concatenate([data, np.zeros(STRETCH, np.uint8)])
    for lo in range(0, len(order), LANES):
        lane = order[lo:lo + LANES]
        steps = int(size[lane[0]])
        x = padded[start[lane] + np.arange(steps)[:, None]].astype(np.intp)
        p = label_positions(net, x, size[lane]).sum(axis=0, dtype=np.float64)
        for k in range(len(net.names)):
            total[:, k] += np.bincount(row[lane], p[k], len(n))
    return total / np.maximum(n, 1)[:, None]


def _loss_gradients(net: ByteGru, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy of every position's label and its gradients, by backpropagation through time."""
    steps, lanes = x.shape
    trace = []
    logits = np.zeros((steps, len(net.names), lanes), np.float32) + net.c
    for backward in range(2):
        h, states = np.zeros((HIDDEN, lanes), np.float32), {}
        for t in (range(steps - 1, -1, -1) if backward else range(steps)):
            a, g = net.emb[backward][:, x[t]], net.u[backward] @ h
            pre = a[:2 * HIDDEN] + g[:2 * HIDDEN]
            gate = _gates(pre)
            inner = g[2 * HIDDEN:] + net.b[backward]
            pre_c = a[2 * HIDDEN:] + gate[HIDDEN:] * inner
            cand = np.clip(pre_c, -1, 1)
            new = cand + gate[:HIDDEN] * (h - cand)
            states[t] = (h, gate, np.abs(pre) < 2, inner, cand, np.abs(pre_c) < 1, new)
            h = new
            logits[t] += net.v[backward] @ h
        trace.append(states)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    pick = np.arange(lanes)
    loss = float(-np.log(p[:, y, pick] + 1e-9).mean())
    p[:, y, pick] -= 1
    p /= steps * lanes
    grads = {k: [] for k in FIELDS}
    for backward, states in enumerate(trace):
        d_emb, d_u = np.zeros_like(net.emb[backward]), np.zeros_like(net.u[backward])
        d_b, d_v = np.zeros_like(net.b[backward]), np.zeros_like(net.v[backward])
        d_h = np.zeros((HIDDEN, lanes), np.float32)
        for t in (range(steps) if backward else range(steps - 1, -1, -1)):
            h, gate, gate_open, inner, cand, cand_open, new = states[t]
            d_v += p[t] @ new.T
            d_h = d_h + net.v[backward].T @ p[t]
            z = gate[:HIDDEN]
            d_pre_c = d_h * (1 - z) * cand_open
            d_inner = d_pre_c * gate[HIDDEN:]
            d_gate = np.concatenate([d_h * (h - cand), d_pre_c * inner]) * gate_open * np.float32(0.25)
            d_g = np.concatenate([d_gate, d_inner])
            d_a = np.concatenate([d_gate, d_pre_c])
            d_u += d_g @ h.T
            d_b += d_inner.sum(axis=1, keepdims=True)
            for j in range(3 * HIDDEN):
                d_emb[j] += np.bincount(x[t], d_a[j], 256)
            d_h = d_h * z + net.u[backward].T @ d_g
        for k, g in zip(FIELDS, (d_emb, d_u, d_b, d_v), strict=True):
            grads[k].append(g)
    return loss, [*grads["emb"], *grads["u"], *grads["b"], *grads["v"], p.sum(axis=(0, 2))[:, None]]


def fit_network(texts: list[bytes], labels: np.ndarray, names: list[str], steps: int = 300, lanes: int = 192, length: int = 48, seed: int = 3) -> ByteGru:
    """Adam on random windows, languages in equal parts."""
    rng = np.random.default_rng(seed)
    net = ByteGru.new(names, rng)
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    own = [[t for t, y in zip(texts, labels, strict=True) if y == k and len(t) >= length] or
           [t * (length // max(1, len(t)) + 1) for t, y in zip(texts, labels, strict=True) if y == k and t] or [b" " * length] for k in range(len(names))]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), lanes)
        x = np.empty((length, lanes), np.intp)
        for i, k in enumerate(y):
            text = own[k][rng.integers(len(own[k]))]
            at = rng.integers(0, len(text) - length + 1)
            x[:, i] = np.frombuffer(text, np.uint8, length, at)
        _, grads = _loss_gradients(net, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g * np.float32(min(1, 1 / (norm + 1e-9)))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= np.float32(rate) * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return net


def fit(docs: DataFrame, learn_from: Column, limits: FitLimits = FitLimits(), seed: int = 3) -> ByteGru | None:
    """The network from the labelled rows for which ``learn_from`` holds; None without any."""
    rows = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    room = F.greatest(F.length("text") - limits.window_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("text", F.lit(seed)), room) + 1
    sample, _ = balanced(rows.select("doc_id", "lang", F.substring("text", start.cast("int"), F.lit(limits.window_chars)).alias("part")),
                         "lang", limits.rows_per_language, F.col("doc_id"), seed)
    got = sample.select("lang", "part", F.col("doc_id").cast("string").alias("doc_id")).toArrow().sort_by([("doc_id", "ascending"), ("part", "ascending")])
    if not len(got):
        return None
    lang = got["lang"].to_pylist()
    names = sorted(set(lang))
    return fit_network([x.encode() for x in got["part"].to_pylist()], np.array([names.index(x) for x in lang]), names, seed=seed)


def with_language(docs: DataFrame, net: ByteGru | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``probabilities`` (by language name) of every whole text."""
    df = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"), F.col(text_col).rlike(r"\p{L}").alias("_lettered"))
    own = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*own, T.StructField("_p", T.ArrayType(T.DoubleType()))])
    names = net.names if net else []

    def run(batches):
        for b in batches:
            data, off = text_bytes(b["_text"])
            for lo, hi in pieces(off):
                p = document_probabilities(net, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) if net else np.zeros((hi - lo, 0))
                part = b.slice(lo, hi - lo)
                said = part["_lettered"].fill_null(False).to_pylist()
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array([r if s else None for r, s in zip(p.tolist(), said, strict=True)], pa.list_(pa.float64()))], [*keep, "_p"])

    found = df.mapInArrow(run, schema)
    top = F.array_max("_p")
    if not names:
        return found.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,double>").alias("probabilities"))
    known = F.array(*[F.lit(x) for x in names])
    return found.select(*keep, F.when(F.col("_p").isNull(), UNKNOWN).otherwise(F.element_at(known, F.array_position("_p", top).cast("int"))).alias("lang_pred"),
                        F.least(F.coalesce(top, F.lit(0.0)), F.lit(1.0)).alias("score"),
                        F.when(F.col("_p").isNotNull(), F.map_from_arrays(known, F.col("_p"))).alias("probabilities"))
