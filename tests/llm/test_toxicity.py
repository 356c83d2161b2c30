"""Thresholds by language, the network's forward pass and the cut of a histogram, against plain loops."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from celltable.llm import text_cnn
from celltable.llm.words import text_bytes


def test_forward_pass_is_the_plain_sum():
    texts = ["alpha beta alphabet", "", None, "gamma", "beta gamma, alpha! delta epsilon zeta"] * 5
    ids, first = text_cnn.bucket_ids(*text_bytes(pa.array(texts)))
    docs = [ids[a:z] for a, z in zip(first[:-1], first[1:])]
    net = text_cnn.fit_network(docs, np.array([i % 2 for i in range(len(docs))], np.float32), epochs=2, min_share=0.0)
    net.scale, net.shift = 1.7, -0.3
    got = net.scores(ids, first)
    for d, mine in zip(docs, got, strict=True):
        words = [sum(net.emb[net.row_of[b]] for b in w) for w in d] + [np.zeros(text_cnn.DIM)] * text_cnn.PAD
        pooled = []
        for w, k, b in zip(text_cnn.WIDTHS, net.conv, net.bias):
            for f in range(text_cnn.FILTERS):
                at = []
                for i in range(len(words)):
                    span = [words[i + j] if i + j < len(words) else np.zeros(text_cnn.DIM) for j in range(w)]
                    at.append(max(0.0, float(np.concatenate(span) @ k[:, f] + b[f])))
                pooled.append(max(at))
        logit = float(np.array(pooled) @ net.out + net.out_bias[0])
        assert abs(mine - 1 / (1 + np.exp(-(1.7 * logit - 0.3)))) < 1e-4


def test_cuts_equal_a_plain_search(spark):
    r = random.Random(5)
    hist = [(lang, b, float(r.randrange(6)), float(r.randrange(9))) for lang in ("a", "b", "c") for b in r.sample(range(-40, 40), 25)]
    hist += [("few", 3, 1.0, 50.0)]
    got = {x["lang"]: x["cut"] for x in text_cnn.best_cuts(spark.createDataFrame(hist, "lang string, bin bigint, bad double, good double"), 20).collect()}
    assert set(got) == {"a", "b", "c"}
    for lang in got:
        rows = sorted((h for h in hist if h[0] == lang), key=lambda h: -h[1])
        total, hit, taken, best = sum(h[2] for h in rows), 0.0, 0.0, None
        for i, h in enumerate(rows):
            hit, taken = hit + h[2], taken + h[2] + h[3]
            below = rows[i + 1][1] + 1 if i + 1 < len(rows) else h[1]
            value = (2 * hit / (taken + total), h[1], (h[1] + below) / (2 * text_cnn.BINS))
            best = value if best is None or value > best else best
        assert abs(got[lang] - best[2]) < 1e-12


def test_a_rare_language_has_its_own_threshold(spark):
    """2% of the rows, whose toxic word also stands in clean rows of the common language; the sample holds few of them."""
    r = random.Random(9)
    rows, labels = [], []
    for i in range(6000):
        lang = "xx" if i % 50 == 0 else "en"
        bad = (i // 50) % 2 == 0 if lang == "xx" else i % 7 == 0
        words = [f"w{r.randrange(300)}" for _ in range(20)] + (["vile" if lang == "en" else "skarn"] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(bad)))
    rows.append((6000, "vile " * 40_000, "en"))  # beyond the size of the sample's documents, yet counted
    labels.append((6000, 1))
    docs, lab = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    limits = text_cnn.FitLimits(rows_per_label=600)
    scored, net = text_cnn.scored_with(docs, lab, F.lit(True), ["doc_id", "lang"], limits)
    assert set(net.thresholds) == {"en", "xx"}
    bad = {i for i, t in labels if t}
    got = scored.collect()
    assert len(got) == len(rows) and {x["doc_id"] for x in got} == {x[0] for x in rows}
    for lang in ("en", "xx"):
        mine = [x for x in got if x["lang"] == lang]
        assert sum((x["score"] >= x["threshold"]) == (x["doc_id"] in bad) for x in mine) > 0.95 * len(mine)
    same = {x["doc_id"]: x["score"] for x in text_cnn.with_score(docs, net, ["doc_id"]).collect()}
    assert all(abs(same[x["doc_id"]] - x["score"]) < 1e-9 for x in got)


def test_a_kept_text_travels_once(spark, edge):
    net = text_cnn.TextCnn(np.zeros(1 << text_cnn.BUCKET_BITS, np.int32), np.zeros((1, text_cnn.DIM), np.float32), [], [], np.zeros(0), np.zeros(1), base=0.5)
    sent = text_cnn.with_logit(edge.select("doc_id", "text"), net, ["doc_id", "text"])
    assert sent.columns == ["doc_id", "text", "logit"] and "AS _text" not in sent._jdf.queryExecution().optimizedPlan().toString()
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    kept = text_cnn.without_toxic(edge, labels, F.lit(True))
    assert kept.schema == edge.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, edge.collect()))
