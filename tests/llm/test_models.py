"""Fitted operators: gradients, closed forms, brute force and held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from celltable.llm import byte_gru, kneser_ney, raking, text_cnn
from celltable.llm.jaccard_join import jaccard_groups

from .conftest import SCHEMA, document

WORDS = {"en": "the cat with that this house", "de": "der und nicht haus straße mit", "fr": "le été près maison garçon avec"}


def corpus(n, seed=0, bad=()):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        w = list(r.choice(WORDS[lang].split(), 30)) + [f"x{r.integers(1000)}"]
        if i in bad:
            w[int(r.integers(30))] = "vile"
        out.append(document(i, " ".join(map(str, w)), lang, f"s{i % 5}"))
    return out


def test_gru_gradients_and_labels():
    rng = np.random.default_rng(0)
    net = byte_gru.ByteGru.new(["a", "b", "c"], rng)
    x, y = rng.integers(97, 110, (6, 5)), rng.integers(0, 3, 5)
    _, grads = byte_gru._loss_gradients(net, x, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], np.float32(1e-2)
        p[at] = old + step
        up = byte_gru._loss_gradients(net, x, y)[0]
        p[at] = old - step
        down = byte_gru._loss_gradients(net, x, y)[0]
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 1e-4
    # stretches of different sizes do not disturb each other
    data, off = rng.integers(97, 110, 700).astype(np.uint8), np.array([0, 300, 300, 305, 700])
    p = byte_gru.document_probabilities(net, data, off)
    alone = byte_gru.document_probabilities(net, data[305:], np.array([0, 395]))
    assert np.allclose(p[3], alone[0], atol=1e-5) and np.allclose(p.sum(axis=1), [1, 0, 1, 1], atol=1e-5)


def test_language(spark, edge, empty):
    df = edge.union(spark.createDataFrame(corpus(240), SCHEMA))
    net = byte_gru.fit(df, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = byte_gru.with_language(df, net, ["doc_id", "lang", "text"]).collect()
    assert len(got) == df.count()
    assert all((r.lang_pred == "und") == (r.text is None or not re.search(r"[^\W\d_]", r.text)) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.text and " x" in r.text]
    assert sum(r.lang_pred == r.lang for r in held) > 0.95 * len(held)
    none = byte_gru.fit(empty, F.lit(True))
    assert none is None and {r.lang_pred for r in byte_gru.with_language(edge, none, ["doc_id"]).collect()} == {"und"}
    assert byte_gru.with_language(empty, net, ["doc_id"]).count() == 0


def test_toxicity(spark, edge, empty):
    bad = set(range(0, 600, 4))
    df = edge.union(spark.createDataFrame(corpus(600, bad=bad), SCHEMA)).withColumn("own", F.lit(1))
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(20, 600)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    net = text_cnn.fit(df, labels, learn)
    got = text_cnn.with_score(df, net, ["doc_id", "text"]).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    mine = [r for r in got if r.text and " x" in r.text]
    assert sum((r.score >= 0.5) == ("vile" in r.text) for r in mine) > 0.97 * len(mine)
    kept = text_cnn.without_toxic(df, labels, learn)
    assert kept.columns == df.columns and kept.filter("text like '%vile%'").count() < 8 and kept.count() > 0.7 * df.count()
    none = text_cnn.fit(df, labels.limit(0), learn)
    assert none.scores(np.zeros((0, text_cnn.VIEWS), np.uint16), np.zeros(3, np.int64)).tolist() == [0.5, 0.5]
    assert text_cnn.without_toxic(df, labels.limit(0), learn).count() == df.count()
    assert text_cnn.with_score(empty, net, ["doc_id"]).count() == 0


def brute_perplexity(trusted, texts, order=5):
    """The same model with dictionaries."""
    def grams(t):
        b = b"\0" * (order - 1) + t.encode()
        return [b[i:i + order] for i in range(len(b) - order + 1)]

    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
            cut[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
        else:
            cut[k] = [0.5, 1.0, 1.5]
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        own = by[k].get(g[:-1])
        if not own:
            return p(g[1:])
        n = counts[k].get(g, 0)
        mass = sum(cut[k][min(x, 3) - 1] for x in own)
        return (max(n - cut[k][min(n, 3) - 1], 0) if n else 0) / sum(own) + mass / sum(own) * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t.encode())) if t else None for t in texts]


def test_perplexity(spark, edge, edge_rows, empty):
    rows = [r for r in edge_rows if not (r[1] and len(r[1]) > 20_000)] + corpus(60)[20:]
    df = spark.createDataFrame(rows, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(22, 50)] + [(None,), (22,)], "doc_id bigint")
    want = brute_perplexity([r[1] for r in rows if r[0] in range(22, 50)], [r[1] for r in rows])
    expected = sorted(((r[0], r[1] and len(r[1].encode()) or 0, p and round(p, 6)) for r, p in zip(rows, want, strict=True)), key=repr)
    for most in (1 << 20, 50):  # with all n-grams in the arrays, and with most of them joined
        out = kneser_ney.quality(df, trusted, most=most).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.perplexity and round(r.perplexity, 6)) for r in out), key=repr) == expected
        assert all(r.keep == (r.perplexity is not None and r.perplexity <= r.threshold) for r in out)
    assert kneser_ney.quality(empty, trusted).count() == 0
    assert {round(r.perplexity, 6) for r in kneser_ney.quality(df, trusted.limit(0)).collect() if r.perplexity} == {256.0}


def test_raking(spark, edge, empty):
    df = spark.createDataFrame(corpus(300), SCHEMA).drop("topic")
    got = raking.mixed(df, alpha=0.5).collect()
    assert len(got) == df.count()
    total = sum(r.n_tokens * r.weight for r in got)
    for m in raking.MARGINS:
        have, mass = Counter(), Counter()
        for r in got:
            have[r[m]] += r.n_tokens
            mass[r[m]] += r.n_tokens * r.weight / total
        root = sum(math.sqrt(v) for v in have.values())
        assert all(abs(mass[k] - math.sqrt(v) / root) < 2e-3 for k, v in have.items()), m
    assert max(r.chance for r in got) <= 1 + 1e-9 and all(r.sampled in (True, False) for r in got if r.chance is not None)
    odd = raking.mixed(edge).collect()  # margins that contradict each other still give every row a chance
    assert len(odd) == edge.count() and all(0 <= r.chance <= 1 + 1e-9 for r in odd)
    kept = raking.sample(edge)
    assert kept.columns == edge.columns and kept.count() == raking.sample(edge).count()
    assert raking.sample(empty).count() == 0


def test_raking_reaches_given_margins(spark):
    cells = spark.createDataFrame([("a", "x", "t", 60), ("a", "y", "t", 10), ("b", "x", "t", 10), ("b", "y", "t", 20), (None, "x", "t", 5)], "source string, lang string, topic string, tokens bigint")
    goal = {"source": [("a", 0.4), ("b", 0.4), (None, 0.2)], "lang": [("x", 0.7), ("y", 0.3)]}
    targets = {m: spark.createDataFrame(v, f"{m} string, target double") for m, v in goal.items()}
    for (fit, left), most in ((raking.rake(cells, targets), 1e-8), (raking.rake_spread(cells, targets, tolerance=1e-2), 2e-2)):
        rows = fit.collect()
        assert left <= most and len(rows) == 5
        for m, v in goal.items():
            assert all(abs(sum(r.raked for r in rows if r[m] == k) - t) < 2 * most for k, t in v)


def test_raking_of_nearly_monolingual_sources(spark):
    r, rows = random.Random(5), []
    for s in range(20):
        for k in range(4):
            for t in range(5):
                n = r.randrange(1000, 50_000)
                rows.append((f"s{s}", f"l{k}", f"t{t}", n if k == s % 4 else max(1, int(n * r.uniform(0.001, 0.003) / 3))))
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    for few in (1000, 10):  # on the driver, and spread
        fit, left = raking.rake(cells, few=few)
        got = fit.collect()
        assert left <= raking.TOLERANCE and len(got) == 400
        for m in raking.MARGINS:
            have, mass = Counter(), Counter()
            for x in got:
                have[x[m]] += x.tokens
                mass[x[m]] += x.raked
            root = sum(v**0.7 for v in have.values())
            assert all(abs(mass[k] * root / v**0.7 - 1) < 1e-6 for k, v in have.items()), (few, m)


def test_raking_by_the_topic_of_the_table(spark):
    rows = [(1, "a b", "en", "s", "law"), (2, "a " * 8, "en", "s", "art"), (3, "b", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, topic string")
    got = {r.doc_id: r for r in raking.mixed(df, alpha=0.0).collect()}
    assert {i: r.topic for i, r in got.items()} == {1: "law", 2: "art", 3: None}
    assert all(abs(r.n_tokens * r.weight - 11 / 3) < 1e-6 for r in got.values())
    assert {r.topic for r in raking.mixed(df.drop("topic")).collect()} == {"note"}


def test_raking_tells_what_it_misses(spark):
    df = spark.createDataFrame([document(1, "a " * 30, "x", "p"), document(2, "a " * 70, "y", "q")], SCHEMA)
    goal = {"source": [("p", 0.5), ("q", 0.5)], "lang": [("x", 0.8), ("y", 0.2)]}
    targets = {m: spark.createDataFrame(v, f"{m} string, target double") for m, v in goal.items()}
    with pytest.warns(UserWarning, match="off its target"):
        got = raking.mixed(df, targets).collect()
    assert len(got) == 2 and all(abs(x.margin_error - 0.3) < 1e-6 for x in got)


def test_pipeline(spark, tmp_path):
    docs = corpus(400, bad=set(range(0, 400, 4)))
    passage = " ".join(f"q{i}" for i in range(30))
    docs += [document(500, passage + " and little else"), document(501, docs[1][1]), document(None, "no id here"), document(502, None), document(503, "")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharding":
            assert out.columns == df.columns
        seen[name] = {r.doc_id for r in out.collect()}
        if name == "ngram_jaccard_join":
            groups = {r.doc_id: r.component_id for r in jaccard_groups(df, 80, 5).collect()}
            assert seen[name] == {i for i, c in groups.items() if c == i or i is None}
        df = out
    assert 501 in seen["toxicity"] - seen["ngram_jaccard_join"] and 500 in seen["ngram_jaccard_join"] - seen["decontamination"]
    assert {502, 503, None} <= seen["decontamination"] and seen["sharding"] == seen["mixing"]
    assert len(seen["toxicity"] & set(range(0, 400, 4))) < 6
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
